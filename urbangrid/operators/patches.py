"""Windows around cells (patches): cutting, checking, filling, rescaling, augmenting.

A patch is array<double> of size * size values, row by row; its long form has columns patch_id, i, j, v.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..schemas import TILE
from ..sources.io import band_names, sample_chunks
from ..sources.shared import stored


def offsets(size: int) -> tuple[int, int]:
    """First and last offset of a window: odd -(s-1)/2..(s-1)/2, even -(s/2-1)..s/2."""
    return -((size - 1) // 2), size // 2


@lru_cache(maxsize=32)
def _nearest_first(size: int) -> np.ndarray:
    """For each cell of a window, all its cells by distance (ties: the smaller row, then column)."""
    i, j = np.divmod(np.arange(size * size), size)
    d2 = (i[:, None] - i[None, :]) ** 2 + (j[:, None] - j[None, :]) ** 2
    return np.argsort(d2, axis=1, kind="stable")


def fill_windows(windows: np.ndarray, size: int) -> np.ndarray:
    """Missing cells of each window (a row of size * size values) take the nearest valid value of that window; an empty window stays."""
    out = windows.copy()
    row, at = np.nonzero(np.isnan(windows))
    order = _nearest_first(size)
    for k in range(1, size * size):
        if not len(row):
            break
        found = windows[row, order[at, k]]
        ok = ~np.isnan(found)
        out[row[ok], at[ok]] = found[ok]
        row, at = row[~ok], at[~ok]
    return out


def extract_patches(px: DataFrame, centers: DataFrame, size: int, tile: int = TILE, bands: list[str] | None = None, fill: bool = False) -> DataFrame:
    """band, cy, cx, size, patch: the window around each centre (columns cy, cx); cells that are missing are null, or the nearest in the window (fill).

    bands: the names asked for; all of a raster's own names where not given.

    Cells travel once with their tile and once for each neighbour tile whose halo holds them, centres to their own tile; a task
    holds the cells of a tile as an array and slices it, so s * s rows for each centre are never made.
    """
    lo, hi = offsets(size)
    ty, tx = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)
    reach = max(-lo, hi)
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    cells = px.select("band", "y", "x", F.col("value").cast("double").alias("value"), F.explode(span("y")).alias("ty"), F.col("x").alias("_x")).withColumn("tx", F.explode(span("_x"))).drop("_x")
    names = bands or band_names(px)
    asked = centers.select(F.col("cy").cast("long").alias("y"), F.col("cx").cast("long").alias("x")).distinct().withColumn("ty", ty).withColumn("tx", tx)
    asked = asked.withColumn("band", F.explode(F.array(*map(F.lit, names)))).select("band", "y", "x", F.lit(None).cast("double").alias("value"), "ty", "tx", F.lit(1).alias("ask")) if names else asked.select(F.lit(None).cast("string").alias("band"), "y", "x", F.lit(None).cast("double").alias("value"), "ty", "tx", F.lit(1).alias("ask")).limit(0)
    rows = cells.withColumn("ask", F.lit(0)).select("band", "y", "x", "value", "ty", "tx", "ask").unionByName(asked)
    schema = "band string, cy long, cx long, size int, patch array<double>"
    columns = ["band", "cy", "cx", "size", "patch"]

    def cut(key, table):
        band, t_y, t_x = key[0].as_py(), key[1].as_py(), key[2].as_py()
        ask = table.column("ask").to_numpy()
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "value"))
        y0, x0 = t_y * tile - reach, t_x * tile - reach
        grid = np.full((tile + 2 * reach, tile + 2 * reach), np.nan)
        own = ask == 0
        grid[y[own] - y0, x[own] - x0] = v[own]
        cy, cx = y[~own], x[~own]
        step = np.arange(lo, hi + 1)
        out = grid[(cy - y0)[:, None, None] + step[None, :, None], (cx - x0)[:, None, None] + step[None, None, :]].reshape(len(cy), size * size)
        flat = pa.array((fill_windows(out, size) if fill else out).ravel(), pa.float64(), from_pandas=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cy) + 1, dtype=np.int32) * size * size), flat)
        return pa.Table.from_arrays([pa.array([band] * len(cy), pa.string()), pa.array(cy), pa.array(cx), pa.array(np.full(len(cy), size, np.int32)), lists], names=columns)

    return rows.groupBy("band", "ty", "tx").applyInArrow(cut, schema)


def multi_size_patches(px: DataFrame, centers: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows of several sizes in frames of the largest: cells outside a size's window are null."""
    top = max(sizes)
    lo, _ = offsets(top)
    whole = extract_patches(px, centers, top)

    def inside(size: int) -> Column:
        a, b = offsets(size)
        return F.transform("patch", lambda v, k: F.when(((k / top).cast("int") + lo).between(a, b) & ((k % top) + lo).between(a, b), v))

    return whole.select("band", "cy", "cx", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), inside(s).alias("patch")) for s in sizes])).alias("p")).select("band", "cy", "cx", "p.size", "p.patch")


def assemble_patches(centers: DataFrame, sources: list[tuple[DataFrame, list[str]]], size: int, fill: bool = False) -> DataFrame:
    """cy, cx and one patch column for each band of each source."""
    out = None
    for px, bands in sources:
        cut = extract_patches(px.filter(F.col("band").isin(*bands)), centers, size, bands=bands, fill=fill).groupBy("cy", "cx").agg(*[F.max(F.when(F.col("band") == b, F.col("patch"))).alias(b) for b in bands])
        out = cut if out is None else out.join(cut, ["cy", "cx"])
    return out


def aux_patch_size(size: int, ratio: float) -> int:
    return int(size * ratio)


def keep_complete(df: DataFrame, columns: list[str], kept_ratio: float = 0.01) -> DataFrame:
    """Rows whose patches all miss at most kept_ratio of their cells."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (S.nan_ratio(c) <= kept_ratio)
    return df.filter(ok)


def fill_nan_nearest(px: DataFrame, value: str = "value", keys: tuple = (), strip: int = 1024, columns: int = 256) -> DataFrame:
    """Missing cells take the value of the nearest valid cell (of the same keys, such as a band); ties go to the smaller (distance, y, x).

    An exact distance transform in two passes, whatever the size of the holes.  Down the columns: for each row with a hole, the nearest valid cell of each column;
    tiles of strip x columns cells are worked alone, with the nearest valid cells of the column above and below the strip as a carry (one
    aggregate and a window over strips).  Along the rows: a hole's cell takes the least (distance, y, x) among the columns' cells, going outwards until the
    columns are farther away than what it has.  A task holds a tile, or one row of the raster.  Cells of keys without any valid cell stay missing.
    """
    px = px.select(*keys, "y", "x", F.col(value).cast("double").alias(value))
    bad = F.col(value).isNull() | F.isnan(value)
    at = [F.col(c).cast("long").alias(c) for c in ("y", "x")]
    part = [F.floor(F.col("y") / strip).alias("__s"), F.floor(F.col("x") / columns).alias("__b")]
    good = px.filter(~bad).select(*keys, *at, F.col(value).alias("g"))
    holes = px.filter(bad).select(*keys, *at).groupBy(*keys, "y").agg(F.collect_list("x").alias("xs"))
    rows = holes.select(*keys, "y")
    group = list(keys) or [F.lit(0).alias("__all")]
    named = list(keys) or ["__all"]

    # the carry: for each strip with holes and each column, the last valid cell before the strip and the first after it
    cell = F.struct("y", "g")
    ends = good.select(*group, *part[:1], "x", cell.alias("c")).groupBy(*named, "__s", "x").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    asked = rows.select(*group, *part[:1]).distinct()
    needed = asked.join(ends.select(*named, "x").distinct(), named).select(*named, "__s", "x", F.lit(None).cast(ends.schema["lo"].dataType).alias("lo"), F.lit(None).cast(ends.schema["hi"].dataType).alias("hi"))
    marked = ends.withColumn("n", F.lit(0)).unionByName(needed.withColumn("n", F.lit(1))).groupBy(*named, "__s", "x").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"))
    by_strip = W.partitionBy(*named, "x").orderBy("__s")
    over = F.array(F.last("hi", ignorenulls=True).over(by_strip.rowsBetween(W.unboundedPreceding, -1)), F.first("lo", ignorenulls=True).over(by_strip.rowsBetween(1, W.unboundedFollowing)))
    carried = marked.withColumn("over", over).filter("n = 1").select(*named, "__s", "x", F.explode("over").alias("c")).filter("c is not null").select(*named, "__s", F.floor(F.col("x") / columns).alias("__b"), "c.y", "x", "c.g")

    own = good.select(*group, *part, "y", "x", "g").join(asked, [*named, "__s"], "left_semi").select(*named, "__s", "__b", "y", "x", "g")
    blocks = ends.select(*named, F.floor(F.col("x") / columns).alias("__b")).distinct()
    wanted = rows.select(*group, *part[:1], "y").join(blocks, named).select(*named, "__s", "__b", "y", F.lit(None).cast("long").alias("x"), F.lit(None).cast("double").alias("g"))
    names = ", ".join(f"{k} {'int' if k == '__all' else px.schema[k].dataType.simpleString()}" for k in named)

    def down(table):
        """For each wanted row the nearest valid cell of each column, as arrays."""
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        marks = table.column("x").is_null().to_numpy()
        to = np.unique(y[marks])
        cells = np.flatnonzero(~marks)
        cells = cells[np.lexsort((y[cells], x[cells]))]
        cy, cx, g = y[cells], x[cells].astype(np.int64), table.column("g").to_numpy()[cells]
        starts = np.flatnonzero(np.concatenate([[True], cx[1:] != cx[:-1]])) if len(cx) else np.empty(0, np.int64)
        pick = np.empty((len(to), len(starts)), np.int64)
        for c, (i, j) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(cx)])):
            after = np.searchsorted(cy[i:j], to)
            lo, hi = np.maximum(after - 1, 0), np.minimum(after, j - i - 1)
            pick[:, c] = i + np.where(np.abs(cy[i:j][hi] - to) < np.abs(to - cy[i:j][lo]), hi, lo)  # the upper one in a tie
        lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel()), len(starts)).cast(pa.list_(pa.array(v.ravel()[:0]).type)) if len(starts) else pa.array([[]] * len(to), pa.list_(pa.array(v.ravel()[:0]).type))
        own_keys = [pa.array([table.column(k)[0].as_py()] * len(to), table.schema.field(k).type) for k in named]
        return pa.table([*own_keys, pa.array(to), lists(np.broadcast_to(cx[starts], pick.shape) if len(starts) else pick), lists(cy[pick]), lists(g[pick])], names=[*named, "y", "gx", "gy", "g"])

    columns_of = own.unionByName(carried.select(own.columns)).unionByName(wanted).groupBy(*named, "__s", "__b").applyInArrow(down, f"{names}, y long, gx array<long>, gy array<long>, g array<double>")

    def along(table):
        """The holes of one row."""
        own_keys, y = [table.column(k)[0].as_py() for k in named], table.column("y")[0].as_py()
        flat = lambda c: np.concatenate([np.empty(0, np.int64), *(v.values.to_numpy() for v in table.column(c) if v.is_valid)])
        x, gx, gy, g = np.sort(flat("xs")).astype(np.int64), flat("gx").astype(np.int64), flat("gy").astype(np.int64), flat("g")
        order = np.argsort(gx)
        gx, gy, g = gx[order], gy[order], g[order]
        best, got = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)  # candidate, squared distance
        right = np.searchsorted(gx, x)
        left, open_ = right - 1, np.arange(len(x))
        while len(open_) and len(gx):
            going = np.zeros(len(open_), bool)
            for side, step in ((left, -1), (right, 1)):
                k = side[open_]
                ok = (k >= 0) & (k < len(gx))
                k = np.where(ok, k, 0)
                across = (gx[k] - x[open_]) ** 2
                ok &= across <= got[open_]
                d2 = across + (gy[k] - y) ** 2
                b = best[open_]
                better = ok & ((d2 < got[open_]) | ((d2 == got[open_]) & ((gy[k] < gy[b]) | ((gy[k] == gy[b]) & (gx[k] < gx[b])))))
                got[open_[better]], best[open_[better]] = d2[better], k[better]
                side[open_] += step
                going |= ok
            open_ = open_[going]
        filled = pa.array(g[best], pa.float64()) if len(g) else pa.nulls(len(x), pa.float64())
        return pa.table([*[pa.array([v] * len(x), table.schema.field(k).type) for k, v in zip(named, own_keys)], pa.array(np.full(len(x), y)), pa.array(x), filled], names=[*named, "y", "x", value])

    lists = ("gx", "gy", "g")
    empty = lambda c: F.lit(None).cast(columns_of.schema[c].dataType).alias(c)
    both = columns_of.select(*named, "y", *lists, F.lit(None).cast("array<long>").alias("xs")).unionByName(holes.select(*group, "y", *map(empty, lists), "xs"))
    # written, as fits and other callers read the result more than once
    found = stored(both.groupBy(*named, "y").applyInArrow(along, f"{names}, y long, x long, {value} double"), "holes")
    back = [F.col(c).cast(px.schema[c].dataType).alias(c) for c in ("y", "x")]
    return px.filter(~bad).unionByName(found.select(*keys, *back, value))


def reliable_samples(df: DataFrame, h_min: float = 3.0, h_max: float = 600.0, area_min: float = 1e-2, height: str = "height", footprint: str = "footprint") -> DataFrame:
    """Cells with a plausible height and footprint; a negative footprint with a height of at most 20 passes."""
    h, f = F.col(height), F.col(footprint)
    small = (f >= 0) & (f < area_min)
    tall = (f < 4 * area_min) & (h > 20)
    return df.filter(h.isNotNull() & (h > h_min) & (h < h_max) & ~small & ~tall)


def rescale_band(px: DataFrame, q_hi: float = 0.98, q_lo: float = 0.02, v_min: float = 0.0, v_max: float = 1.0) -> DataFrame:
    """(x - min) * (v_max - v_min) / (q_hi - q_lo) + v_min, clipped; the minimum, not q_lo, is subtracted; null where the quantiles are equal."""
    q = F.percentile("value", F.array(F.lit(q_lo), F.lit(q_hi)))
    stats = px.groupBy("band").agg(F.min("value").alias("__lo"), q.alias("__q"))
    scaled = F.try_divide((F.col("value") - F.col("__lo")) * (v_max - v_min), F.col("__q")[1] - F.col("__q")[0]) + v_min
    return px.join(stats, "band").withColumn("value", F.when(scaled.isNotNull(), F.least(F.lit(float(v_max)), F.greatest(F.lit(float(v_min)), scaled)))).drop("__lo", "__q")


def rescale_patch(long: DataFrame, q_hi: float = 0.98, q_lo: float = 0.02, v_min: float = 0.0, v_max: float = 1.0, keys: tuple = ("patch_id",)) -> DataFrame:
    """The same for each patch of a long table; an undefined result is v_min."""
    q = F.percentile("v", F.array(F.lit(q_lo), F.lit(q_hi)))
    stats = long.groupBy(*keys).agg(F.min("v").alias("__lo"), q.alias("__q"))
    scaled = F.try_divide((F.col("v") - F.col("__lo")) * (v_max - v_min), F.col("__q")[1] - F.col("__q")[0]) + v_min
    return long.join(stats, list(keys)).withColumn("v", F.coalesce(F.when(scaled.isNotNull(), F.least(F.lit(float(v_max)), F.greatest(F.lit(float(v_min)), scaled))), F.lit(float(v_min)))).drop("__lo", "__q")


def order_bands(df: DataFrame, size: int, bands: tuple = ("VV", "VH", "R", "G", "B", "NIR"), aux: tuple = (), flip: bool = False) -> DataFrame:
    """Adds features: the patches of the bands (then of aux, sorted) in order, rows reversed where flip."""

    def rows(c: str) -> Column:
        if not flip:
            return F.col(c)
        return F.flatten(F.transform(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), lambda i: F.slice(c, i * size + 1, size)))

    return df.withColumn("features", F.concat(*[rows(c) for c in (*bands, *sorted(aux))]))


def augment_flip(df: DataFrame, size: int, seed: int, patch: str = "patch", id_col: str = "patch_id") -> DataFrame:
    """With chance 0.5 each patch is flipped up-down, left-right or both, chosen by a hash of its id."""
    h = S.seeded_hash(id_col, F.lit(seed)) % 6
    row = lambda i, back: F.reverse(F.slice(patch, i * size + 1, size)) if back else F.slice(patch, i * size + 1, size)
    down, up = F.sequence(F.lit(0), F.lit(size - 1)), F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1))
    flipped = [F.flatten(F.transform(up, lambda i: row(i, False))), F.flatten(F.transform(down, lambda i: row(i, True))), F.flatten(F.transform(up, lambda i: row(i, True)))]
    return df.withColumn("flip", F.when(h < 3, h + 1).otherwise(0).cast("int")).withColumn(patch, F.when(F.col("flip") == 1, flipped[0]).when(F.col("flip") == 2, flipped[1]).when(F.col("flip") == 3, flipped[2]).otherwise(F.col(patch)))


def augment_noise(df: DataFrame, variance: float, seed: int, patch: str = "patch", id_col: str = "patch_id") -> DataFrame:
    """Adds Gaussian noise: two hashes of id and position give a Box-Muller pair, so the same seed gives the same noise."""

    def unit(k: Column, salt: int) -> Column:
        return (S.seeded_hash(id_col, k, F.lit(seed), F.lit(salt)) % 1_000_003 + 0.5) / 1_000_003.0

    noise = lambda k: F.sqrt(-2 * F.ln(unit(k, 1))) * F.cos(2 * math.pi * unit(k, 2)) * math.sqrt(variance)
    return df.withColumn(patch, F.transform(patch, lambda v, k: v + noise(k)))


def to_long(df: DataFrame, size: int, patch: str = "patch", keys: tuple = ("patch_id",)) -> DataFrame:
    """keys, i, j, v from an array patch."""
    return df.select(*keys, F.posexplode(patch).alias("p", "v")).select(*keys, F.floor(F.col("p") / size).alias("i"), (F.col("p") % size).cast("long").alias("j"), "v")


def to_grid(long: DataFrame, keys: tuple = ("patch_id",)) -> DataFrame:
    """keys, patch from the long form."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda s: s["v"]).alias("patch"))


def patch_dataset(px: DataFrame, labels: DataFrame, size: int, chunk_size: int = 100_000, **limits) -> DataFrame:
    """city, chunk, cy, cx, height, footprint and band patches for the reliable label cells of all cities (labels: city, y, x, height, footprint)."""
    good = reliable_samples(labels, **limits).withColumnRenamed("y", "cy").withColumnRenamed("x", "cx")
    bands = band_names(px)
    cut = assemble_patches(good, [(px, bands)], size)
    cut = cut.select("cy", "cx", *[F.col(b).alias(f"patch_{b}") for b in bands])  # labels may have a band's name
    kept = keep_complete(good.join(cut, ["cy", "cx"]), [f"patch_{b}" for b in bands])
    return sample_chunks(kept, "city", ["cy", "cx"], chunk_size)


def patch_exchange(px: DataFrame, centers: DataFrame, size: int, default: float = -1e4) -> DataFrame:
    """Patches at sample points with the default where a cell is missing."""
    return extract_patches(px, centers, size).withColumn("patch", F.transform("patch", lambda v: F.coalesce(v, F.lit(default))))
