"""Urban masks: no-data rules, coverage, clusters, percolation curves, thresholds, votes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import stored
from .components import connected_components
from .percolation import curves


def set_nodata(px: DataFrame, lower: float | None = None, higher: float | None = None, value: str = "value") -> DataFrame:
    """Values below lower or above higher become missing."""
    bad = F.lit(False)
    if lower is not None:
        bad = bad | (F.col(value) < lower)
    if higher is not None:
        bad = bad | (F.col(value) > higher)
    return px.withColumn(value, F.when(~F.coalesce(bad, F.lit(False)), F.col(value)))


def mask_by_coverage(px: DataFrame, mask: DataFrame, masked: float, res: float, mask_res: float, threshold: float = 0.2, value: str = "value") -> DataFrame:
    """Coarse cells (y, x of step res) that mask cells (step mask_res) of the value `masked` cover by the threshold or more become missing."""
    a, b = F.col("y") * mask_res, F.col("x") * mask_res
    span = lambda lo: F.explode(F.sequence(F.floor(lo / res), F.ceil((lo + mask_res) / res) - 1))
    side = lambda lo, c: F.least(lo + mask_res, (F.col(c) + 1) * res) - F.greatest(lo, F.col(c) * res)
    met = mask.filter(F.col("mask") == masked).select("y", "x", span(a).alias("cy"), F.col("x").alias("_x")).withColumn("cx", span(F.col("_x") * mask_res))
    share = met.select("cy", "cx", (side(a, "cy") * side(b, "cx") / (res * res)).alias("s")).groupBy(F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.sum("s").alias("__share"))
    return px.join(share, ["y", "x"], "left").withColumn(value, F.when(F.coalesce("__share", F.lit(0.0)) < threshold, F.col(value))).drop("__share")


def urban_mask(px: DataFrame, h: float, d: float) -> DataFrame:
    """Adds urban: height >= h and footprint >= d; missing values count as 0."""
    return px.withColumn("urban", (F.coalesce("height", F.lit(0.0)) >= h) & (F.coalesce("footprint", F.lit(0.0)) >= d))


def _crossing(rim: DataFrame, keys) -> DataFrame:
    """keys, local, other: labels of touching cells that differ; rim: keys, y, x, local."""
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("o")
    moved = rim.select(*keys, "local", "y", "x", near).select(*keys, F.col("local").alias("other"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return rim.join(moved, [*keys, "y", "x"]).filter("local <> other")


def _joined_labels(rim: DataFrame, keys) -> DataFrame:
    """node, component: structs of keys and label, for labels that touch one another over a border."""
    node = lambda c: F.struct(*keys, F.col(c).alias("label"))
    return connected_components(_crossing(rim, keys).select(node("local").alias("src"), node("other").alias("dst")))


def clusters_of_runs(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell of each cluster's first run, run of each cell) for cells in order of y and x: first[run] is the first cell of the run's cluster.

    Cells of a row side by side are a run; runs of neighbouring rows that touch (8 neighbours) are found by two searches in the sorted runs, and
    whole arrays of runs take the least root of what they touch until nothing changes.
    """
    if not len(y):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
    begin, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    end = np.concatenate([begin[1:], [len(y)]]) - 1
    row, wide = y[begin] - y[0], int(x.max() - x.min()) + 4
    left, right = row * wide + x[begin] - x.min() + 1, row * wide + x[end] - x.min() + 1
    lo, hi = np.searchsorted(right, left + wide - 1), np.searchsorted(left, right + wide + 1, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(begin)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = np.arange(len(begin))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return begin[root], of
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while ((up := root[root]) != root).any():
            root = up


def connected_cells(cells: DataFrame, keys: tuple = (), tile: int = 256) -> DataFrame:
    """keys, y, x, label: 8-neighbour clusters of the given cells; a label is (y << 32 | x) of the cluster's first cell.

    Labels are found inside tiles first; only pairs of labels across tile borders go on as edges, so the iterative part sees borders,
    not cells.
    """
    key_types = [(k, cells.schema[k].dataType.simpleString()) for k in keys]
    schema = ", ".join([*(f"{k} {t}" for k, t in key_types), "y long, x long, local long"])

    def label(table):
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        first, of = clusters_of_runs(y, x)
        top = first[of]
        cols = [pa.chunked_array([c]) if not isinstance(c, pa.ChunkedArray) else c for c in (table.column(k) for k in keys)]
        return pa.Table.from_arrays([*(c.take(pa.array(order)) for c in cols), pa.array(y), pa.array(x), pa.array((y[top] << 32) | (x[top] & 0xFFFFFFFF) if len(y) else np.empty(0, np.int64))], names=[*keys, "y", "x", "local"])

    tiled = cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct().withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    local = tiled.groupBy(*keys, "ty", "tx").applyInArrow(label, schema)
    edge = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    rim = local.filter(edge)
    if not keys:
        parts = connected_components(_crossing(rim, keys).select("local", "other"), "local", "other")
        return local.join(parts, F.col("local") == F.col("node"), "left").select("y", "x", F.coalesce("component", "local").alias("label"))
    parts = _joined_labels(rim, keys)
    return local.withColumn("node", F.struct(*keys, F.col("local").alias("label"))).join(parts, "node", "left").select(*keys, "y", "x", F.coalesce(F.col("component.label"), "local").alias("label"))


def cluster_sizes(labels: DataFrame, keys: tuple = ()) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def max_cluster_share(sizes: DataFrame, keys: tuple = ()) -> DataFrame:
    """Largest cluster / all cluster cells; 1 where there is none."""
    return sizes.groupBy(*keys).agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(1.0)).alias("share"))


def cluster_entropy(sizes: DataFrame, keys: tuple = ()) -> DataFrame:
    """Sum of p ln p over cluster shares (no minus sign); 0 where there is none."""
    total, part = F.sum("n"), F.sum(F.col("n") * F.ln("n"))
    return sizes.groupBy(*keys).agg(F.coalesce(F.try_divide(part, total) - F.ln(total), F.lit(0.0)).alias("entropy"))


def percolation(px: DataFrame, ds: list[float], h_min: float, criterion: str = "share", tile: int = 256) -> DataFrame:
    """d_id, d, value: share or entropy of the clusters of height >= h_min and footprint >= d, for each d, from one component tree."""
    tried = px.sparkSession.createDataFrame([(i, float(d)) for i, d in enumerate(ds)], "d_id int, d double")
    return tried.join(curves(px, [h_min], ds, criterion, tile).select("d_id", "value"), "d_id")


def percolation_2d(px: DataFrame, hs: list[float], ds: list[float], tile: int = 256) -> DataFrame:
    """h_id, h, d_id, d, value: largest-cluster share on a grid of thresholds (see percolation.curves); d_id counts the ds in rising order."""
    spark, levels = px.sparkSession, sorted(map(float, ds))
    h = spark.createDataFrame([(i, float(v)) for i, v in enumerate(hs)], "h_id int, h double")
    d = spark.createDataFrame([*enumerate(levels)], "d_id int, d double")
    return curves(px, hs, levels, "share", tile).join(h, "h_id").join(d, "d_id").select("h_id", "h", "d_id", "d", "value")


def otsu(df: DataFrame, value: str = "v") -> DataFrame:
    """Adds level (0..255) and b: 1 where the level is above the threshold of greatest between-class variance (ties: the lowest)."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    level = F.floor(F.try_divide(F.col(value) - F.lit(lo), F.lit(hi) - F.lit(lo)) * 255).cast("int")
    scaled = df.withColumn("level", F.coalesce(level, F.lit(0)))
    hist = scaled.groupBy("level").agg(F.count("*").alias("n"))  # 256 rows at most
    run = W.orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(0))
    p = hist.select("level", (F.col("n") / F.sum("n").over(every)).alias("p"))
    c = p.select("level", F.sum("p").over(run).alias("w"), F.sum(F.col("p") * F.col("level")).over(run).alias("m"), F.sum(F.col("p") * F.col("level")).over(every).alias("t"))
    between = F.round(F.try_divide(F.pow(F.col("t") * F.col("w") - F.col("m"), 2), F.col("w") * (1 - F.col("w"))), 9)
    best = c.filter("w < 1 - 1e-12").agg(F.min(F.struct((-between).alias("neg"), "level")).alias("b")).select("b.level").first()
    return scaled.withColumn("b", (F.col("level") > F.lit(best.level if best and best.level is not None else 255)).cast("int"))


def knee(curve: DataFrame, d_min: float = 0.05, sensitivity: float = 1.0) -> DataFrame:
    """knee: least d >= d_min among the knees of a convex falling curve (d, value), by Kneedle; null where there is none.

    A curve has as many rows as thresholds were tried, so its windows run in one small task.
    """
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = W.partitionBy(F.lit(0)).orderBy("d")
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(every), F.max(c).over(every) - F.min(c).over(every)), F.lit(0.0))
    z = curve.select("d", unit("d").alias("u"), unit("value").alias("v"))
    z = z.withColumn("diff", F.max("v").over(every) - F.col("v") - F.col("u"))
    z = z.withColumn("before", F.lag("diff").over(by)).withColumn("after", F.lead("diff").over(by))
    z = z.withColumn("top", (F.col("diff") >= F.col("before")) & (F.col("diff") >= F.col("after"))).withColumn("low", (F.col("diff") <= F.col("before")) & (F.col("diff") <= F.col("after")))
    z = z.withColumn("limit", F.when(F.col("top"), F.col("diff") - sensitivity * F.try_divide(F.lit(1.0), F.count("*").over(every) - 1)))
    # a maximum counts if the curve falls below its limit before the next maximum; the limit is 0 from a minimum on
    z = z.withColumn("turn", F.sum(F.coalesce(F.col("top").cast("int"), F.lit(0))).over(by))
    inside = W.partitionBy("turn").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    z = z.withColumn("own", F.first("limit", True).over(inside)).withColumn("at", F.first(F.when(F.col("top"), F.col("d")), True).over(inside))
    z = z.withColumn("bar", F.when(F.max(F.coalesce(F.col("low").cast("int"), F.lit(0))).over(inside) == 1, F.lit(0.0)).otherwise(F.col("own")))
    hit = z.filter((F.col("turn") > 0) & (F.col("d") > F.col("at")) & (F.col("diff") < F.col("bar")))
    return hit.filter(F.col("at") >= d_min).agg(F.min("at").alias("knee"))


def fuse(matrices: list[DataFrame], keys: tuple = ("h_id", "d_id")) -> DataFrame:
    """Logical and of binary matrices (column b) on their common keys."""
    n = len(matrices)
    every = reduce(DataFrame.unionByName, [m.select(*keys, "b") for m in matrices])
    return every.groupBy(*keys).agg(F.min("b").alias("b"), F.count("*").alias("n")).filter(F.col("n") == n).drop("n")


def threshold_curve(matrix: DataFrame) -> DataFrame:
    """h_id, d_id: the first d where the matrix is 0; an h whose first column is 0, or that has no 0, goes."""
    return matrix.groupBy("h_id").agg(F.min(F.when(F.col("b") == 0, F.col("d_id"))).alias("d_id")).filter(F.col("d_id") > 0)


def thresholds_to_json(df: DataFrame) -> DataFrame:
    """One row: a JSON object from index to [h, d] (a short list)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("i").cast("string").alias("k"), F.array("h", "d").alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def thresholds_from_json(df: DataFrame) -> DataFrame:
    parsed = F.from_json("json", "map<string,array<double>>")
    return df.select(F.explode(parsed).alias("k", "v")).select(F.col("k").cast("int").alias("i"), F.col("v")[0].alias("h"), F.col("v")[1].alias("d"))


def limit_of(height: Column, curve: list[tuple[float, float]], max_height: float) -> Column:
    """Footprint limit of a height by a curve of (h, d): it starts with (0, 1) and ends with (max height, least limit)."""
    points = [(0.0, 1.0), *sorted(curve), (max_height, min([d for _, d in curve], default=1.0))]
    out = F.lit(points[0][1])
    for h, d in points[1:-1]:
        out = F.when(height >= h, F.lit(float(d))).otherwise(out)
    return out


def vote_mask_2d(sources: list[tuple[DataFrame, list[tuple[float, float]]]], ratio: float = 0.8, max_height: float = 1000.0) -> DataFrame:
    """y, x, urban: share of sources in which the cell's footprint reaches its height's limit, at least ratio."""
    votes = [px.select("y", "x", (F.coalesce("footprint", F.lit(0.0)) >= limit_of(F.coalesce("height", F.lit(0.0)), curve, max_height)).cast("int").alias("v")) for px, curve in sources]
    return reduce(DataFrame.unionByName, votes).groupBy("y", "x").agg((F.sum("v") / len(sources) >= ratio).alias("urban"))


def vote_mask(sources: list[tuple[DataFrame, float]], h_min: float = 2.0, ratio: float = 0.8) -> DataFrame:
    """y, x, urban: share of sources with height >= h_min and footprint >= the source's d, at least ratio."""
    votes = [urban_mask(px, h_min, d).select("y", "x", F.col("urban").cast("int").alias("v")) for px, d in sources]
    return reduce(DataFrame.unionByName, votes).groupBy("y", "x").agg((F.sum("v") / len(sources) >= ratio).alias("urban"))


def apply_mask(px: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """Values stay where the mask is set and they are not zero; others are missing."""
    set_ = mask.filter("urban").select("y", "x").distinct().withColumn("__m", F.lit(True))
    return px.join(set_, ["y", "x"], "left").withColumn(value, F.when(F.col("__m") & (F.col(value) != 0), F.col(value))).drop("__m")


def fuse_threshold_mask(reference: DataFrame, models: list[tuple[DataFrame, list[tuple[float, float]]]], h_min: float = 3.0, d_min: float = 0.1, max_height: float = 1000.0) -> DataFrame:
    """y, x, keep: cells that no raster blanks; the reference keeps height > h_min and footprint > d_min, models their binned limits."""
    blank = [reference.select("y", "x", (~((F.coalesce("height", F.lit(0.0)) > h_min) & (F.coalesce("footprint", F.lit(0.0)) > d_min))).alias("b"))]
    blank += [px.select("y", "x", (F.coalesce("footprint", F.lit(0.0)) < limit_of(F.coalesce("height", F.lit(0.0)), curve, max_height)).alias("b")) for px, curve in models]
    return reduce(DataFrame.unionByName, blank).groupBy("y", "x").agg((~F.bool_or("b")).alias("keep"))


def crop(px: DataFrame, ny: int, nx: int) -> DataFrame:
    return px.filter((F.col("y") < ny) & (F.col("x") < nx))
