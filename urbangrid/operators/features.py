"""Patch features on the long form (patch_id, band, i, j, v): statistics, morphology, texture, spectral indices.

A patch is small, so the cells of a patch meet once in a row, and morphology works on a batch of patches as arrays; `patch_features` gives all
features of array patches in one pass without a shuffle.  Co-occurrence on the long form is an equi-join of shifted cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ("patch_id", "band")

STATISTICS: dict[str, Callable[[Column], Column]] = {
    "Mean": F.avg,
    "Std": F.stddev_pop,
    "Max": F.max,
    "Min": F.min,
    "50pt": lambda c: F.percentile(c, F.lit(0.5)),
    "25pt": lambda c: F.percentile(c, F.lit(0.25)),
    "75pt": lambda c: F.percentile(c, F.lit(0.75)),
}


def band_stats(long: DataFrame, names: list[str] | None = None, keys: tuple = KEYS) -> DataFrame:
    """One column for each named statistic of each patch and band."""
    return long.groupBy(*keys).agg(*[pick(STATISTICS, n)(F.col("v")).alias(n) for n in names or STATISTICS])


# ---------------------------------------------------------------- patches as arrays
class _Grids:
    """The patches of one Arrow batch side by side: an array (patch, row, column), NaN where a cell is missing."""

    def __init__(self, cells: pa.ListArray):
        flat = cells.flatten()
        i, j, v = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        sizes = np.diff(cells.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        i0, j0 = (np.minimum.reduceat(c, starts) if len(c) else np.empty(0, np.int64) for c in (i, j))
        self.at = row, i - i0[row], j - j0[row]
        shape = [int(c.max()) + 1 if len(c) else 0 for c in self.at[1:]]
        self.grid = np.full((len(sizes), *shape), np.nan)
        self.grid[self.at] = v.astype(float)
        self.cells, self.flat = cells, flat

    def with_values(self, grid: np.ndarray) -> pa.ListArray:
        structs = pa.StructArray.from_arrays([self.flat.field(0), self.flat.field(1), pa.array(grid[self.at])], ["i", "j", "v"])
        return pa.ListArray.from_arrays(pa.array((self.cells.offsets.to_numpy() - self.cells.offsets[0].as_py()).astype(np.int32)), structs)


def _gathered(long: DataFrame, keys: tuple) -> DataFrame:
    """keys, cells: a row for each patch, so everything after it stays in the task."""
    cell = F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return long.filter(F.col("v").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def _slide(a: np.ndarray, k: int, axis: int, low: bool) -> np.ndarray:
    pad = [(0, 0)] * a.ndim
    pad[axis] = (k // 2, k // 2)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=np.inf if low else -np.inf), 2 * (k // 2) + 1, axis=axis)
    return view.min(axis=-1) if low else view.max(axis=-1)


def _extreme(grid: np.ndarray, k: int, low: bool, shape: str = "square") -> np.ndarray:
    """Least or greatest present value under a k x k square (one direction after the other) or cross."""
    if k <= 1:
        return grid
    a = np.where(np.isnan(grid), np.inf if low else -np.inf, grid)
    if shape == "square":
        out = _slide(_slide(a, k, -1, low), k, -2, low)
    else:
        out = (np.minimum if low else np.maximum)(_slide(a, k, -1, low), _slide(a, k, -2, low))
    return np.where(np.isnan(grid), np.nan, out)


def _open(grid: np.ndarray, k: int, shape: str = "square") -> np.ndarray:
    return _extreme(_extreme(grid, k, True, shape), k, False, shape)


def _close(grid: np.ndarray, k: int, shape: str = "square") -> np.ndarray:
    return _extreme(_extreme(grid, k, False, shape), k, True, shape)


def _open_rec(grid: np.ndarray, k: int, max_iter: int = 10_000) -> np.ndarray:
    """Erosion, then dilation under the image until no patch changes."""
    marker = _extreme(grid, k, True)
    for _ in range(max_iter):
        grown = np.minimum(_extreme(marker, 3, False), grid)
        if np.array_equal(grown, marker, equal_nan=True):
            break
        marker = grown
    return marker


def _close_rec(grid: np.ndarray, k: int, max_iter: int = 10_000) -> np.ndarray:
    return -_open_rec(-grid, k, max_iter)


def _on_grids(long: DataFrame, change: Callable[[np.ndarray], np.ndarray], keys: tuple) -> DataFrame:
    """keys, i, j, v with the values that `change` gives."""
    rows = _gathered(long, keys)

    def run(batches):
        for b in batches:
            if b.num_rows:
                g = _Grids(b.column(len(keys)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], g.with_values(change(g.grid))], names=[*keys, "cells"])

    return rows.mapInArrow(run, rows.schema).select(*keys, F.inline("cells"))


def erode(long: DataFrame, k: int, shape: str = "square", keys: tuple = KEYS) -> DataFrame:
    """Least value of the present cells under a k x k square (or cross)."""
    return _on_grids(long, lambda g: _extreme(g, k, True, shape), keys)


def dilate(long: DataFrame, k: int, shape: str = "square", keys: tuple = KEYS) -> DataFrame:
    return _on_grids(long, lambda g: _extreme(g, k, False, shape), keys)


def opening(long: DataFrame, k: int, shape: str = "square", keys: tuple = KEYS) -> DataFrame:
    return _on_grids(long, lambda g: _open(g, k, shape), keys)


def closing(long: DataFrame, k: int, shape: str = "square", keys: tuple = KEYS) -> DataFrame:
    return _on_grids(long, lambda g: _close(g, k, shape), keys)


def opening_rec(long: DataFrame, k: int, max_iter: int = 10_000, keys: tuple = KEYS) -> DataFrame:
    """Erosion, then dilation under the image until stable."""
    return _on_grids(long, lambda g: _open_rec(g, k, max_iter), keys)


def closing_rec(long: DataFrame, k: int, max_iter: int = 10_000, keys: tuple = KEYS) -> DataFrame:
    """Dilation, then erosion above the image until stable."""
    return _on_grids(long, lambda g: _close_rec(g, k, max_iter), keys)


MORPHOLOGY: dict[str, Callable] = {"opening": opening, "closing": closing, "opening_rec": opening_rec, "closing_rec": closing_rec}
_ON_ARRAYS: dict[str, Callable] = {"opening": _open, "closing": _close, "opening_rec": _open_rec, "closing_rec": _close_rec}


def _profile(grid: np.ndarray, sizes: list[int], method: str) -> np.ndarray:
    """(patch, step): mean absolute difference of the operator at a size and at the size before it."""
    op = pick(_ON_ARRAYS, method)
    at = [op(grid, k) for k in sizes]
    there = np.maximum(1, (~np.isnan(grid)).sum(axis=(-2, -1)))
    return np.stack([np.nansum(np.abs(x - y), axis=(-2, -1)) / there for x, y in zip(at, at[1:])], axis=-1)


def dmp_mean(long: DataFrame, sizes: list[int], method: str = "opening", keys: tuple = KEYS) -> DataFrame:
    """keys, size, dmp: mean absolute difference of the operator at a size and at the size before it."""
    rows = _gathered(long, keys)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(_profile(_Grids(b.column(len(keys))).grid, sizes, method).tolist(), pa.list_(pa.float64()))], names=[*keys, "steps"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "steps array<double>"])
    steps = F.arrays_zip(F.array(*map(F.lit, sizes[1:])).alias("size"), F.col("steps").alias("dmp"))
    return rows.mapInArrow(run, schema).select(*keys, F.explode(steps).alias("s")).select(*keys, F.col("s")["size"].alias("size"), F.col("s")["dmp"].alias("dmp"))


# fixed values: steps at distance 1 for 0, 45, 90 and 135 degrees
ANGLES = ((0, 1), (1, 1), (1, 0), (1, -1))


def glcm(long: DataFrame, w: int, size: int, levels: int = 8, keys: tuple = KEYS) -> DataFrame:
    """keys, a, b, p: co-occurrence of grey levels in the centre window w x w, summed over four angles, not symmetric, normalised."""
    c = (size - 1) // 2
    lo, hi = max(0, c - (w - 1) // 2), min(size - 1, c + w // 2)
    level = F.floor(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v"))) * 255) / (256 // levels)).cast("int")
    cells = long.filter(F.col("i").between(lo, hi) & F.col("j").between(lo, hi)).select(*keys, "i", "j", level.alias("g"))
    step = F.explode(F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in ANGLES])).alias("o")
    moved = cells.select(*keys, "i", "j", F.col("g").alias("a"), step).select(*keys, (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "a")
    pairs = moved.join(cells.withColumnRenamed("g", "b"), [*keys, "i", "j"])
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    total = pairs.groupBy(*keys).agg(F.count("*").alias("t"))
    return counts.join(total, list(keys)).select(*keys, "a", "b", (F.col("n") / F.col("t")).alias("p"))


def _moment(a: int = 0, b: int = 0) -> Column:
    """Sum of a-th power of the first level, b-th of the second, times p."""
    return F.sum(F.pow("a", F.lit(a)) * F.pow("b", F.lit(b)) * F.col("p"))


def _of_difference(weight: Callable[[Column], Column]) -> Column:
    return F.sum(weight(F.col("a") - F.col("b")) * F.col("p"))


def glcm_correlation(standard: bool = False) -> Column:
    """(sum a b p - ma mb) / (var_a var_b); standard divides by the deviations.  Undefined: 0."""
    ma, mb = _moment(1, 0), _moment(0, 1)
    va, vb = _moment(2, 0) - ma * ma, _moment(0, 2) - mb * mb
    under = F.sqrt(va * vb) if standard else va * vb
    # moments of a constant window differ from 0 only by rounding
    return F.coalesce(F.when(F.abs(va * vb) > 1e-12, F.try_divide(_moment(1, 1) - ma * mb, under)), F.lit(0.0))


TEXTURES: dict[str, Callable[[], Column]] = {
    "mean": lambda: F.sum("p") / 64,
    "variance": lambda: F.sum(F.col("p") * F.col("p")) / 64 - F.pow(F.sum("p") / 64, F.lit(2)),
    "homogeneity": lambda: _of_difference(lambda d: 1 / (1 + d * d)),
    "contrast": lambda: _of_difference(lambda d: d * d),
    "dissimilarity": lambda: _of_difference(F.abs),
    "entropy": lambda: F.sum(-F.col("p") * F.ln("p")),
    "2nd_moment": lambda: F.sum(F.col("p") * F.col("p")),
    "correlation": glcm_correlation,
}


def texture(long: DataFrame, w: int, size: int, names: list[str] | None = None, keys: tuple = KEYS) -> DataFrame:
    return glcm(long, w, size, keys=keys).groupBy(*keys).agg(*[pick(TEXTURES, n)().alias(n) for n in names or TEXTURES])


def spectral_features(wide: DataFrame, keys: tuple = ("patch_id",)) -> DataFrame:
    """Mean of six normalized indices of the R, G, B, NIR pairs, and mean luminance (wide: a row for each cell)."""
    bands = ("R", "G", "B", "NIR")
    pairs = [(a, b) for k, a in enumerate(bands) for b in bands[k + 1 :]]
    return wide.groupBy(*keys).agg(*[F.avg(S.normalized_index(a, b)).alias(f"ndi_{a}_{b}") for a, b in pairs], F.avg(S.luminance("R", "G", "B")).alias("luminance"))


def backscatter_features(long: DataFrame, keys: tuple = ("patch_id",)) -> DataFrame:
    """Mean coefficient of VV and VH of each patch."""
    coef = lambda b: F.avg(F.when(F.col("band") == b, S.backscatter("v"))).alias(b)
    return long.groupBy(*keys).agg(coef("VV"), coef("VH"))


def _band_numbers(g: np.ndarray) -> dict[str, np.ndarray]:
    flat = np.sort(g.reshape(len(g), -1), axis=1)  # missing values come last
    n = (~np.isnan(flat)).sum(axis=1)
    some = np.maximum(1, n)
    mean = np.nansum(flat, axis=1) / some
    out = {"Mean": mean, "Std": np.sqrt(np.nansum((flat - mean[:, None]) ** 2, axis=1) / some), "Max": flat[np.arange(len(g)), some - 1], "Min": flat[:, 0]}
    for name, q in (("50pt", 0.5), ("25pt", 0.25), ("75pt", 0.75)):
        at = q * (some - 1)
        lo = np.floor(at).astype(int)
        x, y = flat[np.arange(len(g)), lo], flat[np.arange(len(g)), np.minimum(lo + 1, some - 1)]
        out[name] = x + (at - lo) * (y - x)
    return out


def _texture_numbers(g: np.ndarray, w: int, levels: int = 8) -> dict[str, np.ndarray]:
    """The textures of the centre window, all patches at once (see `glcm` and TEXTURES)."""
    n, size = len(g), g.shape[-1]
    c = (size - 1) // 2
    lo, hi = max(0, c - (w - 1) // 2), min(size - 1, c + w // 2)
    win = g[:, lo : hi + 1, lo : hi + 1]
    level = np.floor(np.floor(np.clip(win, 0, 1) * 255 + 0.5) / (256 // levels))
    counts = np.zeros(n * levels * levels)
    m = win.shape[-1]
    for di, dj in ANGLES:
        x = level[:, : m - di, max(0, -dj) : m - max(0, dj)]
        y = level[:, di:, max(0, dj) : m - max(0, -dj)]
        ok = ~np.isnan(x) & ~np.isnan(y)
        where = np.nonzero(ok)[0]
        counts += np.bincount((where * levels + x[ok].astype(int)) * levels + y[ok].astype(int), minlength=len(counts))
    counts = counts.reshape(n, levels, levels)
    p = counts / np.maximum(1, counts.sum(axis=(1, 2)))[:, None, None]
    a, b = np.arange(levels)[:, None], np.arange(levels)[None, :]
    total = lambda x: (p * x).sum(axis=(1, 2))
    d, whole, square = a - b, total(np.ones((1, 1))), (p * p).sum(axis=(1, 2))
    ma, mb = total(a), total(b)
    va, vb = total(a * a) - ma * ma, total(b * b) - mb * mb
    spread = np.abs(va * vb) > 1e-12
    return {
        "mean": whole / 64, "variance": square / 64 - (whole / 64) ** 2, "homogeneity": total(1 / (1 + d * d)), "contrast": total(d * d), "dissimilarity": total(np.abs(d)),
        "entropy": -(p * np.log(np.where(p > 0, p, 1))).sum(axis=(1, 2)), "2nd_moment": square, "correlation": np.where(spread, (total(a * b) - ma * mb) / np.where(spread, va * vb, 1), 0),
    }


def _numbers(grids: dict[str, np.ndarray], suffix: str, sizes: list[int], windows: list[int], optical: tuple, methods: tuple) -> dict[str, np.ndarray]:
    """Every feature by its name, for the patches of all bands."""
    head, seen = f"{suffix}@", [b for b in grids if b in optical]
    out = {f"{head}{b}@{k}": v for b, g in grids.items() for k, v in _band_numbers(g).items()}
    mean = lambda x: np.nansum(x, axis=(1, 2)) / np.maximum(1, (~np.isnan(x)).sum(axis=(1, 2)))
    if {"R", "G", "B", "NIR"} <= set(seen):
        for k, a in enumerate(("R", "G", "B", "NIR")):
            for b in ("R", "G", "B", "NIR")[k + 1 :]:
                x, y = grids[a], grids[b]
                out[f"{head}spectral@ndi_{a}_{b}"] = mean(np.where(x + y == 0, 0, (x - y) / np.where(x + y == 0, 1, x + y)))
        out[f"{head}spectral@luminance"] = mean(0.2126 * grids["R"] + 0.7152 * grids["G"] + 0.0722 * grids["B"])
    for b in seen:
        for m in methods:
            out.update({f"{head}{b}@{m}@{k}@dmp": v for k, v in zip(sizes[1:], _profile(grids[b], sizes, m).T)})
        for w in windows:
            out.update({f"{head}{b}@w{w}@{k}": v for k, v in _texture_numbers(grids[b], w).items()})
    return out


def patch_features(wide: DataFrame, size: int, suffix: str, sizes: list[int], windows: list[int], bands: tuple = ("R", "G", "B", "NIR"), optical: tuple = ("R", "G", "B", "NIR"), methods: tuple = ("opening", "closing"), keys: tuple = ("patch_id",)) -> DataFrame:
    """keys, names, features: all features of a patch (keys and one array column a band) in the order of their names; infinite and missing values are 0.

    One pass over the rows: nothing is shuffled, and a batch of patches is worked on as arrays.
    """
    rows = wide.select(*keys, *[F.col(b).cast("array<double>").alias(b) for b in bands])
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "names array<string>, features array<double>"])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                grids = {}
                for k, band in enumerate(bands, len(keys)):
                    column = b.column(k)
                    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                    if column.null_count or len(values) != b.num_rows * size * size:
                        raise ValueError(f"{band}: not {size} x {size} values in every patch")
                    grids[band] = values.reshape(b.num_rows, size, size)
                found = _numbers(grids, suffix, sizes, windows, optical, methods)
                names = sorted(found)
                x = np.stack([found[n] for n in names], axis=1)
                x = np.where(np.isfinite(x), x, 0.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(names)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([names] * b.num_rows, pa.list_(pa.string())), lists], names=[*keys, "names", "features"])

    return rows.mapInArrow(run, schema)


def feature_names(size: int, suffix: str, sizes: list[int], windows: list[int], bands: tuple = ("R", "G", "B", "NIR"), optical: tuple = ("R", "G", "B", "NIR"), methods: tuple = ("opening", "closing")) -> list[str]:
    """The names of `patch_features`, in order."""
    one = _numbers({b: np.zeros((1, size, size)) for b in bands}, suffix, sizes, windows, optical, methods)
    return sorted(one)


def assemble_features(long: DataFrame, size: int, suffix: str, sizes: list[int], windows: list[int], optical: tuple = ("R", "G", "B", "NIR"), methods: tuple = ("opening", "closing"), bands: tuple = ("R", "G", "B", "NIR")) -> DataFrame:
    """patch_id, names, features from the long form: its cells meet once, as arrays (cells 0..size-1; missing ones are null)."""
    place = (F.col("i") * size + F.col("j")).cast("int")
    cells = long.groupBy("patch_id").agg(*[F.map_from_entries(F.collect_list(F.when((F.col("band") == b) & F.col("v").isNotNull(), F.struct(place.alias("p"), F.col("v"))))).alias(b) for b in bands])
    every = F.sequence(F.lit(0), F.lit(size * size - 1))

    def as_array(band: str) -> Column:
        return F.transform(every, lambda p: F.try_element_at(F.col(band), p)).alias(band)

    wide = cells.select("patch_id", *map(as_array, bands))
    return patch_features(wide, size, suffix, sizes, windows, bands, optical, methods)


def pick(table: dict, name: str):
    """Entry of a registry; users add their own entries, an unknown name is an error."""
    if name not in table:
        raise KeyError(f"unknown name {name!r}; known: {', '.join(table)}")
    return table[name]


FEATURES = {"statistics": STATISTICS, "morphology": MORPHOLOGY, "texture": TEXTURES}
