"""Preparing features, fitting models, scoring patches, and maps from them.

Fitted parameters are single rows or Spark ML models; no table of samples reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..sources.io import mosaic
from ..sources.shared import stored
from .boosting import BoostedTrees, fit_boosted_trees
from .composite import composite
from .curves import fit_power
from .features import feature_names, patch_features
from .grid import check_extent, clip_raster
from .patches import assemble_patches, fill_nan_nearest, rescale_band


# ---------------------------------------------------------------- preparation
def variance_filter(df: DataFrame, cols: list[str], least: float = 1e-6) -> list[str]:
    """Names of columns with a population variance above `least`."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > least]


@dataclass
class Scaler:
    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.lit(self.means[c]), F.lit(self.stds[c])), F.lit(0.0)) for c in self.means})


def standardise(df: DataFrame, cols: list[str]) -> Scaler:
    """(x - mean) / population deviation."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return Scaler({c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})


@dataclass
class Preprocessors:
    """Fitted filter, scaler and projection; the largest loading of each component is positive."""

    cols: list[str]
    scaler: Scaler
    projection: object
    signs: list[float]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        scaled = VectorAssembler(inputCols=self.cols, outputCol="__v").transform(self.scaler.transform(df))
        with_pca = self.projection.transform(scaled)
        signs = F.array(*map(F.lit, self.signs))
        return with_pca.withColumn(out, array_to_vector(F.zip_with(vector_to_array("__pca"), signs, lambda v, s: v * s))).drop("__v", "__pca")


def fit_preprocessors(df: DataFrame, cols: list[str], k: int) -> Preprocessors:
    kept = variance_filter(df, cols)
    scaler = standardise(df, kept)
    scaled = VectorAssembler(inputCols=kept, outputCol="__v").transform(scaler.transform(df))
    model = PCA(k=min(k, len(kept)), inputCol="__v", outputCol="__pca").fit(scaled)
    loadings = model.pc.toArray()
    return Preprocessors(kept, scaler, model, [float(np.sign(c[np.abs(c).argmax()]) or 1.0) for c in loadings.T])


# ---------------------------------------------------------------- curve model
def vvh_fit(df: DataFrame, x: str = "vvh", y: str = "h", lo: float = -10.0, hi: float = 10.0, points: int = 41, rounds: int = 40, bound: float = 100.0) -> dict[str, float]:
    """a, b, c of y = a * x^b + c by least squares; a and c stay within +-bound, b within lo..hi (see curves.fit_power)."""
    return fit_power(df, x, y, lo, hi, points, rounds, bound)


def vvh_predict(x, p: dict[str, float]) -> Column:
    return F.lit(p["a"]) * F.pow(S._c(x), F.lit(p["b"])) + p["c"]


# ---------------------------------------------------------------- learners
def fit_rf(df: DataFrame, n: int = 100, depth: int = 8, label: str = "label", features: str = "features", seed: int = 0):
    return RandomForestRegressor(numTrees=n, maxDepth=depth, labelCol=label, featuresCol=features, seed=seed).fit(df)


def fit_gbt(df: DataFrame, n: int = 50, depth: int = 5, gamma: float = 0.0, rate: float = 0.1, label: str = "label", features: str = "features", l2: float = 1.0, **options) -> BoostedTrees:
    """Boosted trees with least gain gamma and L2 term l2 (see boosting.fit_boosted_trees)."""
    return fit_boosted_trees(df, n, depth, gamma, rate, l2, label, features, **options)


def _fourier(n_cols: int, d_rff: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions, phases and scale of random Fourier features of a Gaussian kernel."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / width, (d_rff, n_cols)), rng.uniform(0, 2 * math.pi, d_rff), math.sqrt(2 / d_rff)


def fit_bagged_kernel(df: DataFrame, cols: list[str], n: int = 10, frac: float = 0.2, width: float = 1.0, ridge: float = 1e-2, d_rff: int = 256, piece_rows: int = 2000, label: str = "label", id_col: str = "sample_id", seed: int = 0) -> DataFrame:
    """bag, mean, weights: kernel ridge regression for each of n bags, a bag holding about the share `frac` of all rows.

    A hash puts each row into its bags, and a second one cuts a bag into pieces of about piece_rows rows: a piece is fitted alone, in random Fourier
    features of the kernel (made once for a row, whatever its bags), and the pieces' weights are averaged by their rows.  So all rows of a bag are used, a
    fit is bounded in memory, and the model has n * d_rff numbers whatever the table's size.
    """
    w, b, scale = _fourier(len(cols), d_rff, width, seed)
    pieces = max(1, math.ceil(df.count() * frac / piece_rows))
    xs, bags = [f"x{i}" for i in range(len(cols))], [f"in{k}" for k in range(n)]  # plain columns: an array would be a Python object for each row
    into = [F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(k)), F.lit(1_000_000)) < int(frac * 1_000_000) for k in range(n)]
    rows = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)], F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(-1)), F.lit(pieces)).alias("piece"), *[i.alias(c) for i, c in zip(into, bags)])
    rows = rows.filter(reduce(lambda p, q: p | q, map(F.col, bags), F.lit(False)))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces // 32)  # a number of its own is not coalesced: small rows, dear fits
    rows = rows.repartition(min(pieces, tasks), "piece")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, held = pdf[xs].to_numpy(float), pdf["y"].to_numpy(float), pdf[bags].to_numpy(bool)
        found = np.flatnonzero(held.any(axis=0))
        means = {k: y[held[:, k]].mean() for k in found}
        gram, right = {k: ridge * np.eye(d_rff) for k in found}, {k: np.zeros(d_rff) for k in found}
        for at in range(0, len(y), piece_rows):
            part = slice(at, at + piece_rows)
            z = scale * np.cos(x[part] @ w.T + b)
            for k in found:
                mine = held[part, k]
                zk = z[mine]
                gram[k] += zk.T @ zk
                right[k] += zk.T @ (y[part][mine] - means[k])
        return pd.DataFrame({"bag": found.astype(np.int32), "n": [int(held[:, k].sum()) for k in found], "parts": [[means[k], *np.linalg.solve(gram[k], right[k]).tolist()] for k in found]})

    parts = rows.groupBy("piece").applyInPandas(fit, "bag int, n long, parts array<double>").select("bag", "n", F.posexplode("parts").alias("p", "v"))
    one = parts.groupBy("bag", "p").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    both = one.groupBy("bag").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("v"))
    return both.select("bag", F.col("v")[0].alias("mean"), F.slice("v", 2, d_rff).alias("weights"))


def predict_bagged_kernel(df: DataFrame, bags: DataFrame, cols: list[str], width: float = 1.0, seed: int = 0) -> DataFrame:
    """Adds prediction: mean over the bags (the fitted model, n rows of d_rff numbers, is sent to the workers)."""
    model = [(r["mean"], np.array(r.weights)) for r in bags.collect()]
    mean = float(np.mean([m for m, _ in model])) if model else 0.0
    weights = np.mean([w for _, w in model], axis=0) if model else np.zeros(1)  # linear in the weights, so bags can be averaged before
    sent = df.sparkSession.sparkContext.broadcast((mean, weights, *_fourier(len(cols), len(weights), width, seed)))

    @F.pandas_udf("double")
    def predict(*x: pd.Series) -> pd.Series:
        mean, weights, w, b, scale = sent.value
        at = np.stack([c.to_numpy(float) for c in x], axis=1)
        out = [mean + scale * np.cos(at[k : k + 10_000] @ w.T + b) @ weights for k in range(0, len(at), 10_000)]
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return df.withColumn("prediction", predict(*[F.col(c).cast("double") for c in cols]))


def fourier_features(df: DataFrame, cols: list[str], d_rff: int = 64, width: float = 1.0, seed: int = 0, out: str = "features") -> DataFrame:
    """Adds random Fourier features of a Gaussian kernel."""
    w, b, scale = _fourier(len(cols), d_rff, width, seed)
    one = lambda k: F.cos(sum((F.col(c) * float(w[k, i]) for i, c in enumerate(cols)), F.lit(float(b[k])))) * scale
    return df.withColumn(out, array_to_vector(F.array(*[one(k) for k in range(d_rff)])))


@dataclass
class KernelRegression:
    """Weights of random Fourier features, intercept and the scale of the errors; transform reads the columns themselves."""

    cols: list[str]
    width: float
    seed: int
    weights: np.ndarray
    intercept: float
    scale: float

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        model, fourier = self, _fourier(len(self.cols), len(self.weights), self.width, self.seed)

        @F.pandas_udf("double")
        def predict(*x: pd.Series) -> pd.Series:
            w, b, scale = fourier
            at = np.stack([c.to_numpy(float) for c in x], axis=1)
            parts = [model.intercept + scale * np.cos(at[k : k + 10_000] @ w.T + b) @ model.weights for k in range(0, len(at), 10_000)]
            return pd.Series(np.concatenate(parts) if parts else np.empty(0))

        return df.withColumn(out, predict(*[F.col(c).cast("double") for c in self.cols]))


def fit_kernel(df: DataFrame, d_rff: int = 64, width: float = 1.0, cols: list[str] = (), label: str = "label", seed: int = 0, epsilon: float = 1.35, steps: int = 50, tol: float = 1e-9) -> KernelRegression:
    """Kernel regression on all rows: random Fourier features and a linear model with Huber loss, whose scale is fitted as well (Owen 2007).

    Newton steps on the convex loss that Spark ML's huber regression minimises, each one aggregate of loss, slope and curvature, d_rff^2 numbers whatever
    the number of rows; features are made batch by batch and never kept.  A step that does not lower the loss is halved.
    Rows without label or with a missing value take no part.
    """
    cols, k = list(cols), d_rff + 2  # weights, intercept, scale
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y"))
    rows = rows.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in rows.columns)))
    w, b, scale = _fourier(len(cols), d_rff, width, seed)

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            total, sigma = np.zeros(1 + k + k * k), at[-1]
            for batch in batches:
                x = np.stack([batch.column(i).to_numpy() for i in range(len(cols))], axis=1)
                z = np.concatenate([scale * np.cos(x @ w.T + b), np.ones((len(x), 1))], axis=1)
                r = batch.column(len(cols)).to_numpy() - z @ at[:-1]
                near = np.abs(r) <= epsilon * sigma
                q = r[near] / sigma
                far = np.abs(r[~near])
                slope = np.where(near, -2 * r / sigma, -2 * epsilon * np.sign(r))
                zn = z[near]
                total[0] += len(r) * sigma + sigma * (q @ q) + (2 * epsilon * far - epsilon**2 * sigma).sum()
                total[1:k] += z.T @ slope
                total[k] += len(r) - q @ q - epsilon**2 * len(far)
                bend = np.empty((k, k))
                bend[:-1, :-1] = 2 / sigma * (zn.T @ zn)
                bend[-1, :-1] = bend[:-1, -1] = 2 / sigma * (zn.T @ q)
                bend[-1, -1] = 2 / sigma * (q @ q)
                total[1 + k :] += bend.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["slot", "v"])

        got = rows.mapInArrow(run, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(1 + k + k * k)
        out[got.column("slot").to_numpy()] = got.column("v").to_numpy()
        return float(out[0]), out[1 : 1 + k], out[1 + k :].reshape(k, k)

    start = rows.agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("dev")).first()
    at = np.zeros(k)
    at[-2:] = start.mean or 0.0, start.dev or 0.0
    if not start.dev:  # no rows, or one value
        return KernelRegression(cols, width, seed, at[:-2], float(at[-2]), 0.0)
    loss, slope, bend = sums(at)
    for _ in range(steps):
        step = -np.linalg.lstsq(bend + 1e-12 * np.trace(bend) / k * np.eye(k), slope, rcond=None)[0]
        if at[-1] + step[-1] < at[-1] / 4:
            step *= -0.75 * at[-1] / step[-1]
        if -slope @ step <= tol * loss:
            break
        for _ in range(20):
            new = sums(at + step)
            if new[0] < loss:
                break
            step = step / 2
        else:
            break
        at, (loss, slope, bend) = at + step, new
    return KernelRegression(cols, width, seed, at[:-2], float(at[-2]), float(at[-1]))


# ---------------------------------------------------------------- selection
def folds(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds fold: n contiguous folds in the given order."""
    from ..sources.io import keyed_samples

    total = df.count()
    return keyed_samples(df, order).withColumn("fold", F.floor(F.col("key") * n / total).cast("int")).drop("key")


def grid_search_vvh(df: DataFrame, gammas: list[float], n_folds: int = 10, order: tuple = ("sample_id",), points: int = 21) -> DataFrame:
    """gamma, fold, r2: for each gamma and fold, the curve fitted on the other folds and scored on it.

    Sums of every (gamma, b, fold) come from one aggregate; a fold's training sums are all sums minus its own.
    """
    bs = [float(b) for b in np.linspace(-3, 3, points) if abs(b) > 1e-9]
    pre = folds(df, n_folds, list(order))
    long = pre.select("fold", "h", F.explode(F.array(*[F.struct(F.lit(g).alias("gamma"), S.vvh("vv", "vh", g).alias("x")) for g in gammas])).alias("s")).select("fold", "h", "s.*")
    z = long.select("fold", "gamma", "h", F.explode(F.array(*map(F.lit, bs))).alias("b"), "x").withColumn("z", F.pow(F.col("x"), F.col("b")))
    sums = z.groupBy("gamma", "b", "fold").agg(F.count("*").alias("n"), F.sum("z").alias("sz"), F.sum("h").alias("sh"), F.sum(F.col("z") * F.col("z")).alias("szz"), F.sum(F.col("z") * F.col("h")).alias("szh"), F.sum(F.col("h") * F.col("h")).alias("shh"))
    every = W.partitionBy("gamma", "b")  # as many rows as folds
    names = ("n", "sz", "sh", "szz", "szh", "shh")
    t = sums.select("gamma", "b", "fold", *names, *[(F.sum(c).over(every) - F.col(c)).alias(f"t_{c}") for c in names])
    a = F.try_divide(F.col("t_n") * F.col("t_szh") - F.col("t_sz") * F.col("t_sh"), F.col("t_n") * F.col("t_szz") - F.pow(F.col("t_sz"), 2))
    t = t.withColumn("a", a).withColumn("c", (F.col("t_sh") - F.col("a") * F.col("t_sz")) / F.col("t_n"))
    sse = lambda p: F.col(f"{p}shh") + F.col("a") ** 2 * F.col(f"{p}szz") + F.col("c") ** 2 * F.col(f"{p}n") - 2 * F.col("a") * F.col(f"{p}szh") - 2 * F.col("c") * F.col(f"{p}sh") + 2 * F.col("a") * F.col("c") * F.col(f"{p}sz")
    best = t.filter("a is not null").withColumn("train", sse("t_")).withColumn("test", sse("")).groupBy("gamma", "fold").agg(F.min(F.struct("train", "b", "test", "n", "sh", "shh")).alias("m"))
    return best.select("gamma", "fold", (1 - F.try_divide(F.col("m.test"), F.col("m.shh") - F.pow(F.col("m.sh"), 2) / F.col("m.n"))).alias("r2"))


def grid_search(df: DataFrame, estimator, grid: list[dict], n_folds: int = 10, order: tuple = ("sample_id",), label: str = "label"):
    """Spark ML cross-validation over contiguous folds, by R2.

    Only what the model and the folds read is dealt, and written once; Spark ML keeps a copy of each fold's rows in memory or on disk (`search` does not).
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="r2"), numFolds=n_folds, foldCol="fold")
    used = {label, estimator.getFeaturesCol(), *order}
    return cv.fit(stored(folds(df.select(*[c for c in df.columns if c in used]), n_folds, list(order)), "folds").drop(*(set(order) - {label})))


def search(df: DataFrame, fit: Callable, grid: list[dict[str, float]], n_folds: int = 10, order: tuple = ("sample_id",), label: str = "label", at_once: int = 2) -> DataFrame:
    """The parameters, fold, r2 for each parameter set of the grid and each of the contiguous folds.

    fit(train, **parameters) gives a function that adds prediction to a table, so any learner can be searched: forests, boosted trees, bags, or
    one of the caller's.  Folds are written once; a fit is a distributed job of its own and `at_once` of them run side by side.  Rows without a label
    or a prediction are not scored; a fold with less than two different labels has no r2.  Names of parameters must not be those of fold and r2.
    A table that has the column fold is taken as dealt, so that several learners share one dealing.
    """
    from multiprocessing.pool import ThreadPool

    if any(set(g) != set(grid[0]) or {"fold", "r2"} & set(g) for g in grid):
        raise ValueError("parameter sets must have the same names, and none of them fold or r2")
    dealt = df if "fold" in df.columns else stored(folds(df, n_folds, list(order)), "folds")
    miss = F.col(label) - F.col("prediction")
    y = F.col("y")
    total = F.sum(y * y) - F.pow(F.sum(y), 2) / F.count(y)

    def score(job):
        params, k = job
        scored = fit(dealt.filter(F.col("fold") != k).drop("fold"), **params)(dealt.filter(F.col("fold") == k).drop("fold"))
        # not filtered: a filter on the prediction is pushed below it, and the model would run twice on each row
        row = scored.select(miss.alias("miss"), F.when(miss.isNotNull(), F.col(label)).alias("y")).agg(F.sum(F.col("miss") * F.col("miss")).alias("sse"), F.min(y).alias("lo"), F.max(y).alias("hi"), total.alias("sst")).first()
        r2 = 1 - row.sse / row.sst if row.lo is not None and row.lo < row.hi else None
        return (*[float(params[n]) for n in grid[0]], k, r2)

    with ThreadPool(at_once) as pool:
        rows = pool.map(score, [(g, k) for g in grid for k in range(n_folds)], chunksize=1) if grid else []
    names = [*(f"`{n}` double" for n in (grid[0] if grid else [])), "fold int", "r2 double"]
    return df.sparkSession.createDataFrame(rows, ", ".join(names))


def cv_report(scores: DataFrame, params: list[str], score: str = "r2") -> DataFrame:
    """Mean, population deviation and rank of each parameter set (a row for each)."""
    one = scores.groupBy(*params).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return one.withColumn("rank", F.rank().over(W.orderBy(F.desc(F.round("mean", 12)))))


# ---------------------------------------------------------------- scoring and maps
def score_patches(df: DataFrame, make_predict_fn: Callable, patch: str = "features", batch_size: int = 1024, outputs: tuple = ("prediction",), width: int | None = None) -> DataFrame:
    """Adds the outputs of a user's model; make_predict_fn runs once in a worker and returns a function of a batch (rows, values).

    width: values in a patch; where not given, the first patch is asked.
    """
    kind = T.DoubleType() if len(outputs) == 1 else T.StructType([T.StructField(o, T.DoubleType()) for o in outputs])
    if width is None:
        first = df.filter(F.col(patch).isNotNull()).select(F.size(patch)).first()
        width = first[0] if first else 1
    run = predict_batch_udf(make_predict_fn, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[int(width)]])
    out = df.withColumn("__p", run(patch))
    return out.withColumnRenamed("__p", outputs[0]) if len(outputs) == 1 else out.select(*df.columns, *[F.col(f"__p.{o}").alias(o) for o in outputs])


def predict_vvh(px: DataFrame, centers: DataFrame, params: dict[str, float], size: int, gamma: float = 5.0, log: bool = True, extent: tuple | None = None, fill: bool = False) -> DataFrame:
    """cy, cx, height from mean coefficients of VV and VH patches and the fitted curve.

    extent (y_min, x_min, y_max, x_max): both bands must cover it, cells beyond its windows are not read, and centres are those within.  fill: holes take
    the nearest value of their band, and windows over the border the nearest in the window; else means are over the cells that are there.
    """
    px, centers = _clipped(px.filter(F.col("band").isin("VV", "VH")), centers, size, extent)
    if fill:
        px = fill_nan_nearest(px, keys=("band",))
    mean = lambda c: F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, v: F.struct((a["s"] + S.backscatter(v)).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))
    cut = assemble_patches(centers, [(px, ["VV", "VH"])], size, fill=fill).select("cy", "cx", mean("VV").alias("vv"), mean("VH").alias("vh"))
    h = vvh_predict(S.vvh("vv", "vh", gamma), params)
    return cut.select("cy", "cx", (F.exp(h) if log else h).alias("height"))


def predict_ml(features: DataFrame, prepared: Preprocessors, model, log: bool = True) -> DataFrame:
    """Rows with height: fitted preparation and model on a feature table."""
    out = model.transform(prepared.transform(features))
    return out.withColumn("height", F.exp("prediction") if log else F.col("prediction"))


def feature_columns(px: DataFrame, centers: DataFrame, size: int, bands: list[str], sizes: list[int], windows: list[int], suffix: str = "50pt", extent: tuple | None = None) -> DataFrame:
    """cy, cx and a column for each patch feature of the windows around the centres: clip, fill, rescale, cut, features."""
    rows = patch_features(_windows(px, centers, size, bands, extent), size, suffix, sizes, windows, tuple(bands), tuple(bands), keys=("cy", "cx"))
    names = feature_names(size, suffix, sizes, windows, tuple(bands), tuple(bands))
    return rows.select("cy", "cx", *[F.col("features")[k].alias(n) for k, n in enumerate(names)])


def predict_ml_map(px: DataFrame, centers: DataFrame, prepared: Preprocessors, model, size: int, bands: list[str], sizes: list[int], windows: list[int], suffix: str = "50pt", extent: tuple | None = None, log: bool = True) -> DataFrame:
    """cy, cx, height: pixels to heights in one plan."""
    return predict_ml(feature_columns(px, centers, size, bands, sizes, windows, suffix, extent), prepared, model, log).select("cy", "cx", "height")


def _clipped(px: DataFrame, centers: DataFrame, size: int, extent: tuple | None) -> tuple[DataFrame, DataFrame]:
    """Cells of the extent's windows and centres within it; an error where a band does not cover it."""
    if not extent:
        return px, centers
    y0, x0, y1, x1 = extent
    metas = px.groupBy("band").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
    box = check_extent(metas, (x0, y0, x1, y1)).first()
    if box is None or not box.covers:
        raise ValueError("the bands do not cover the extent")
    return clip_raster(px, extent, size), centers.filter(F.col("cy").between(y0, y1) & F.col("cx").between(x0, x1))


def _windows(px: DataFrame, centers: DataFrame, size: int, bands: list[str], extent: tuple | None) -> DataFrame:
    """cy, cx and an array for each band: clip (all bands must cover the extent), fill holes, rescale, cut, fill windows over the border."""
    px, centers = _clipped(px.filter(F.col("band").isin(*bands)), centers, size, extent)
    scaled = rescale_band(stored(fill_nan_nearest(stored(px, "cells"), keys=("band",)), "filled"))  # both are read several times
    cut = assemble_patches(centers, [(scaled, bands)], size, fill=True)
    whole = lambda b: F.transform(b, lambda v: F.coalesce(v, F.lit(0.0))).alias(b)
    return cut.select("cy", "cx", *map(whole, bands))


def _feature_rows(px: DataFrame, centers: DataFrame, size: int, bands: list[str], extent: tuple | None) -> DataFrame:
    cut = _windows(px, centers, size, bands, extent)
    parts = [F.transform(b, lambda v: S.quantise(v)) for b in bands]
    return cut.select("cy", "cx", F.concat(*parts).alias("features"))


def predict_single(px: DataFrame, centers: DataFrame, make_predict_fn: Callable, size: int, bands: list[str], extent: tuple | None = None, lo: float = 0.0, hi: float = 1000.0, log: bool = False) -> DataFrame:
    """cy, cx, value: clip, fill, rescale, patches, quantise, model, clamp in one plan."""
    scored = score_patches(_feature_rows(px, centers, size, bands, extent), make_predict_fn, width=len(bands) * size * size)
    value = F.exp("prediction") if log else F.col("prediction")
    return scored.select("cy", "cx", S.clamp_output(value, lo, hi).alias("value"))


def predict_multi(px: DataFrame, centers: DataFrame, make_predict_fn: Callable, size: int, bands: list[str], extent: tuple | None = None, h_max: float = 1000.0, f_max: float = 1.0) -> DataFrame:
    """cy, cx, footprint, height from a model with two outputs."""
    scored = score_patches(_feature_rows(px, centers, size, bands, extent), make_predict_fn, outputs=("footprint", "height"), width=len(bands) * size * size)
    return scored.select("cy", "cx", S.clamp_output("footprint", 0.0, f_max).alias("footprint"), S.clamp_output("height", 0.0, h_max).alias("height"))


def tiled_map(obs: DataFrame, centers: DataFrame, make_predict_fn: Callable, size: int, bands: list[str], block: int = 100, max_cloud: float = 20.0, h_min: float = 0.0, h_max: float = 1000.0) -> DataFrame:
    """region_y, region_x, variable, y, x, value: from observations (scene_id, band, y, x, value, cloud) to a merged map in one plan.

    Clear observations give a median composite; windows around the centres are cut from it (cells that are missing take the nearest value of the
    window; a centre without any value of a band is left out), scored and clamped; the sub-regions, blocks of block x block cells, are rasters of
    their own that the mosaic merges.
    """
    px = composite(obs.filter(F.col("band").isin(*bands) & (F.col("cloud") < max_cloud)), p=50)
    cut = assemble_patches(centers, [(px, bands)], size, fill=True)
    whole = F.forall(F.concat(*bands), lambda v: v.isNotNull())
    scored = score_patches(cut.filter(whole).select("cy", "cx", F.concat(*bands).alias("features")), make_predict_fn, outputs=("footprint", "height"), width=len(bands) * size * size)
    both = F.explode(F.array(F.struct(F.lit("footprint").alias("variable"), S.clamp_output("footprint", 0.0, 1.0, "min").alias("value")), F.struct(F.lit("height").alias("variable"), S.clamp_output("height", h_min, h_max, "min").alias("value")))).alias("s")
    region = [F.floor(F.col(c) / block).alias(r) for c, r in (("cy", "region_y"), ("cx", "region_x"))]
    regions = scored.select(*region, F.col("cy").alias("y"), F.col("cx").alias("x"), both).select("region_y", "region_x", "s.variable", "y", "x", "s.value")
    return mosaic(regions, by=("region_y", "region_x", "variable", "y", "x"))
