"""Regression metrics and run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import stored
from .quantiles import quantiles


def r2(y: str = "y_true", p: str = "y_pred") -> Column:
    return 1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(p), 2)), F.var_pop(y) * F.count(y))


def rmse(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def mae(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def mse_loss(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.avg(F.pow(F.col(y) - F.col(p), 2))


def huber_loss(y: str = "y_true", p: str = "y_pred", beta: float = 1.0) -> Column:
    """Mean of d^2 / (2 beta) below beta and abs(d) - beta / 2 above."""
    d = F.abs(F.col(y) - F.col(p))
    return F.avg(F.when(d < beta, d * d / (2 * beta)).otherwise(d - beta / 2))


def multi_task_loss(losses: list[Column], log_variances: list[float] | None = None, weights: list[float] | None = None) -> Column:
    """Sum of 0.5 * exp(-s) * loss + 0.5 * s, or of weight * loss."""
    if weights is not None:
        return sum((c * w for c, w in zip(losses, weights)), F.lit(0.0))
    return sum((0.5 * F.exp(F.lit(-s)) * c + 0.5 * s for c, s in zip(losses, log_variances)), F.lit(0.0))


def quantile_profile(df: DataFrame, n: int = 20, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """q and the quantiles of truth and prediction."""
    got = quantiles(df, [y, p], [i / n for i in range(n + 1)])
    return df.sparkSession.createDataFrame([(i / n, t, v) for i, (t, v) in enumerate(zip(got[y], got[p]))], "q double, truth double, prediction double")


def quantile_confusion(df: DataFrame, n: int = 20, normed: bool = False, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """truth, prediction (class numbers 0..n+1 by quantiles of the truth) and count, or the share of the truth's class."""
    edges = [e for e in quantiles(df, [y], [i / n for i in range(n + 1)])[y] if e is not None]  # n + 1 numbers
    kind = lambda c: sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = df.groupBy(kind(y).alias("truth"), kind(p).alias("prediction")).agg(F.count("*").alias("n"))
    if not normed:
        return counts
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("truth"))).drop("n")  # (n + 2)^2 rows at most


def _error(log: bool, y: str, p: str) -> Column:
    return F.abs(F.ln(y) - F.ln(p)) if log else F.abs(F.col(y) - F.col(p))


def adaptive_deltas(df: DataFrame, alpha: float = 0.9, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """delta, log_delta: one row with the alpha quantile of the error, and of the error of logarithms."""
    got = quantiles(df.select(_error(False, y, p).alias("delta"), _error(True, y, p).alias("log_delta")), ["delta", "log_delta"], [alpha])
    return df.sparkSession.createDataFrame([(got["delta"][0], got["log_delta"][0])], "delta double, log_delta double")


def metrics(df: DataFrame, by: str = "var", y: str = "y_true", p: str = "y_pred", alpha: float = 0.9) -> DataFrame:
    """r2, rmse, mae, delta for each variable (a handful of names), and for all together (by is null)."""
    sums = stored(df.groupingSets([[F.col(by)], []], F.col(by)).agg(r2(y, p).alias("r2"), rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), F.count("*").alias("n"), F.grouping_id().alias("all")), "metrics")
    names = [r[0] for r in sums.filter("all = 0").select(by).limit(1_001).collect()]
    if len(names) > 1_000:
        raise ValueError("more than 1,000 variables; is the column a variable's name?")
    errors = [F.when(F.col(by).eqNullSafe(F.lit(v)), _error(False, y, p)).alias(f"e{i}") for i, v in enumerate(names)] + [_error(False, y, p).alias("every")]
    got = quantiles(df.select(*errors), [*(f"e{i}" for i in range(len(names))), "every"], [alpha])
    rows = [(v, 0, got[f"e{i}"][0]) for i, v in enumerate(names)] + [(None, 1, got["every"][0])]
    deltas = df.sparkSession.createDataFrame(rows, f"__v {df.schema[by].dataType.simpleString()}, __all int, delta double")
    same = (F.col("all") == F.col("__all")) & F.col(by).eqNullSafe(F.col("__v"))
    return sums.join(F.broadcast(deltas), same, "left").select(by, "r2", "rmse", "mae", "delta", "n")


def best_epochs(runs: DataFrame, metrics_of: list[str], run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Epochs whose metrics all beat the best so far of their run (a run's epochs are few rows)."""
    before = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    better = F.lit(True)
    for m in metrics_of:
        better = better & (F.col(m) > F.coalesce(F.max(m).over(before), F.lit(float("-inf"))))
    return runs.withColumn("better", better).filter("better").drop("better")


def best_run(runs: DataFrame, metric: str, run: str = "run_id") -> DataFrame:
    """The run, epoch and metric of the best row; ties go to the smaller run."""
    return runs.agg(F.min(F.struct((-F.col(metric)).alias("neg"), run, "epoch")).alias("b")).select(F.col(f"b.{run}").alias(run), "b.epoch", (-F.col("b.neg")).alias(metric))
