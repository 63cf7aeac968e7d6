"""Exact quantiles of whole columns: a sketch brackets each rank, and only values inside a bracket are sorted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import stored


def quantiles(df: DataFrame, values: list[str], qs: list[float], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """For each column its exact quantiles, linear between ranks, as `percentile` gives them; None for a column without values.  Nulls do not count.

    `percentile` keeps every distinct value of a column in one task.  Here a sketch gives two values around each rank, whatever the input's size;
    values outside such brackets are only counted, those inside (about 4 / accuracy of the rows for each quantile) are counted one by one.  The ranks
    asked for are checked against the counts; a bracket that misses one is an error.
    """
    table = stored(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)]), "values")
    near = 2.0 / accuracy
    ends = sorted({min(1.0, max(0.0, q + s)) for q in qs for s in (-near, near)})
    sketch = lambda v: F.percentile_approx(v, F.array(*[F.lit(float(e)) for e in ends]), F.lit(accuracy))
    got = table.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(values)) for n, f in (("s", sketch), ("n", F.count), ("a", F.min), ("z", F.max))]).first()
    brackets, parts = {}, []
    for i in range(len(values)):
        if not got[f"n{i}"]:
            continue
        at = {0.0: got[f"a{i}"], 1.0: got[f"z{i}"], **{e: s for e, s in zip(ends, got[f"s{i}"]) if 0.0 < e < 1.0}}
        brackets[i] = _merged(sorted((at[max(0.0, q - near)], at[min(1.0, q + near)]) for q in qs))
        v, slot, inside = F.col(f"v{i}"), F.lit(0), F.lit(False)
        for k, (lo, hi) in enumerate(brackets[i]):
            slot = F.when(v > hi, 2 * k + 2).when(v >= lo, 2 * k + 1).otherwise(slot)
            inside = inside | ((v >= lo) & (v <= hi))
        parts.append(F.struct(F.lit(i).alias("i"), slot.alias("slot"), F.when(inside, v).alias("v"), v.isNotNull().alias("there")))
    if not parts:
        return {c: [None] * len(qs) for c in values}
    counts = table.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("there").groupBy("i", "slot", "v").agg(F.count("*").alias("n"))
    counts = stored(counts, "counts")
    # the only windows: sums over slots, few numbers, and inside a slot, which holds a bracket's distinct values
    slots = counts.groupBy("i", "slot").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("i").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = slots.select("i", "slot", before.alias("b"))
    run = F.sum("n").over(W.partitionBy("i", "slot").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.filter("v is not null").withColumn("e", run).join(begun, ["i", "slot"]).select("i", "v", (F.col("b") + F.col("e") - F.col("n")).alias("first"), (F.col("b") + F.col("e")).alias("end"))
    ranks = {(i, r) for i in brackets for q in qs for r in _ranks(q, got[f"n{i}"])}
    asked = df.sparkSession.createDataFrame(sorted(ranks), "i int, r long")
    found = {(r.i, r.r): r.v for r in ranked.join(F.broadcast(asked), "i").filter("r >= first and r < end").select("i", "r", "v").collect()}
    out = {}
    for i, c in enumerate(values):
        out[c] = [_between(found, i, q, got[f"n{i}"]) if i in brackets else None for q in qs]
    return out


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets that meet as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in brackets:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _ranks(q: float, n: int) -> tuple[int, int]:
    place = q * (n - 1)
    return math.floor(place), math.ceil(place)


def _between(found: dict, i: int, q: float, n: int) -> float:
    lo, hi = _ranks(q, n)
    if (i, lo) not in found or (i, hi) not in found:
        raise RuntimeError(f"rank {lo} or {hi} of {n} lies outside its bracket")
    a, b, place = found[i, lo], found[i, hi], q * (n - 1)
    return a if lo == hi or a == b else (hi - place) * a + (place - lo) * b
