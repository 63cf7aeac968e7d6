"""Connected components of an edge table (large-star and small-star rounds; Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v; the aggregate combines on the map side, and a node with very many
    neighbours is a skewed side of an ordinary join, which is split at run time (never a broadcast: packed ids hide their number)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least.hint("merge"), "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the least node reachable, for every node of an edge that joins two nodes.

    Null ends and loops are left out; repeated edges count once; without edges the result is empty.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col(src).isNotNull() & F.col(dst).isNotNull()) & (F.col("u") != F.col("v"))).distinct()
    pairs = stored(pairs, "components")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _with_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = stored(small, "components")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
