"""Composites that grow with arriving scenes.

A mean is kept as a sum and a count for each band and cell, so late scenes only add to it; a percentile is kept as a quantile sketch, which merges alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.composite import SKETCH_K, merge_sketches, sketch_composite


def running_mean(px: DataFrame, watermark: str | None = None, time: str = "acquired") -> DataFrame:
    """band, y, x, value, n from a stream (or a table) of pixels.

    State is a sum and a count for each band and cell, so it grows with the raster and not with time.  The groups have no time, so a watermark neither drops
    late scenes nor clears state here; it only passes an event time on.
    """
    if watermark:
        px = px.withWatermark(time, watermark)
    return px.filter(F.col("value").isNotNull()).groupBy("band", "y", "x").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def running_sketches(px: DataFrame, path: str, k: int = SKETCH_K) -> DataStreamWriter:
    """A writer that keeps the sketches of each batch of a stream of pixels under path (start it with a checkpointLocation).

    A batch writes the cells it touches and nothing else; one that runs again after a failure writes its own folder again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        sketch_composite(batch, k).write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    return px.writeStream.foreachBatch(keep)


def kept_sketches(spark: SparkSession, path: str, k: int = SKETCH_K) -> DataFrame:
    """band, y, x, sketch of all batches so far: the last compacted table and the batches after it."""
    upto = _compacted(spark, path)
    later = spark.read.parquet(f"{path}/batches").filter(F.col("batch") > upto)
    parts = [later] if upto < 0 else [spark.read.parquet(f"{path}/upto-{upto}"), later]
    return merge_sketches(*parts, k=k)


def compact_sketches(spark: SparkSession, path: str, k: int = SKETCH_K) -> int:
    """Merges what is kept into one table and returns the last batch in it; readers turn to it when it is whole.

    The newest batch may still be on its way to the folder (batches are written one after another), so it is left for the next time.
    """
    newest = spark.read.parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    last = -1 if newest is None else int(newest) - 1
    upto = _compacted(spark, path)
    if last <= upto:
        return upto
    new = spark.read.parquet(f"{path}/batches").filter((F.col("batch") > upto) & (F.col("batch") <= last))
    parts = [new] if upto < 0 else [spark.read.parquet(f"{path}/upto-{upto}"), new]
    merge_sketches(*parts, k=k).write.mode("overwrite").parquet(f"{path}/upto-{last}")
    spark.createDataFrame([(last,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/compacted")
    return last


def _compacted(spark: SparkSession, path: str) -> int:
    """The last batch of the newest compacted table, -1 before there is one."""
    from pyspark.errors import AnalysisException

    try:
        return int(spark.read.schema("upto long").parquet(f"{path}/compacted").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
