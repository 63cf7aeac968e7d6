import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from urbangrid.sources.fixtures import SELECTS, load
from urbangrid.operators.composite import composite, merge_sketches, sketch_composite, sketch_percentile
from urbangrid.streaming.composites import compact_sketches, kept_sketches, running_mean, running_sketches


def test_stream_equals_table(spark, sf_dir, tmp_path):
    assert "f1" in SELECTS
    px = load(spark, sf_dir, "events").select(F.col("event_type").alias("band"), F.floor(F.col("user_id") / 10).alias("y"), (F.col("user_id") % 10).alias("x"), "value")
    px.repartition(3).write.parquet(f"file://{tmp_path}/px")
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/px")
    q = running_mean(stream).writeStream.outputMode("complete").format("memory").queryName("running_mean").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = lambda df: sorted((r.band, r.y, r.x, round(r.value, 9), r.n) for r in df.collect())
    assert rows(spark.table("running_mean")) == rows(running_mean(px))


def _values(df):
    return sorted((r.band, r.y, r.x, r.value) for r in df.collect())


def test_sketches_of_a_stream_equal_one_build(spark, tmp_path):
    px = spark.range(6000).select(F.lit("B").alias("band"), (F.col("id") % 3).alias("y"), (F.col("id") % 5).alias("x"), (F.hash("id") % 1000).cast("double").alias("value"))
    (tmp_path / "px").mkdir()
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/px")
    path = f"file://{tmp_path}/state"

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/px")
        q = running_sketches(stream, path).option("checkpointLocation", f"file://{tmp_path}/at").start()
        q.processAllAvailable()
        q.stop()

    parts = [px.filter(F.floor(F.col("id") / 1500) == k) for k in range(4)]
    arrive(parts[0])
    assert compact_sketches(spark, path) == -1  # the only batch may not be whole
    arrive(parts[1])
    arrive(parts[2])
    assert compact_sketches(spark, path) == 1
    arrive(parts[3])
    want = _values(sketch_percentile(sketch_composite(px)))
    assert _values(sketch_percentile(kept_sketches(spark, path))) == want
    assert compact_sketches(spark, path) == 2 and compact_sketches(spark, path) == 2
    assert _values(sketch_percentile(kept_sketches(spark, path))) == want
    # a batch that runs again replaces itself
    again = sketch_composite(parts[3])
    again.write.mode("overwrite").parquet(f"{path}/batches/batch=3")
    assert _values(sketch_percentile(kept_sketches(spark, path))) == want
    exact = {r[:3]: r[3] for r in _values(composite(px))}
    assert all(abs(v - exact[(b, y, x)]) < 12 for b, y, x, v in want)


def test_rank_error_of_merged_sketches(spark):
    """200,000 values of one cell in 20 tables: ranks within 1.6 / k."""
    k = 128
    rng = np.random.default_rng(5)
    values = np.exp(rng.normal(size=200_000))
    px = spark.createDataFrame(pd.DataFrame({"band": "B", "y": 0, "x": 0, "value": values, "part": np.arange(len(values)) % 20}))
    built = [sketch_composite(px.filter(F.col("part") == n), k) for n in range(20)]
    got = sketch_percentile(merge_sketches(*built, k=k), [5.0, 25.0, 50.0, 75.0, 95.0]).first().value
    ranks = np.searchsorted(np.sort(values), got, side="right") / len(values)
    assert np.abs(ranks - [0.05, 0.25, 0.5, 0.75, 0.95]).max() < 1.6 / k


def test_sketches_of_nulls_ties_and_empty_tables(spark):
    rows = [("B", 0, 0, None), ("B", 0, 1, float("nan")), ("B", 0, 1, 2.0), ("B", 1, 1, 5.0), ("B", 1, 1, 5.0), (None, 1, None, 3.0)]
    px = spark.createDataFrame(rows, "band string, y long, x long, value double")
    kept = merge_sketches(sketch_composite(px), sketch_composite(px.limit(0)), sketch_composite(px))
    got = {(r.band, r.y, r.x): r.value for r in sketch_percentile(kept).collect()}
    assert got == {("B", 0, 0): None, ("B", 0, 1): 2.0, ("B", 1, 1): 5.0, (None, 1, None): 3.0}
    assert sketch_percentile(sketch_composite(px.limit(0))).count() == 0
