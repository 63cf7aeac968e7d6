import re

import pytest
from pyspark.sql import functions as F

from urbangrid.schemas import grid
from urbangrid.sources import io, store


def _rows(spark, n=1000):
    cells = lambda c: F.array(*[F.col(c) + k for k in range(4)]).cast("array<double>")
    df = spark.range(n).select((F.lit(n - 1) - F.col("id")).alias("sample_id"), (F.col("id") % 7).alias("a"))
    return df.select("sample_id", cells("a").alias("VV"), cells("sample_id").alias("R"), cells("a").alias("DEM"), F.col("sample_id").cast("double").alias("height"))


def _written(spark, path, span=100):
    assert store.write_store(store.stack_samples(_rows(spark), ["VV"], ["R"], ["DEM"], ["height"]), path, ["sample_id"], span) == 1000
    return path


def test_bands_lie_side_by_side_in_each_cell(spark):
    df = spark.createDataFrame([(1, [0.0, None, -10.0], [1.0, 2.0, 3.0], 4.0), (2, [0.0], [1.0, 2.0], None), (3, None, [1.0], 1.0), (4, [], [], 0.0)], "id int, VV array<double>, R array<double>, h double")
    got = {r.id: (r.bands and [None if v is None else round(v, 3) for v in r.bands], r.targets) for r in store.stack_samples(df, ["VV"], ["R"], [], ["h"]).collect()}
    assert got[1] == ([255.0, 0.026, None, 0.051, 25.5, 0.077], [4.0])
    assert got[2] == (None, [None]) and got[3] == (None, [1.0])
    assert got[4][0] == []
    with pytest.raises(ValueError):
        store.stack_samples(df.withColumn("bands", F.lit(1)), ["VV"], ["R"], [], ["h"])


def test_aux_bands_in_the_order_of_their_names(spark):
    df = spark.createDataFrame([([1.0], [2.0], [3.0])], "VV array<double>, z array<double>, b array<double>")
    assert store.stack_samples(df, ["VV"], [], ["z", "b"], []).first().aux == [[3.0], [2.0]]


def test_keys_are_dense_and_found(spark, tmp_path):
    path = _written(spark, f"file://{tmp_path}/s")
    rows = store.read_store(spark, path).select("key", "sample_id").collect()
    assert sorted(r.key for r in rows) == list(range(1000)) and all(r.key == r.sample_id for r in rows)
    assert store.store_size(spark, path) == 1000
    assert sorted(r.key for r in store.get(spark, path, [5, 999, 5, 1000, -1]).collect()) == [5, 999]
    assert sorted(r.key for r in store.read_store(spark, path, 98, 203).collect()) == list(range(98, 203))
    asked = spark.createDataFrame([(3,), (3,), (None,), (5000,)], "key long")
    found = store.lookup(spark, path, asked).collect()
    assert sorted((str(r.key), str(r.sample_id)) for r in found) == [("3", "3"), ("3", "3"), ("5000", "None"), ("None", "None")]


def _files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    scans = re.findall(r"PartitionFilters: \[([^\n]*?)\], PushedFilters: \[([^\n]*?)\]", plan.toString())
    return plan, scans


def _scan_metric(node, name):
    """The metric of all file scans below a node."""
    total = node.metrics().apply(name).value() if node.nodeName().startswith("Scan") and node.metrics().contains(name) else 0
    children = node.children()
    return total + sum(_scan_metric(children.apply(k), name) for k in range(children.size()))


def test_a_lookup_reads_the_files_of_its_spans_only(spark, tmp_path):
    path = _written(spark, f"file://{tmp_path}/s")
    files = {r.span: r.n for r in spark.read.parquet(f"{path}/samples").groupBy("span", F.col("_metadata.file_path").alias("f")).count().groupBy("span").agg(F.count("*").alias("n")).collect()}
    assert len(files) == 10
    plan, scans = _files_read(store.get(spark, path, [150, 720]))
    assert any("span" in p and "In(key" in q for p, q in scans)
    assert _scan_metric(plan, "numFiles") == files[1] + files[7]


def test_many_keys_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    path = _written(spark, f"file://{tmp_path}/s")
    asked = spark.range(0, 2000, 2).select(F.col("id").alias("key"))
    want = sorted((r.key, r.sample_id is None) for r in store.lookup(spark, path, asked).collect())
    monkeypatch.setattr(store, "BROADCAST_KEYS", 10)
    assert sorted((r.key, r.sample_id is None) for r in store.lookup(spark, path, asked).collect()) == want == [(k, k >= 1000) for k in range(0, 2000, 2)]


def test_an_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store.write_store(store.stack_samples(_rows(spark, 0), ["VV"], ["R"], [], ["height"]), path, ["sample_id"]) == 0
    assert store.read_store(spark, path).count() == 0 and store.get(spark, path, [0]).count() == 0
    assert store.lookup(spark, path, spark.createDataFrame([(1,)], "key long")).first().sample_id is None


def test_z_order_of_tiles(spark):
    at = [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (-1, -1), (-1, 0), (0, -1), (2**29, 2**29)]
    got = {(r.a, r.b): r.z for r in spark.createDataFrame(at, "a long, b long").select("a", "b", io.z_order("a", "b").alias("z")).collect()}
    want = {p: sum(((p[0] + 2**30) >> k & 1) << (2 * k + 1) | ((p[1] + 2**30) >> k & 1) << (2 * k) for k in range(31)) for p in at}
    assert got == want


def test_an_extent_names_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    cells = spark.range(-64 * 128, 64 * 128).select(F.lit("B").alias("band"), F.floor(F.col("id") / 128).alias("y"), (F.pmod("id", F.lit(128)) - 64).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("value"))
    io.write_pixels(cells, path, grid(0.0, 0.0, 1.0, 128, 128), 8, 512)
    files = spark.read.parquet(f"{path}/files").collect()
    assert sum(r.n for r in files) == 16384 and max(r.n for r in files) <= 512 and 32 <= len(files) <= 40
    px, _ = io.read_raster(spark, path, extent=(-3, -3, 4, 4))
    plan, _ = _files_read(px)
    met = _scan_metric(plan, "numFiles")
    assert 4 <= met <= 8
    key = lambda df: sorted((r.y, r.x, r.value or 0.0, r.value is None) for r in df.collect())
    assert key(px) == key(cells.filter("y between -3 and 4 and x between -3 and 4"))
    assert key(io.read_raster(spark, path)[0]) == key(cells)
    assert io.read_raster(spark, path, extent=(500, 500, 600, 600))[0].count() == 0


def test_a_full_cell_and_cells_without_place(spark, tmp_path):
    """All rows in one tile are cut like any; cells without coordinates stay in the whole raster and in no extent; columns of their own are kept."""
    path = f"file://{tmp_path}/r"
    cells = spark.range(3000).select(F.lit("B").alias("band"), F.lit(1).cast("long").alias("y"), F.when(F.col("id") > 9, F.col("id") % 3).alias("x"), F.lit(1.0).alias("value"), F.col("id").alias("scene_id"))
    io.write_pixels(cells, path, grid(0.0, 0.0, 1.0, 1, 1), 8, 500)
    assert spark.read.parquet(f"{path}/files").agg(F.max("n")).first()[0] <= 500
    assert io.read_raster(spark, path)[0].select("scene_id").distinct().count() == 3000
    assert io.read_raster(spark, path, extent=(0, 0, 9, 9))[0].count() == 2990


def test_an_empty_raster(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    io.write_pixels(spark.createDataFrame([], "band string, y long, x long, value double"), path, grid(0.0, 0.0, 1.0, 1, 1))
    assert io.read_raster(spark, path)[0].count() == 0 and io.read_raster(spark, path, extent=(0, 0, 9, 9))[0].count() == 0
