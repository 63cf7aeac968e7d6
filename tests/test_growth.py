"""Work and files grow with the input, and sums and ties come out alike however rows are dealt."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbangrid.sources import io


def test_tiles_are_few_files(spark, tmp_path):
    """4,000 tiles, rows dealt to 3 ranges: 3 files, and an extent gives its cells."""
    px = spark.range(64_000).select(F.lit("h").alias("band"), F.floor(F.col("id") / 10).alias("y"), (F.col("id") % 10).alias("x"), F.col("id").cast("double").alias("value"))
    io.write_tiles(px, f"file://{tmp_path}/tiles", 4)
    assert len(glob.glob(f"{tmp_path}/tiles/**/*.parquet", recursive=True)) <= 3
    got = {(r.y, r.x): r.value for r in io.read_pixels(spark, f"file://{tmp_path}/tiles", ["h"], (3, 2, 50, 5), 4).collect()}
    assert got == {(y, x): float(10 * y + x) for y in range(3, 51) for x in range(2, 6)}


def test_averages_are_summed_in_file_order(spark, tmp_path):
    """Two row groups read by two tasks: (0.1 + 0.2) + 0.3, not 0.1 + (0.2 + 0.3); a cell without values is null."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from urbangrid.sources.fixtures import fixture

    def rows(supplier, discounts):
        n = len(discounts)
        return pa.table({"l_suppkey": [supplier] * n, "l_partkey": [7] * n, "l_quantity": [5.0] * n, "l_discount": pa.array(discounts, pa.float64()), "l_returnflag": ["R"] * n})

    with pq.ParquetWriter(tmp_path / "lineitem.parquet", rows(1, [0.1]).schema) as out:
        for part in (rows(1, [0.1]), rows(1, [0.2, 0.3]), rows(2, [None])):
            out.write_table(part)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "256")
        got = {r.y: (r.height, r.footprint) for r in fixture(spark, str(tmp_path), "f2").collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {1: (5.0, ((0.1 + 0.2) + 0.3) / 3 * 10), 2: (5.0, None)} and (0.1 + 0.2) + 0.3 != 0.1 + (0.2 + 0.3)


def test_equal_scores_are_ties(spark):
    """Means that differ in their last digits only are equal scores."""
    from urbangrid.operators.composite import quality_score

    px = spark.createDataFrame([("a", 0, x, v, 0) for x, v in enumerate((0.1, 0.2, 0.3))] + [("b", 0, 1, 0.2, 0)], "scene_id string, y long, x long, cloud_score double, shadow_flag int")
    scores = {r.score for r in quality_score(px).filter("x = 1").collect()}
    assert scores == {-0.2}


def test_points_south_of_the_equator(spark):
    """An open side of the extent cuts nothing: rows beyond 44,444 of this grid lie at negative latitudes."""
    from urbangrid.operators.analytics import raster_to_points

    px = spark.createDataFrame([(0, 0, 1.0), (60_000, 0, 2.0), (0, 9, 3.0)], "y long, x long, value double")
    grid = {"x0": 116.0, "y0": 40.0, "dx": 0.0009, "dy": 0.0009}
    assert {r.value for r in raster_to_points(px, grid, (None, None, 116.005, None)).collect()} == {1.0, 2.0}
    assert {r.value for r in raster_to_points(px, grid, (116.0, 0.0, 117.0, 90.0)).collect()} == {1.0, 3.0}


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles_from_brackets_are_exact(spark, accuracy):
    """Skewed values, ties, nulls, constants and no values at all, against NumPy."""
    from urbangrid.operators.quantiles import quantiles

    rng = np.random.default_rng(5)
    a, b = np.exp(rng.normal(size=5000) * 3), rng.integers(0, 4, 5000).astype(float)
    rows = [(float(x), None if k % 7 == 0 else float(y), 2.5, None) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = quantiles(df, ["a", "b", "c", "d"], qs, accuracy)
    assert got["a"] == pytest.approx(list(np.quantile(a, qs)), rel=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile(b[np.arange(5000) % 7 != 0], qs)), rel=1e-12)
    assert got["c"] == [2.5] * 6 and got["d"] == [None] * 6


def test_only_bracketed_values_are_kept(spark):
    """Of 200,000 distinct values a quantile sorts those near its rank (`percentile` keeps all of them in one task)."""
    from urbangrid.operators import quantiles as Q

    kept, real = [], Q.stored
    try:
        Q.stored = lambda df, name: kept.append(real(df, name)) or kept[-1]
        assert Q.quantiles(spark.range(200_001).select(F.col("id").cast("double").alias("v")), ["v"], [0.5])["v"] == [100_000.0]
    finally:
        Q.stored = real
    assert kept[-1].count() < 1000


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    """Rows beyond RANGE_ROWS a range make more ranges; positions stay whole."""
    monkeypatch.setattr(io, "RANGE_ROWS", 100)
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    kept, real = [], io.stored
    monkeypatch.setattr(io, "stored", lambda d, name: kept.append(real(d, name)) or kept[-1])
    got = io.sample_chunks(df, "g", ["k"], 1).collect()
    assert {(r.k, r.chunk) for r in got} == {(k, k // 3) for k in range(2000)}
    assert kept[0].select("__range").distinct().count() == 20


@pytest.mark.parametrize("rings", [False, True])
def test_equal_shapes_are_compared_once(spark, monkeypatch, rings):
    """30 equal outer and 40 equal inner shapes are one pair to compare and 1,200 pairs of ids, ids that repeat too."""
    from urbangrid.operators import vector

    box = lambda ids, lo, hi: spark.createDataFrame([(i, lo, hi, lo, hi) for i in ids], "id long, x_min double, x_max double, y_min double, y_max double")
    outer, inner = box([*range(29), 5], 0.0, 9.0), box(range(100, 140), 2.0, 3.0).unionByName(box([7], 8.0, 10.0))
    name, seen = ("contained" if rings else "_boxes_held"), []
    real = getattr(vector, name)
    monkeypatch.setattr(vector, name, lambda a, b, *rest: seen.append((a.count(), b.count())) or real(a, b, *rest))
    monkeypatch.setattr(vector, "CHUNK", 8)
    shapes = [vector.as_rings(df) if rings else df for df in (outer, inner)]
    got = sorted(tuple(r) for r in vector.contains_join(*shapes, 2.5).collect())
    assert got == sorted((i, j) for i in [*range(29), 5] for j in range(100, 140)) and seen == [(1, 2)]


def test_equal_boxes_hang_on_one(spark, monkeypatch):
    """500 copies of one box in two cities are two boxes to compare; each city's copies are one group."""
    from urbangrid.operators import vector

    real, seen = vector.overlapping_pairs, []
    monkeypatch.setattr(vector, "overlapping_pairs", lambda df, *rest: seen.append(df.count()) or real(df, *rest))
    boxes = spark.range(1000).select("id", (F.col("id") % 2).cast("string").alias("city"), *[F.lit(v).alias(c) for c, v in (("x_min", 0.0), ("x_max", 3.0), ("y_min", 0.0), ("y_max", 3.0))])
    got = {(r.id, r.group) for r in vector.overlap_groups(boxes, 2.5, ("city",)).collect()}
    assert got == {(i, i % 2) for i in range(1000)} and seen == [2]


def test_component_trees_keep_no_cells_of_the_rasters_own_border(spark):
    """A raster one tile wide: the last tree holds nothing that could still grow, and equal limits share a tree."""
    import numpy as np

    from urbangrid.operators import percolation

    cells = spark.range(40 * 3).selectExpr("id div 3 AS y", "id % 3 AS x", "CAST(7 + id % 2 AS LONG) AS hl", "CAST(5 AS LONG) AS lev")
    rows = percolation._trees(cells, np.array([7, 8]), np.array([5]), 4, False).collect()
    assert sorted(r.h for r in rows) == [0, 1]
    assert all(r.rim == [] and r.levels == [] for r in rows)
    assert {r.h: r.best[1] for r in rows} == {0: 120, 1: 60}


@pytest.mark.parametrize("name", ["m07_random_forest", "m10_kernel_regression", "m16_predict_ml"])
def test_learners_join_their_samples_once(spark, sf_dir, name):
    """What is predicted is read from the samples as written, not joined or cut again."""
    from urbangrid.plans import all_queries

    assert not [f for f in all_queries()[0][name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_kernel_regression_is_sparks_huber_fit(spark):
    """The same loss as Spark ML's, from columns without a table of features."""
    from pyspark.ml.regression import LinearRegression

    from urbangrid.operators import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = np.sin(x[:, 0]) + 0.1 * rng.standard_t(2, 500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, label double")
    model = models.fit_kernel(df, 8, 1.5, ["a", "b"])
    want = LinearRegression(loss="huber", maxIter=1000, tol=1e-12).fit(models.fourier_features(df, ["a", "b"], 8, 1.5))
    assert model.scale == pytest.approx(want.scale, rel=1e-3)
    both = want.transform(models.fourier_features(df, ["a", "b"], 8, 1.5)).withColumnRenamed("prediction", "want")
    assert max(abs(r.want - r.prediction) for r in model.transform(both).select("want", "prediction").collect()) < 1e-2
    assert models.fit_kernel(df.withColumn("label", F.lit(2.0)), 8, 1.5, ["a", "b"]).transform(df).first().prediction == 2.0


def test_rows_of_arrow_batches_are_taken_whole():
    """Slices, missing lists and missing values; bins packed and opened again."""
    import pyarrow as pa

    from urbangrid.operators import boosting

    lists = pa.array([[1.0, 2.0], [3.0, None], None, [5.0, 6.0]], pa.list_(pa.float64()))
    for part in (lists, lists.slice(1, 1), lists.slice(1, 2), lists.slice(3), lists.slice(0, 0)):
        want = boosting._matrix([r if r is None else [np.nan if v is None else v for v in r] for r in part.to_pylist()], 2)
        np.testing.assert_array_equal(boosting._flat(part, 2), want)
    bins = np.arange(12, dtype=np.uint8).reshape(6, 2)
    packed = boosting._packed(bins)
    assert packed.to_pylist()[5] == b"\x0a\x0b"
    assert (boosting._unpacked(packed.slice(2, 3), 2) == bins[2:5]).all() and boosting._unpacked(packed.slice(0, 0), 2).shape == (0, 2)


def test_search_takes_a_table_as_it_is_dealt(spark):
    from urbangrid.operators import models

    df = spark.createDataFrame([(f"s{i}", float(i), i % 2 + 5) for i in range(10)], "sample_id string, label double, fold int").withColumn("fold", F.col("fold") - 5)
    seen = []

    def fit(train, p):
        seen.append(sorted(r.sample_id for r in train.collect()))
        return lambda rows: rows.withColumn("prediction", F.lit(p))

    models.search(df, fit, [{"p": 1.0}], 2, at_once=1)
    assert seen == [[f"s{i}" for i in (1, 3, 5, 7, 9)], [f"s{i}" for i in (0, 2, 4, 6, 8)]]


def test_patch_dataset_keeps_a_footprint_on_the_limit(spark, tmp_path):
    """Two row groups read by two tasks: in file order the centre's footprint is 0.2 and passes; summed by tasks it is less."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from urbangrid.plans import all_queries

    def rows(cells, discounts):
        n = len(cells)
        return pa.table({"l_suppkey": [y for y, _ in cells], "l_partkey": [x for _, x in cells], "l_quantity": [15.0] * n, "l_discount": discounts, "l_returnflag": ["R"] * n})

    around = [(y, x) for y in (1, 2, 3) for x in (10, 11, 12) if (y, x) != (2, 11)]
    parts = [rows([*around, (2, 11), (2, 11)], [0.05] * 8 + [0.0, 0.01]), rows([(2, 11)] * 2, [0.01, 0.06])]
    assert (0.0 + 0.01 + 0.01 + 0.06) / 4 * 10 == 0.2 > ((0.0 + 0.01) + (0.01 + 0.06)) / 4 * 10
    with pq.ParquetWriter(tmp_path / "lineitem.parquet", parts[0].schema) as out:
        for part in parts:
            out.write_table(part)
    queries, oracles = all_queries()
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "256")
        got = [(r.city, r.cy, r.cx, r.chunk) for r in queries["p18_patch_dataset"](spark, str(tmp_path)).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == [(2, 2, 11, 0)] == con.execute(oracles["p18_patch_dataset"]).fetchall()


def test_boosting_passes_over_blocks(spark, monkeypatch):
    """50,000 rows in two tasks are a few blocks, before and after margins are written; the fit is that of blocks of one batch."""
    from urbangrid.operators import boosting

    df = spark.range(0, 50_000, 1, 2).select(F.array(F.pmod("id", F.lit(97)).cast("double"), F.pmod("id", F.lit(11)).cast("double")).alias("features"), (F.pmod("id", F.lit(97)) * 2.0 + F.pmod("id", F.lit(11))).alias("label"))
    kept, real = [], boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda d, name: kept.append(real(d, name)) or kept[-1])
    edges = [[float(e) for e in range(5, 97, 6)], [2.0, 5.0, 8.0]]
    model = boosting.fit_boosted_trees(df, 3, 3, edges=edges, refresh=2)
    assert [k.count() <= 6 for k in kept] == [True, True]
    monkeypatch.setattr(boosting, "BLOCK", 1)
    again = boosting.fit_boosted_trees(df, 3, 3, edges=edges, refresh=2)
    assert [t[:4] for t in model.splits()] == [t[:4] for t in again.splits()] and model.base == pytest.approx(np.mean([2.0 * (i % 97) + i % 11 for i in range(50_000)]))


def test_search_of_learners_reads_features_as_written(spark, sf_dir, monkeypatch):
    """Preparation is not run again by each pass of each fit."""
    from urbangrid.operators import models
    from urbangrid.plans import all_queries

    read = []
    monkeypatch.setattr(models, "search", lambda df, *rest: read.append(df) or spark.createDataFrame([(1.0, 1.0, 0, 0.5)], f"{next(iter(rest[1][0]))} double, other double, fold int, r2 double"))
    all_queries()[0]["m11_search_learners"](spark, sf_dir)
    assert [sorted({f.split("/")[-2].split("-")[0] for f in df.inputFiles()}) for df in read] == [["features"], ["features"], ["folds"]]
    assert "UDF" not in read[0]._jdf.queryExecution().analyzed().toString()


def test_bags_make_a_rows_features_once(spark, monkeypatch):
    """A bag's weights, with rows in several bags, are those of a fit of the bag alone."""
    from urbangrid.operators import models

    rng = np.random.default_rng(4)
    rows = [(f"s{i}", float(a), float(c), float(a + c * c)) for i, (a, c) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "sample_id string, a double, c double, label double")
    got = {r.bag: (r["mean"], r.weights) for r in models.fit_bagged_kernel(df, ["a", "c"], 3, 0.6, 1.5, d_rff=16, piece_rows=1000).collect()}
    many = models.fit_bagged_kernel(df, ["a", "c"], 3, 0.6, 1.5, d_rff=16, piece_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(piece" in many and "REPARTITION_BY_NUM" in many  # small rows are not gathered in one task
    w, b, scale = models._fourier(2, 16, 1.5, 0)
    for k in range(3):
        mine = df.filter(F.pmod(F.xxhash64("sample_id", F.lit(0), F.lit(k)), F.lit(1_000_000)) < 600_000).toPandas()
        z, y = scale * np.cos(mine[["a", "c"]].to_numpy() @ w.T + b), mine["label"].to_numpy()
        assert got[k][0] == pytest.approx(y.mean()) and got[k][1] == pytest.approx(list(np.linalg.solve(z.T @ z + 1e-2 * np.eye(16), z.T @ (y - y.mean()))), rel=1e-6)


def test_search_runs_a_model_once_on_a_row(spark):
    """Rows that are scored go through the model once; rows without label or prediction are not scored."""
    import pandas as pd

    from urbangrid.operators import models

    df = spark.createDataFrame([(f"s{i}", None if i == 9 else float(i), i % 2) for i in range(10)], "sample_id string, label double, fold int")
    runs = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def predict(y: pd.Series) -> pd.Series:
        runs.add(len(y))
        return y.where(y != 8, None) + 1

    got = {r.fold: r.r2 for r in models.search(df, lambda train, p: lambda rows: rows.withColumn("prediction", predict("label")), [{"p": 1.0}], 2).collect()}
    assert got == {0: pytest.approx(1 - 4 / 20), 1: pytest.approx(1 - 4 / 20)} and runs.value == 10
