"""Hand-worked cases and properties of operators whose results SQL does not state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbangrid.operators import evaluate, features, grid, masks, models, patches, samples, vector
from urbangrid.operators.components import connected_components
from urbangrid.plans import all_queries
from urbangrid.sources import io


def _long(spark, rows):
    cells = [(1, "R", i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
    return spark.createDataFrame(cells, "patch_id long, band string, i long, j long, v double")


def _grid(df):
    return {(r.i, r.j): r.v for r in df.collect()}


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_morphology_order_and_idempotence(spark):
    image = _long(spark, [[(i * 7 + j * 3) % 11 for j in range(9)] for i in range(9)])
    base, opened, closed = _grid(image), _grid(features.opening(image, 3)), _grid(features.closing(image, 3))
    assert all(opened[k] <= base[k] <= closed[k] for k in base)
    assert _grid(features.opening(features.opening(image, 3), 3)) == opened
    rec, rec_c = _grid(features.opening_rec(image, 3)), _grid(features.closing_rec(image, 3))
    assert all(opened[k] <= rec[k] <= base[k] <= rec_c[k] <= closed[k] for k in base)


def test_reconstruction_keeps_what_touches_a_core(spark):
    image = [[0] * 7 for _ in range(7)]
    for i in range(1, 4):
        for j in range(1, 4):
            image[i][j] = 5
    image[2][4] = 5  # a tail that the opening cuts and the reconstruction gives back
    image[6][6] = 9  # alone: gone
    got = _grid(features.opening_rec(_long(spark, image), 3))
    assert got[2, 4] == 5 and got[6, 6] == 0 and got[2, 2] == 5
    assert _grid(features.opening(_long(spark, image), 3))[2, 4] == 0


def test_unknown_names_are_errors(spark):
    for table in features.FEATURES.values():
        with pytest.raises(KeyError):
            features.pick(table, "none")


def test_split_is_disjoint_complete_and_repeatable(spark, sf_dir):
    q = all_queries()[0]["d02_split_samples"]
    a, b = ({(r.sample_id, r.part) for r in q(spark, sf_dir).collect()} for _ in range(2))
    ids = [s for s, _ in a]
    assert a == b and len(ids) == len(set(ids)) and {p for _, p in a} == {"train", "valid"}


def test_split_counts(spark):
    df = spark.range(100).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), (F.col("id") % 4).cast("string").alias("grp"))
    out = samples.split_samples(df, 0.2, 0.0, ("3",), 1).groupBy("grp", "part").count().collect()
    assert {(r.grp, r.part): r["count"] for r in out} == {("0", "train"): 20, ("0", "valid"): 5, ("1", "train"): 20, ("1", "valid"): 5, ("2", "train"): 20, ("2", "valid"): 5, ("3", "valid"): 25}


def test_dense_position_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("b", 1.0, 4), ("a", -1.0, 5)], "g string, v double, k long")
    got = {r.k: r.position for r in io.dense_position(df, ["g"], ["v", "k"]).collect()}
    assert got == {1: 0, 5: 1, 2: 2, 3: 3, 4: 0}


def test_clusters_cross_tiles(spark):
    cells = [(0, c) for c in range(40)] + [(2, 0), (3, 1), (10, 10)]
    px = spark.createDataFrame(cells, "y long, x long")
    sizes = sorted(r.n for r in masks.cluster_sizes(masks.connected_cells(px, tile=4)).collect())
    assert sizes == [1, 2, 40]


def test_knee_of_a_bent_curve(spark):
    curve = [(0.05 * i, 1 / (1 + (i / 4) ** 2)) for i in range(1, 21)]
    k = masks.knee(spark.createDataFrame(curve, "d double, value double")).first().knee
    assert k is not None and 0.2 <= k <= 0.6
    flat = masks.knee(spark.createDataFrame([(0.1 * i, 1.0 - 0.1 * i) for i in range(8)], "d double, value double")).first().knee
    assert flat is None


def test_best_epochs(spark):
    runs = spark.createDataFrame([("r", 1, 0.1), ("r", 2, 0.3), ("r", 3, 0.2), ("r", 4, 0.4)], "run_id string, epoch int, m double")
    assert sorted(r.epoch for r in evaluate.best_epochs(runs, ["m"]).collect()) == [1, 2, 4]


def test_polygon_area_with_hole(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (3, 3), (3, 1))]), (2, [ring((0.5, 0.5), (2.5, 0.5), (0.5, 2.5))])]
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: r.a for r in vector.overlay_polygons(df, 1.0).groupBy("id").agg(F.sum("area").alias("a")).collect()}
    assert got[1] == pytest.approx(12) and got[2] == pytest.approx(2)


def test_unknown_unit_is_an_error(spark):
    df = spark.createDataFrame([(1.0, "miles")], "height_raw double, unit string")
    with pytest.raises(Exception, match="unknown unit"):
        vector.clean_height(df).collect()


def test_blocks_of_an_uneven_split(spark):
    df = spark.range(10).select(F.col("id").alias("y"), F.col("id").alias("x"))
    got = [r.block_y for r in grid.split_region(df, 10, 10, 3).orderBy("y").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_flip_and_noise(spark):
    df = spark.createDataFrame([(i, [float(v) for v in range(9)]) for i in range(60)], "patch_id long, patch array<double>")
    out = patches.augment_flip(df, 3, 1).collect()
    base = [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    want = {0: base, 1: base[::-1], 2: [r[::-1] for r in base], 3: [r[::-1] for r in base[::-1]]}
    assert all(r.patch == [float(v) for row in want[r.flip] for v in row] for r in out) and {r.flip for r in out} == {0, 1, 2, 3}
    noise = [v - k for r in patches.augment_noise(df, 0.25, 3).collect() for k, v in enumerate(r.patch)]
    assert abs(sum(noise) / len(noise)) < 0.1 and 0.15 < sum(n * n for n in noise) / len(noise) < 0.4


def test_learners_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1]
    df = spark.createDataFrame([(f"s{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "sample_id string, a double, b double, c double, label double")
    cols = ["a", "b", "c"]
    prepared = models.fit_preprocessors(df, cols, 3)
    ready = prepared.transform(df)

    def r2(out):
        rows = out.select("label", "prediction").collect()
        return 1 - sum((r.label - r.prediction) ** 2 for r in rows) / float(((y - y.mean()) ** 2).sum())

    assert r2(models.fit_rf(ready, 10, 7).transform(ready)) > 0.6
    assert r2(models.fit_gbt(ready, 10, 4).transform(ready)) > 0.6
    assert r2(models.predict_bagged_kernel(df, models.fit_bagged_kernel(df, cols, 3, 0.4, piece_rows=120), cols)) > 0.7
    assert r2(models.fit_kernel(df, 64, 1.0, cols).transform(models.fourier_features(df, cols, 64, 1.0))) > 0.7


def test_grid_search_finds_the_curve(spark, sf_dir):
    scores = all_queries()[0]["m11_grid_search"](spark, sf_dir).collect()
    by = {}
    for r in scores:
        by.setdefault(r.gamma, []).append(r.r2)
    assert max(by, key=lambda g: sum(by[g]) / len(by[g])) == 5.0


def test_raster_round_trip_keeps_missing(spark, tmp_path):
    from urbangrid.schemas import grid as make

    px = spark.createDataFrame([("h", 0, 0, 1.5), ("h", 300, 2, None)], "band string, y long, x long, value double")
    io.write_pixels(px, f"file://{tmp_path}/r", make(0, 0, 1, 400, 10))
    got, g = io.read_raster(spark, f"file://{tmp_path}/r")
    assert {(r.y, r.value) for r in got.collect()} == {(0, 1.5), (300, None)} and g["nrow"] == 400


def test_manifest_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"\xef\xbb\xbfCity,Path,Year\nA,p,2020\n")
    assert io.read_manifest(spark, f"file://{tmp_path}/m.csv", "cases").first().asDict() == {"City": "A", "Path": "p", "Year": 2020}


def test_maps_hold_every_cell(spark, sf_dir):
    from urbangrid.sources.fixtures import fixture

    cells = {(r.y, r.x) for r in fixture(spark, sf_dir, "f2").select("y", "x").collect()}
    for name in ("m17_predict_single", "m18_predict_multi"):
        got = [(r.cy, r.cx) for r in all_queries()[0][name](spark, sf_dir).select("cy", "cx").collect()]
        assert set(got) == cells and len(got) == len(cells)
    got = [(r.variable, r.y, r.x) for r in all_queries()[0]["m19_tiled_map"](spark, sf_dir).collect()]
    assert len(set(got)) == len(got) and {v for v, _, _ in got} == {"footprint", "height"}


@pytest.mark.parametrize(("strip", "columns"), [(8, 8), (16, 1000), (1000, 4)])
def test_holes_take_the_nearest_value(spark, strip, columns):
    rng = np.random.default_rng(2)
    cells = {(b, y, x): None if (b == "a" and 5 <= y < 45 and 3 <= x < 40) or rng.random() < 0.2 else float(y * 100 + x) for b in "abc" for y in range(50) for x in range(45) if rng.random() < 0.9}
    cells.update({k: None for k in cells if k[0] == "c"})
    cells["b", 400, 3] = None  # far from all others
    px = spark.createDataFrame([(*k, float("nan") if v is None and k[1] % 2 else v) for k, v in cells.items()], "band string, y long, x long, value double")
    got = {(r.band, r.y, r.x): r.value for r in patches.fill_nan_nearest(px, keys=("band",), strip=strip, columns=columns).collect()}
    valid = {b: np.array([(y, x, v) for (k, y, x), v in cells.items() if k == b and v is not None]) for b in "abc"}
    for (b, y, x), v in cells.items():
        if v is None and len(valid[b]):
            g = valid[b]
            v = g[np.lexsort((g[:, 1], g[:, 0], (g[:, 0] - y) ** 2 + (g[:, 1] - x) ** 2))[0], 2]
        assert got.pop((b, y, x)) == v
    assert not got


def test_a_wide_hole(spark):
    """A hole of 1,000 x 1,000 cells in a frame two cells wide: every cell of it is filled, sampled ones are compared with all of the frame."""
    n = 1004
    side = spark.range(n * n).select(F.floor(F.col("id") / n).alias("y"), (F.col("id") % n).alias("x"))
    inner = F.col("y").between(2, n - 3) & F.col("x").between(2, n - 3)
    px = side.withColumn("value", F.when(~inner, (F.col("y") * 10_000 + F.col("x")).cast("double")))
    got = patches.fill_nan_nearest(px, strip=256).toPandas()
    assert len(got) == n * n and got.value.notna().all()
    value = np.empty((n, n))
    value[got.y, got.x] = got.value
    frame = np.array([(y, x) for y in range(n) for x in range(n) if not (2 <= y <= n - 3 and 2 <= x <= n - 3)])
    rng = np.random.default_rng(8)
    for y, x in [*rng.integers(2, n - 2, (300, 2)).tolist(), (501, 501), (502, 502), (501, 502)]:
        d2 = (frame[:, 0] - y) ** 2 + (frame[:, 1] - x) ** 2
        k = np.lexsort((frame[:, 1], frame[:, 0], d2))[0]
        assert value[y, x] == frame[k, 0] * 10_000 + frame[k, 1]


def test_windows_are_filled_from_themselves():
    nan = float("nan")
    given = np.array([[nan, 1, nan, nan, nan, nan, nan, nan, 9], [nan] * 9, [*range(9)]], float)
    got = patches.fill_windows(given, 3)
    assert got[0].tolist() == [1, 1, 1, 1, 1, 9, 9, 9, 9] and np.isnan(got[1]).all() and got[2].tolist() == [*range(9)]


def test_positions_of_hot_groups_and_common_prefixes(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"), F.format_string("sample-%08d", F.pmod(F.col("id") * 7919, F.lit(3000))).alias("k"))
    rows = io.dense_position(df.repartition(5), ["g"], ["k"]).collect()
    for g in ("rare", "hot"):
        mine = sorted((r.k, r.position) for r in rows if r.g == g)
        assert [p for _, p in mine] == [*range(len(mine))]
    assert len(rows) == 3000 and io.dense_position(df.limit(0), ["g"], ["k"]).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_do_not_hang_on_the_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    pick = lambda values: values[rng.integers(len(values))]
    rows = [(pick([None, "a", "b", "hot", "hot", "hot", "\u00e9"]), pick([None, 1.5, float("nan"), float("-inf"), 2.0]), pick([None, -3, 5, 2**62]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double, k long, position_id long")
    key = lambda x: (x is not None, 0 if x is None else 1 if x != x else 0, 0 if x is None or x != x else x)
    for groups in (["g"], [], ["g", "k"]):
        at = {"g": 0, "k": 2}
        count, want = {}, {}
        for r in sorted(rows, key=lambda r: ([*map(key, (r[at[g]] for g in groups))], key(r[1]), key(r[2]), r[3])):
            own = tuple(r[at[g]] for g in groups)
            want[r[3]] = count[own] = count.get(own, -1) + 1
        got = io.dense_position(df.repartition(parts), groups, ["v", "k", "position_id"])
        assert got.columns == [*df.columns, "position"]
        assert {r.position_id: r.position for r in got.collect()} == want


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(k, *map(float, r), 1.0) for k, r in enumerate(x)], "k long, a double, b double, c double, d double, flat double")
    prepared = models.fit_preprocessors(df, ["a", "b", "c", "d", "flat"], 3)
    z = (x - x.mean(0)) / x.std(0)
    _, _, turned = np.linalg.svd(z - z.mean(0), full_matrices=False)
    axes = turned[:3] * np.sign(turned[:3][np.arange(3), np.abs(turned[:3]).argmax(1)])[:, None]
    got = np.array([r.features.toArray() for r in prepared.transform(df).orderBy("k").collect()])
    assert prepared.cols == ["a", "b", "c", "d"] and np.allclose(got, z @ axes.T, atol=1e-6)


def test_bags_use_their_share_of_the_rows(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") / 4000).alias("a"), F.sin(F.col("id") / 400).alias("label"))
    whole = models.fit_bagged_kernel(df, ["a"], 3, 0.5, width=0.1, piece_rows=500)
    assert sorted(r.bag for r in whole.collect()) == [0, 1, 2] and all(len(r.weights) == 256 for r in whole.collect())
    out = models.predict_bagged_kernel(df, whole, ["a"], 0.1).select(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("e")).first()
    assert out.e < 0.05


def test_features_of_patches_with_gaps(spark):
    """Array features against the plain definitions, cell by cell."""
    rng = np.random.default_rng(6)
    grids = rng.random((5, 6, 6)).round(2)
    grids[1:4][rng.random((3, 6, 6)) < 0.2] = np.nan
    long = spark.createDataFrame([(p, "R", i, j, float(grids[p, i, j])) for p in range(5) for i in range(6) for j in range(6) if not np.isnan(grids[p, i, j])], "patch_id long, band string, i long, j long, v double")

    def near(g, i, j, r, fn):
        w = g[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]
        return fn(w[~np.isnan(w)])

    for op, first, second in ((features.opening, min, max), (features.closing, max, min)):
        got = {(r.patch_id, r.i, r.j): r.v for r in op(long, 3).collect()}
        for p, g in enumerate(grids):
            at = lambda a, fn: np.array([[near(a, i, j, 1, fn) if not np.isnan(g[i, j]) else np.nan for j in range(6)] for i in range(6)])  # noqa: B023, E731
            want = at(at(g, first), second)
            assert all(got[p, i, j] == want[i, j] for i in range(6) for j in range(6) if not np.isnan(g[i, j]))
    plain = {(r.patch_id, n): r[n] for r in features.texture(long, 5, 6).collect() for n in features.TEXTURES}
    rows = features.assemble_features(long, 6, "x", [1, 3], [5], ("R",), bands=("R",)).collect()
    stats = {r.patch_id: r for r in features.band_stats(long).collect()}
    assert len(rows) == 5 and rows[0].names == features.feature_names(6, "x", [1, 3], [5], ("R",), ("R",))
    for r in rows:
        f = dict(zip(r.names, r.features))
        assert all(f[f"x@R@w5@{n}"] == pytest.approx(plain[r.patch_id, n]) for n in features.TEXTURES)
        assert all(f[f"x@R@{n}"] == pytest.approx(stats[r.patch_id][n]) for n in features.STATISTICS)


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_percolation_by_tiles_equals_labels_of_the_whole_raster(spark, tile):
    rng = np.random.default_rng(3)
    h, f = rng.integers(0, 40, (23, 31)), rng.integers(0, 11, (23, 31)) / 10
    rows = [(y - 9, x - 5, float(h[y, x]), None if (y + x) % 17 == 0 else float(f[y, x])) for y in range(23) for x in range(31)]
    px = spark.createDataFrame(rows, "y int, x int, height double, footprint double")
    hs, ds = [0.0, 12.0, 25.0, 90.0], [0.0, 0.25, 0.4, 0.6, 0.8, 2.0]
    got = {(r.h_id, r.d_id): round(r.value, 9) for r in masks.percolation_2d(px, hs, ds, tile=tile).collect()}
    assert len(got) == len(hs) * len(ds)
    sizes = {}
    for i, least in enumerate(hs):
        for j, d in enumerate(ds):
            left = {(y, x) for y, x, a, b in rows if a >= least and (b or 0.0) >= d}
            total, largest, found = len(left), 0, []
            while left:
                todo, n = [left.pop()], 0
                while todo:
                    y, x = todo.pop()
                    n += 1
                    near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
                    left -= near
                    todo += near
                largest = max(largest, n)
                found.append(n)
            assert got[i, j] == round(largest / total if total else 1.0, 9)
            sizes[i, j] = found
    for i, least in enumerate(hs[:3]):
        entropy = {r.d_id: r.value for r in masks.percolation(px, ds, least, "entropy", tile=tile).collect()}
        for j in range(len(ds)):
            n = sum(sizes[i, j])
            assert entropy[j] == pytest.approx(sum(s / n * np.log(s / n) for s in sizes[i, j]), abs=1e-9)


def test_runs_make_the_clusters_of_cells():
    rng = np.random.default_rng(12)
    for density, shape in ((0.1, (30, 40)), (0.45, (40, 40)), (0.7, (25, 60)), (1.0, (5, 5)), (0.5, (1, 50)), (0.5, (50, 1))):
        y, x = np.nonzero(rng.random(shape) < density)
        y, x = y - 7, x + 11
        first, of = masks.clusters_of_runs(y, x)
        left, want = {p: i for i, p in enumerate(zip(y.tolist(), x.tolist()))}, {}
        for start in list(left):
            if start in left:
                at, todo = left.pop(start), [start]
                want[at] = at
                while todo:
                    cy, cx = todo.pop()
                    for p in ((cy + dy, cx + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                        if p in left:
                            want[left.pop(p)] = at
                            todo.append(p)
        assert first[of].tolist() == [want[i] for i in range(len(y))]


def test_percolation_on_the_whole_grid_of_limits(spark, sf_dir):
    """901 x 891 pairs; some of them against labels of the whole raster."""
    got = {(r.h_id, r.d_id): r.value for r in all_queries()[0]["q07_percolation_grid"](spark, sf_dir).collect()}
    assert len(got) == 901 * 891
    from urbangrid.sources.fixtures import fixture

    px = fixture(spark, sf_dir, "f2").select("y", "x", "height", "footprint").toPandas()
    rng = np.random.default_rng(2)
    for i, j in [(0, 0), (900, 890), *zip(rng.integers(0, 901, 40).tolist(), rng.integers(0, 891, 40).tolist())]:
        some = px[(px.height >= 2.0 + 18.0 * i / 900) & (px.footprint >= 0.01 + 0.89 * j / 890)].sort_values(["y", "x"])
        first, of = masks.clusters_of_runs(some.y.to_numpy(), some.x.to_numpy())
        sizes = np.bincount(first[of]) if len(some) else [1]
        assert got[i, j] == pytest.approx(max(sizes) / max(1, len(some)))


def plain_boosting(x, y, edges, n, depth, gamma, rate, l2):
    """Splits and predictions by trying every threshold on the rows themselves."""
    low = np.where(np.isnan(x), -np.inf, x)
    margin, splits = np.full(len(y), y.mean()), []
    for k in range(n):
        nodes, weights = {0: np.arange(len(y))}, np.zeros(len(y))
        for _ in range(depth):
            below = {}
            for node, rows in nodes.items():
                g, best = (margin - y)[rows], (0.0, None)
                for f in range(x.shape[1]):
                    for t in [-np.inf, *edges[f]]:
                        left = low[rows, f] <= t
                        if 0 < left.sum() < len(rows):
                            gain = (g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - g.sum() ** 2 / (len(rows) + l2)) / 2 - gamma
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, t, left))
                weights[rows] = -rate * g.sum() / (len(rows) + l2)
                if best[1]:
                    f, t, left = best[1]
                    splits.append((k, node, f, t, best[0]))
                    below[2 * node + 1], below[2 * node + 2] = rows[left], rows[~left]
            nodes = below
        for rows in nodes.values():
            weights[rows] = -rate * (margin - y)[rows].sum() / (len(rows) + l2)
        margin = margin + weights
    return sorted(splits), margin


@pytest.mark.parametrize(("gamma", "l2"), [(0.0, 0.0), (0.0, 5.0), (2.0, 1.0)])
def test_boosted_trees_equal_all_thresholds_tried(spark, gamma, l2):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(400, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.1, 400)
    x[rng.random(x.shape) < 0.05] = np.nan
    edges = [np.sort(rng.choice(c[~np.isnan(c)], 12, replace=False)).tolist() for c in x.T]
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(900, [0.0, 0.0, 0.0], None), (901, [0.0, 0.0, 0.0], float("nan"))]
    df = spark.createDataFrame(rows, "id int, features array<double>, label double").repartition(3)
    model = models.fit_gbt(df, 5, 3, gamma, 0.3, l2=l2, edges=edges, refresh=2)
    splits, margin = plain_boosting(x, y, edges, 5, 3, gamma, 0.3, l2)
    assert [s[:4] for s in model.splits()] == [s[:4] for s in splits]
    assert [s[4] for s in model.splits()] == pytest.approx([s[4] for s in splits])
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(margin.tolist())
    assert models.fit_gbt(df.limit(0), 2, 2).transform(df).first().prediction == 0.0


def test_an_l2_term_shrinks_leaves(spark):
    df = spark.createDataFrame([([float(i % 7), float(i % 5)], float(i % 7 > 3)) for i in range(300)], "features array<double>, label double")
    free, bound = (models.fit_gbt(df, 3, 2, l2=v) for v in (0.0, 1000.0))
    assert max(abs(t.weight).max() for t in bound.trees) < 0.3 * max(abs(t.weight).max() for t in free.trees)


def test_search_scores_each_setting_on_each_fold(spark):
    """The R2 of a learner that predicts the mean of its training rows, worked out by hand; a fold of one label has none."""
    from urbangrid.operators.models import search

    rows = [(k, float(v)) for k, v in enumerate([1, 2, 4, 8, 5, 5])]
    df = spark.createDataFrame(rows, "sample_id long, label double")

    def fit(train, shift):
        mean = train.agg(F.avg("label")).first()[0] + shift
        return lambda table: table.withColumn("prediction", F.lit(mean))

    got = {(r.shift, r.fold): r.r2 for r in search(df, fit, [{"shift": 0.0}, {"shift": 1.0}], 3).collect()}
    y = np.array([v for _, v in rows])
    for shift in (0.0, 1.0):
        for fold in range(3):
            test, train = y[2 * fold : 2 * fold + 2], np.delete(y, [2 * fold, 2 * fold + 1])
            want = None if fold == 2 else 1 - ((test - train.mean() - shift) ** 2).sum() / ((test - test.mean()) ** 2).sum()
            assert got[shift, fold] == (want if want is None else pytest.approx(want))
    with pytest.raises(ValueError):
        search(df, fit, [{"shift": 0.0}, {"fold": 1.0}], 3)


def test_heights_of_an_extent_that_is_not_covered(spark):
    from urbangrid.operators.models import predict_vvh

    px = spark.createDataFrame([("VV", 0, 0, -5.0), ("VV", 3, 3, -5.0), ("VH", 0, 0, -9.0)], "band string, y long, x long, value double")
    centers = spark.createDataFrame([(0, 0), (2, 2)], "cy long, cx long")
    params = {"a": 1.0, "b": 1.0, "c": 0.0}
    with pytest.raises(ValueError):
        predict_vvh(px, centers, params, 3, extent=(0, 0, 2, 2)).collect()
    assert predict_vvh(px, centers, params, 3, extent=(0, 0, 0, 0)).count() == 1
