"""Queries on sources, grids and building layers (fixtures F2, F4, F5, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import vector as V
from ..schemas import grid as make_grid
from ..sources import io
from ..sources.shared import shared_path
from ..sources.fixtures import duck, fixture, load
from ..sources.store import lookup, read_store, stack_samples, write_store
from .registry import query

RES = 2.5
NET = "net AS (SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx FROM range(42) a(cy), range(42) b(cx))"
PIECES = f"""pc AS (SELECT f4.*, CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, (least(x_max, (cx + 1) * {RES}) - greatest(x_min, cx * {RES})) * (least(y_max, (cy + 1) * {RES}) - greatest(y_min, cy * {RES})) AS area
  FROM f4, range(45) a(cy), range(45) b(cx) WHERE x_max > x_min AND y_max > y_min AND x_min < (cx + 1) * {RES} AND x_max > cx * {RES} AND y_min < (cy + 1) * {RES} AND y_max > cy * {RES})"""
CLEAN = "c4 AS (SELECT *, CASE WHEN height_raw IS NULL THEN 3.0 ELSE greatest(height_raw * CASE unit WHEN 'm' THEN 1.0 WHEN 'cm' THEN 0.01 WHEN 'FLOOR' THEN 3.0 ELSE 0.3048 END, 2.0) END AS height FROM f4)"
MANIFEST = "mf AS (SELECT city, MIN(x_min) + 10 AS x_min, MIN(y_min) + 10 AS y_min, MIN(x_min) + 40 AS x_max, MIN(y_min) + 40 AS y_max FROM f4 GROUP BY 1)"


def _f4(spark, d):
    return fixture(spark, d, "f4")


def _net(spark):
    return spark.range(42 * 42).select(F.floor(F.col("id") / 42).alias("cy"), (F.col("id") % 42).alias("cx"))


def _manifest(spark, d):
    return G.layer_extent(_f4(spark, d), ["city"]).select("city", (F.col("x_min") + 10).alias("x_min"), (F.col("y_min") + 10).alias("y_min"), (F.col("x_min") + 40).alias("x_max"), (F.col("y_min") + 40).alias("y_max"))


def _r(c, n=6, name=None):
    return (F.round(c, n) + F.lit(0.0)).alias(name or c)


def _f2(spark, d):
    return fixture(spark, d, "f2")


def _shape(px):
    """Rows and columns of a raster that starts at cell (0, 0)."""
    e = px.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    return (e.y or 0) + 1, (e.x or 0) + 1


@query(f"WITH {duck('f6')} SELECT CAST(city_id AS VARCHAR) AS city, CAST(MIN(year(acquired)) AS INTEGER) AS first_year, COUNT(*) AS n_scenes, MIN(x_min) AS x_min, MAX(x_max) AS x_max FROM f6 GROUP BY 1")
def s01_read_manifest(spark, d):
    """A manifest of the cities is written as CSV, read under its schema and joined with the scenes."""
    scenes, path = fixture(spark, d, "f6"), shared_path(spark, "manifest")
    jobs = scenes.groupBy(F.col("city_id").cast("string").alias("City")).agg(F.lit("scenes").alias("Path"), F.min(F.year("acquired")).alias("Year"))
    jobs.write.option("header", True).csv(path)
    job = io.read_manifest(spark, path, "cases").select(F.col("City").alias("city"), F.col("Year").alias("first_year"))
    joined = scenes.withColumn("city", F.col("city_id").cast("string")).join(job, "city")
    return joined.groupBy("city", "first_year").agg(F.count("*").alias("n_scenes"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"))


@query(f"WITH {duck('f2')} SELECT y, x, ROUND(height, 6) AS value FROM f2 WHERE y BETWEEN 20 AND 60 AND x BETWEEN 10 AND 50")
def s02_read_pixels(spark, d):
    path = shared_path(spark, "pixels")
    px = _f2(spark, d).select(F.lit("height").alias("band"), "y", "x", F.col("height").alias("value"))
    io.write_tiles(px, path, 16)
    return io.read_pixels(spark, path, ["height"], (20, 10, 60, 50), 16).select("y", "x", _r("value"))


@query(f"WITH {duck('f2')} SELECT y, x, ROUND(height, 6) AS value FROM f2")
def s03_write_pixels(spark, d):
    path = shared_path(spark, "raster")
    px = _f2(spark, d).select(F.lit("height").alias("band"), "y", "x", F.col("height").alias("value"))
    io.write_pixels(px, path, make_grid(116.0, 40.0, 0.0009, 1000, 100))
    return io.read_raster(spark, path)[0].select("y", "x", _r("value"))


@query(f"WITH {duck('f2')} SELECT y, x, ROUND(height, 6) AS value FROM f2 WHERE y BETWEEN 5 AND 60 AND x BETWEEN 10 AND 50")
def s03_read_extent(spark, d):
    """A part of a written raster: files of at most 500 cells along a curve, of which the extent names those to read."""
    path = shared_path(spark, "raster")
    px = _f2(spark, d).select(F.lit("height").alias("band"), "y", "x", F.col("height").alias("value"))
    io.write_pixels(px, path, make_grid(116.0, 40.0, 0.0009, *_shape(px)), 8, 500)
    return io.read_raster(spark, path, ["height"], (5, 10, 60, 50))[0].select("y", "x", _r("value"))


@query(f"WITH {duck('f4')} SELECT id, x_min, y_min, x_max, y_max FROM f4")
def s04_read_polygons(spark, d):
    path = shared_path(spark, "polygons")
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), "id", F.struct("city").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))
    _f4(spark, d).select(feature.alias("value")).write.text(path)
    return V.with_box(io.read_polygons(spark, path)).select("id", "x_min", "y_min", "x_max", "y_max")


@query(f"WITH {duck('f5')} SELECT grp, sample_id, (row_number() OVER (PARTITION BY grp ORDER BY y_true, sample_id) - 1) // 100 AS chunk FROM f5")
def s05_sample_chunks(spark, d):
    return io.sample_chunks(fixture(spark, d, "f5").select("grp", "sample_id", "y_true"), "grp", ["y_true", "sample_id"], 100).select("grp", "sample_id", "chunk")


@query(f"WITH {duck('f5')} SELECT row_number() OVER (ORDER BY y_true, sample_id) - 1 AS key, sample_id FROM f5")
def s06_keyed_samples(spark, d):
    return io.keyed_samples(fixture(spark, d, "f5").select("sample_id", "y_true"), ["y_true", "sample_id"]).select(F.col("key").cast("long").alias("key"), "sample_id")


_BANDS = ("VV", "VH", "R", "G", "B", "NIR")
_CELLS = """b AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings), g AS (SELECT vec_id, label, i, unnest([
  least(255.0, 255 * least(1.0, pow(10.0, (v * 10 - 3) / 10))), least(255.0, 255 * least(1.0, pow(10.0, (v * 10 - 9) / 10))), v * 1000 * 0.0001 * 255, v * 2000 * 0.0001 * 255, v * 3000 * 0.0001 * 255, v * 4000 * 0.0001 * 255]) AS z,
  unnest([1, 2, 3, 4, 5, 6]) AS k FROM b),
c AS (SELECT vec_id, label, SUM(((i - 1) * 6 + k) * z) AS weighted, COUNT(*) AS n FROM g GROUP BY 1, 2)"""


def _store(spark, d):
    """Patches of six bands, terrain and two targets in a keyed store, in the order of label and id."""
    v = F.col("embedding").cast("array<double>")
    times = lambda m, a=0.0: F.transform(v, lambda e: e * m + a)
    bands = [times(10.0, -3.0).alias("VV"), times(10.0, -9.0).alias("VH"), *[times(1000.0 * (i + 1)).alias(b) for i, b in enumerate(("R", "G", "B", "NIR"))]]
    rows = fixture(spark, d, "f3").select("patch_id", "label", *bands, times(2.0).alias("DEM"), F.col("label").cast("double").alias("height"), (F.col("patch_id") % 100 / 100).alias("footprint"))
    path = shared_path(spark, "samples")
    write_store(stack_samples(rows, ["VV", "VH"], ["R", "G", "B", "NIR"], ["DEM"], ["height", "footprint"]), path, ["label", "patch_id"], 500)
    return path


def _weighted(bands):
    """The values weighted by their places, as a stand-in for the array."""
    return F.aggregate(F.transform(bands, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)


@query(f"""WITH {_CELLS}, t AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS key, embedding FROM embeddings)
SELECT key, CAST(t.vec_id AS BIGINT) AS patch_id, CAST(n AS INTEGER) AS n_values, ROUND(weighted, 2) AS weighted, ROUND(CAST(embedding[1] AS DOUBLE) * 2, 6) AS aux_first, CAST(t.label AS DOUBLE) AS height, t.vec_id % 100 / 100 AS footprint FROM t JOIN c ON c.vec_id = t.vec_id""")
def s06_sample_store(spark, d):
    """The whole store read back: bands side by side in each cell, terrain and targets by key."""
    out = read_store(spark, _store(spark, d))
    return out.select("key", "patch_id", F.size("bands").alias("n_values"), F.round(_weighted("bands"), 2).alias("weighted"), F.round(F.col("aux")[0][0], 6).alias("aux_first"), F.col("targets")[0].alias("height"), F.col("targets")[1].alias("footprint"))


@query(f"""WITH {_CELLS}, t AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS key FROM embeddings), a AS (SELECT CAST(l_orderkey AS BIGINT) AS key, COUNT(*) AS n_asked FROM lineitem GROUP BY 1)
SELECT a.key, n_asked, CAST(t.vec_id AS BIGINT) AS patch_id, ROUND(weighted, 2) AS weighted FROM a LEFT JOIN t ON t.key = a.key LEFT JOIN c ON c.vec_id = t.vec_id""")
def s06_store_lookup(spark, d):
    """Samples by key, the keys a table of any size: those that the store does not hold give a row of nulls."""
    asked = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("key")).agg(F.count("*").alias("n_asked"))
    return lookup(spark, _store(spark, d), asked).select("key", "n_asked", "patch_id", F.round(_weighted("bands"), 2).alias("weighted"))


@query(f"""WITH {duck('f5')}, n AS (SELECT grp, COUNT(*) AS n FROM f5 GROUP BY 1), s AS (SELECT grp, SUM(n) OVER (ORDER BY grp) - n AS b, SUM(n) OVER (ORDER BY grp) AS e FROM n)
SELECT i, grp, CAST(i - b AS BIGINT) AS shift FROM (SELECT CAST(o_orderkey * 7 AS BIGINT) AS i FROM orders) JOIN s ON i >= b AND i < e""")
def s07_index_samples(spark, d):
    idx = load(spark, d, "orders").select((F.col("o_orderkey") * 7).cast("long").alias("i"))
    return io.index_samples(fixture(spark, d, "f5").select("grp"), idx).select("i", "grp", F.col("shift").cast("long"))


@query(f"WITH {duck('f2')} SELECT y, x FROM f2 WHERE x // 9 * 9 >= 9 AND x // 9 * 9 < 36 AND y // 9 * 9 >= 0 AND y // 9 * 9 < 45")
def s08_select_tiles(spark, d):
    px = _f2(spark, d).withColumn("lon_tile", F.floor(F.col("x") / 9) * 9).withColumn("lat_tile", F.floor(F.col("y") / 9) * 9)
    return io.select_tiles(px, (10.0, 2.0, 30.5, 44.0)).select("y", "x")


@query("SELECT COUNT(*) FILTER (len(embedding) = 64 AND label < 8) AS accepted, COUNT(*) FILTER (NOT (len(embedding) = 64 AND label < 8)) AS rejected FROM embeddings")
def s09_check_patches(spark, d):
    px = fixture(spark, d, "f3").select(F.when(F.col("label") < 8, F.col("embedding")).otherwise(F.slice("embedding", 1, 9)).alias("VV"))
    return io.count_rejects(px, {"VV": 8})


@query(f"WITH {duck('f2', 'f2a')} SELECT coalesce(a.y, r.y) AS y, coalesce(a.x, r.x) AS x, ROUND(coalesce(a.height, r.height), 6) AS value FROM f2 r FULL JOIN f2a a ON r.y = a.y AND r.x = a.x")
def s10_mosaic(spark, d):
    one = [fixture(spark, d, n).select(F.lit("height").alias("band"), "y", "x", F.col("height").alias("value")) for n in ("f2", "f2a")]
    return io.mosaic(*one).select("y", "x", _r("value"))


@query(f"WITH {duck('f1')}, b AS (SELECT DISTINCT band FROM f1) SELECT '50pt@' || band || '@' || stat AS name FROM b, (SELECT unnest(['mean', 'std', 'max']) AS stat)")
def s11_feature_catalog(spark, d):
    return io.feature_catalog(spark, ["50pt"], io.band_names(fixture(spark, d, "f1")), ["mean", "std", "max"]).select("name")


@query(f"WITH {duck('f5')} SELECT ROUND(regr_slope(y_true, y_pred), 9) AS a, ROUND(regr_intercept(y_true, y_pred), 9) AS c FROM f5")
def s12_save_params(spark, d):
    path = shared_path(spark, "params")
    fit = fixture(spark, d, "f5").agg(F.regr_slope("y_true", "y_pred").alias("a"), F.regr_intercept("y_true", "y_pred").alias("c")).first()
    io.save_params(fit.asDict(), path, spark)
    return spark.read.parquet(path).select(*[F.round(F.col("params")[k], 9).alias(k) for k in ("a", "c")])


@query(f"WITH {duck('f5')}, n AS (SELECT COUNT(*) AS n FROM f5) SELECT 'run_' || i AS run_id, CAST(n AS VARCHAR) AS rows_used FROM n, range(2) r(i)")
def s13_append_run(spark, d):
    path, n = shared_path(spark, "runs"), fixture(spark, d, "f5").count()
    for i in range(2):
        io.append_run(spark, path, f"run_{i}", {"rows": n})
    return spark.read.parquet(path).select("run_id", F.col("params")["rows"].alias("rows_used"))


@query(f"WITH {duck('f4')} SELECT city, MIN(x_min) AS x_min, MIN(y_min) AS y_min, MAX(x_max) AS x_max, MAX(y_max) AS y_max FROM f4 GROUP BY 1")
def g01_layer_extent(spark, d):
    return G.layer_extent(_f4(spark, d), ["city"])


@query(f"""WITH {duck('f4')}, e AS (SELECT MIN(x_min) AS x0, MAX(x_max) AS x1, MIN(y_min) AS y0, MAX(y_max) AS y1 FROM f4),
n AS (SELECT *, CAST(ceil(round(round(y1 - y0, 6) / 2.0, 6)) AS BIGINT) AS nr, CAST(ceil(round(round(x1 - x0, 6) / 3.0, 6)) AS BIGINT) AS nc FROM e)
SELECT r * nc + c AS cell_id, ROUND(x0 + c * 3.0, 6) AS x_min, ROUND(y1 - r * 2.0, 6) AS y_max FROM (SELECT n.*, unnest(range(nr)) AS r FROM n) a, LATERAL (SELECT unnest(range(nc)) AS c)""")
def g02_fishnet(spark, d):
    e = G.layer_extent(_f4(spark, d)).first()
    return G.fishnet(spark, (e.x_min, e.y_min, e.x_max, e.y_max), 2.0, 3.0).select("cell_id", _r("x_min"), _r("y_max"))


@query(f"""WITH {duck('f4')}, e AS (SELECT floor(MIN(x_min)) AS x0, ceil(MAX(x_max)) AS x1, floor(MIN(y_min)) AS y0, ceil(MAX(y_max)) AS y1 FROM f4)
SELECT r AS y, c AS x, ROUND(x0 + 0.5 * (c + 0.5), 6) AS lon, ROUND(y1 - 0.5 * (r + 0.5), 6) AS lat FROM (SELECT e.*, unnest(range(CAST((y1 - y0) / 0.5 AS BIGINT))) AS r FROM e) a, LATERAL (SELECT unnest(range(CAST((x1 - x0) / 0.5 AS BIGINT))) AS c)""")
def g03_grid_centers(spark, d):
    import math

    e = G.layer_extent(_f4(spark, d)).first()
    return G.grid_centers(spark, (math.floor(e.x_min), math.floor(e.y_min), math.ceil(e.x_max), math.ceil(e.y_max)), 0.5).select("y", "x", _r("lon"), _r("lat"))


@query(f"""WITH {duck('f2')}, e AS (SELECT MAX(y) + 1 AS nr, MAX(x) + 1 AS nc FROM f2), k AS (SELECT f2.y, f2.x, nr // 7 AS sy, nr % 7 AS ey, nc // 7 AS sx, nc % 7 AS ex FROM f2, e)
SELECT y, x, CASE WHEN y < ey * (sy + 1) THEN y // (sy + 1) ELSE ey + (y - ey * (sy + 1)) // greatest(1, sy) END AS block_y, CASE WHEN x < ex * (sx + 1) THEN x // (sx + 1) ELSE ex + (x - ex * (sx + 1)) // greatest(1, sx) END AS block_x FROM k""")
def g04_split_region(spark, d):
    px = _f2(spark, d)
    return G.split_region(px, *_shape(px), 7).select("y", "x", "block_y", "block_x")


@query(f"WITH {duck('f6')} SELECT city_id, MAX(x_min) AS x_min, MIN(x_max) AS x_max, MAX(x_min) <= city_id + 0.95 - 0.02 AND MIN(x_max) >= city_id + 0.97 + 0.02 AS covers FROM f6 GROUP BY 1")
def g05_check_extent(spark, d):
    metas = fixture(spark, d, "f6").select("city_id", (F.col("x_min") - F.col("city_id")).alias("x_min"), (F.col("x_max") - F.col("city_id")).alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(1.0).alias("y_max"))
    out = G.check_extent(metas, (0.95, 0.5, 0.97, 0.6), 0.02, ["city_id"])
    return out.select("city_id", (F.col("x_min") + F.col("city_id")).alias("x_min"), (F.col("x_max") + F.col("city_id")).alias("x_max"), "covers")


@query(f"WITH {duck('f4')} SELECT id, CAST(floor((101.0 - y_min) / 0.5) AS BIGINT) AS y, CAST(floor((x_min - 0.25) / 0.5) AS BIGINT) AS x FROM f4")
def g06_point_to_cell(spark, d):
    return G.point_to_cell(_f4(spark, d), make_grid(0.25, 101.0, 0.5, 202, 202), "x_min", "y_min").select("id", "y", "x")


@query(f"WITH {duck('f2')} SELECT y, x FROM f2 WHERE y BETWEEN 18 AND 62 AND x BETWEEN 8 AND 52")
def g07_clip_raster(spark, d):
    return G.clip_raster(_f2(spark, d), (20, 10, 60, 50), 2).select("y", "x")


@query(f"WITH {duck('f4')}, {PIECES} SELECT id, cy, cx, ROUND(area, 6) AS area FROM pc")
def g08_overlay(spark, d):
    return V.overlay(_f4(spark, d), RES).select("id", "cy", "cx", _r("area"))


@query(f"WITH {duck('f4')}, {PIECES} SELECT id, cy, cx, ROUND(area, 6) AS area FROM pc")
def g08_overlay_polygons(spark, d):
    return V.overlay_polygons(V.as_rings(_f4(spark, d)).select("id", "rings"), RES).select("id", "cy", "cx", _r("area"))


@query(f"WITH {duck('f4')}, {PIECES}, {NET} SELECT net.cy, net.cx, ROUND(coalesce(SUM(area), 0) / {RES * RES}, 6) AS footprint FROM net LEFT JOIN pc ON pc.cy = net.cy AND pc.cx = net.cx GROUP BY 1, 2")
def g09_footprint_density(spark, d):
    return V.footprint_density(V.overlay(_f4(spark, d), RES), _net(spark), RES).select("cy", "cx", _r("footprint"))


@query(f"WITH {duck('f4')}, {PIECES}, {NET} SELECT net.cy, net.cx, ROUND(SUM(CASE WHEN height_raw IS NULL THEN 3 ELSE greatest(height_raw, 2) END * area) / SUM(area), 6) AS cell_height FROM net LEFT JOIN pc ON pc.cy = net.cy AND pc.cx = net.cx GROUP BY 1, 2")
def g10_cell_height(spark, d):
    return V.cell_height(V.overlay(_f4(spark, d), RES), _net(spark), "height_raw").select("cy", "cx", _r("cell_height"))


@query(f"WITH {duck('f4')} SELECT id FROM f4 WHERE id % 7 <> 0")
def g11_drop_null_geometry(spark, d):
    return V.drop_null_geometry(V.as_rings(_f4(spark, d)).withColumn("rings", F.when(F.col("id") % 7 != 0, F.col("rings")))).select("id")


_OVER = "a.id <> b.id AND a.x_min < b.x_max AND b.x_min < a.x_max AND a.y_min < b.y_max AND b.y_min < a.y_max"
_GROUPS = f"""ed AS (SELECT a.id AS s, b.id AS t FROM f4 a JOIN f4 b ON a.city = b.city AND {_OVER} WHERE a.x_max > a.x_min AND b.x_max > b.x_min),
rc(id, g) AS (SELECT id, id FROM f4 UNION SELECT ed.t, rc.g FROM rc JOIN ed ON ed.s = rc.id), gr AS (SELECT id, MIN(g) AS "group" FROM rc GROUP BY 1)"""


@query(f'WITH RECURSIVE {duck("f4")}, {_GROUPS} SELECT id, "group" FROM gr')
def g12_overlap_groups(spark, d):
    return V.overlap_groups(_f4(spark, d), RES, ("city",)).select("id", "group")


@query(f"""WITH {duck('f4')}, o AS (SELECT id, x_min - 1 AS x_min, x_max + 1 AS x_max, y_min - 1 AS y_min, y_max + 1 AS y_max FROM f4 WHERE id % 5 = 0)
SELECT o.id AS outer_id, f4.id AS inner_id FROM o JOIN f4 ON o.x_min <= f4.x_min + 1e-6 AND o.x_max >= f4.x_max - 1e-6 AND o.y_min <= f4.y_min + 1e-6 AND o.y_max >= f4.y_max - 1e-6""")
def g13_contains_join(spark, d):
    boxes = _f4(spark, d)
    outer = boxes.filter("id % 5 = 0").select("id", *[(F.col(c) + (1 if c.endswith("max") else -1)).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])
    return V.contains_join(outer, boxes, RES)


_ARMS = """arm AS (SELECT id, city, x_min, x_max, y_min, (y_min + y_max) / 2 AS y_max FROM f4 UNION ALL SELECT id, city, x_min, (x_min + x_max) / 2 AS x_max, y_min, y_max FROM f4)"""


def _corner_shapes(spark, d):
    """The boxes without their upper right quarter: L-shapes."""
    mid = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    xm, ym = mid("x_min", "x_max"), mid("y_min", "y_max")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x_min", "x_max", "y_min", "y_max"))
    ring = F.array(p(x0, y0), p(x1, y0), p(x1, ym), p(xm, ym), p(xm, y1), p(x0, y1))
    return _f4(spark, d).select("id", "city", F.array(ring).alias("rings"))


@query(f"""WITH RECURSIVE {duck('f4')}, {_ARMS}, ed AS (SELECT DISTINCT a.id AS s, b.id AS t FROM arm a JOIN arm b ON a.city = b.city AND {_OVER}),
rc(id, g) AS (SELECT id, id FROM f4 UNION SELECT ed.t, rc.g FROM rc JOIN ed ON ed.s = rc.id) SELECT id, MIN(g) AS "group" FROM rc GROUP BY 1""")
def g12_overlap_polygons(spark, d):
    """L-shapes that overlap; in SQL, two boxes each."""
    return V.overlap_groups(_corner_shapes(spark, d), RES, ("city",)).select("id", "group")


@query(f"""WITH {duck('f4')}, {_ARMS}, fr AS (SELECT * FROM f4 WHERE id % 5 = 0)
SELECT o.id AS outer_id, arm.id AS inner_id FROM fr o JOIN arm ON o.x_min - 3 <= arm.x_min + 1e-6 AND o.x_max + 3 >= arm.x_max - 1e-6 AND o.y_min - 3 <= arm.y_min + 1e-6 AND o.y_max + 3 >= arm.y_max - 1e-6
  AND NOT (o.x_min - 0.25 < arm.x_max - 1e-6 AND arm.x_min + 1e-6 < o.x_max + 0.25 AND o.y_min - 0.25 < arm.y_max - 1e-6 AND arm.y_min + 1e-6 < o.y_max + 0.25) GROUP BY 1, 2 HAVING COUNT(*) = 2""")
def g13_contains_polygons(spark, d):
    """Frames (boxes widened by 3 with a hole, the box widened by 0.25) that hold L-shapes."""
    wide = lambda by: V.as_rings(_f4(spark, d).filter("id % 5 = 0").select("id", *[(F.col(c) + (by if c.endswith("max") else -by)).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")]))
    frames = wide(3.0).select("id", "rings").join(wide(0.25).select("id", F.col("rings").alias("holes")), "id").select("id", F.concat("rings", "holes").alias("rings"))
    return V.contains_join(frames, _corner_shapes(spark, d), RES)


@query(f"WITH {duck('f4')}, {CLEAN} SELECT id, ROUND(height, 6) AS height FROM c4")
def g14_clean_height(spark, d):
    return V.clean_height(_f4(spark, d)).select("id", _r("height"))


@query(f"""WITH RECURSIVE {duck('f4')}, {_GROUPS}, {CLEAN} SELECT "group", ROUND(SUM(height * (x_max - x_min) * (y_max - y_min)) / SUM((x_max - x_min) * (y_max - y_min)), 6) AS height, COUNT(*) AS n_parts FROM c4 JOIN gr ON c4.id = gr.id GROUP BY 1""")
def g15_merge_height(spark, d):
    return V.merge_height(V.overlap_groups(V.clean_height(_f4(spark, d)), RES, ("city",))).select("group", _r("height"), "n_parts")


@query(f"WITH {duck('f4')} SELECT id, i AS part FROM f4, (SELECT unnest([1, 2]) AS i) WHERE i = 1 OR id % 3 = 0")
def g16_explode_parts(spark, d):
    boxes = V.as_rings(_f4(spark, d))
    part = lambda kind, k: F.struct(kind.alias("type"), F.col("rings").alias("rings"), F.lit(k).alias("part"))
    multi = boxes.withColumn("parts", F.array(part(F.lit("Polygon"), 1), part(F.when(F.col("id") % 3 == 0, "Polygon").otherwise("LineString"), 2))).withColumn("no", F.col("parts"))
    out = V.explode_parts(multi.drop("no"))
    from pyspark.sql import Window as W

    return out.select("id", F.row_number().over(W.partitionBy("id").orderBy("city")).alias("part"))


@query(f"WITH {duck('f4')} SELECT id, row_number() OVER (ORDER BY x_min, y_min, id) - 1 AS _id FROM f4")
def g17_add_row_id(spark, d):
    return V.add_row_id(_f4(spark, d).select("id", "x_min", "y_min"), "id", ["x_min", "y_min", "id"]).select("id", F.col("_id").cast("long"))


@query(f"""WITH {duck('f4', 'f2')}, {PIECES}, e AS (SELECT MAX(y) AS my, MAX(x) AS mx FROM f2), pe AS (SELECT pc.id, area, least(my, cy) AS y, least(mx, cx) AS x FROM pc, e)
SELECT pe.id, ROUND(greatest(ROUND(SUM(CASE WHEN v.height > 0 THEN v.height ELSE 0 END * area) / SUM(area), 9), 2.0), 2) AS raster_height FROM pe LEFT JOIN f2 v ON v.y = pe.y AND v.x = pe.x GROUP BY 1""")
def g18_attach_height(spark, d):
    px = _f2(spark, d).select("y", "x", F.col("height").alias("value"))
    return V.attach_height(_f4(spark, d), px, RES, *_shape(px)).filter("raster_height is not null").select("id", "raster_height")


@query(f"""WITH {duck('f2')}, e AS (SELECT MAX(y) AS my, MAX(x) AS mx FROM f2), n AS (SELECT y, x, least(my, greatest(0, CAST(floor((y - 6) / 3) AS BIGINT))) AS sy, least(mx, greatest(0, CAST(floor((x - 6) / 3) AS BIGINT))) AS sx FROM f2, e)
SELECT n.y, n.x, ROUND(s.height, 6) AS value FROM n LEFT JOIN f2 s ON s.y = sy AND s.x = sx""")
def g19_resample_nearest(spark, d):
    """The raster read as one of steps of 3 that starts 6 cells further in, at the centres of its own cells."""
    px = _f2(spark, d)
    nrow, ncol = _shape(px)
    src = px.select("y", "x", F.col("height").alias("value"))
    return G.resample_nearest(src, px, make_grid(6, -6, 3.0, nrow, ncol), make_grid(0, 0, 1.0, nrow, ncol)).select("y", "x", _r("value"))


@query(f"WITH {duck('f4')} SELECT id, ROUND(radians(x_min) * 6378137.0, 4) AS rx, ROUND(ln(tan(radians(y_min / 2) / 2 + pi() / 4)) * 6378137.0, 4) + 0.0 AS ry, ROUND(x_min, 6) AS bx, ROUND(y_min / 2, 6) + 0.0 AS by FROM f4")
def g20_reproject_xy(spark, d):
    there = G.reproject_xy(_f4(spark, d).select("id", F.col("x_min").alias("x"), (F.col("y_min") / 2).alias("y")), 4326, 3857)
    back = G.reproject_xy(there.select("id", "rx", "ry").toDF("id", "x", "y"), 3857, 4326)
    return back.select("id", _r("x", 4, "rx"), _r("y", 4, "ry"), _r("rx", 6, "bx"), _r("ry", 6, "by"))


@query(f"""WITH {duck('f2', 'f4')}, k AS (SELECT DISTINCT f2.y, f2.x FROM f2 JOIN f4 ON f2.x + 0.5 >= x_min AND f2.x + 0.5 < x_max AND 100 - (f2.y + 0.5) >= y_min AND 100 - (f2.y + 0.5) < y_max)
SELECT f2.y, f2.x, CASE WHEN k.y IS NOT NULL THEN ROUND(height, 6) END AS value FROM f2 LEFT JOIN k ON k.y = f2.y AND k.x = f2.x""")
def g21_mask_by_polygon(spark, d):
    px = _f2(spark, d).select("y", "x", F.col("height").alias("value"))
    return V.mask_by_polygon(px, V.as_rings(_f4(spark, d)), make_grid(0.0, 100.0, 1.0, 100, 100)).select("y", "x", _r("value"))


@query(f"WITH {duck('f4')} SELECT id, city, NULL::DOUBLE AS extra FROM f4 UNION ALL SELECT id + 100000, NULL, x_min FROM f4")
def g22_merge_layers(spark, d):
    a = _f4(spark, d)
    return V.merge_layers(a.select("id", "city"), a.select((F.col("id") + 100000).alias("id"), F.col("x_min").alias("extra")))


_CUT = f"""w AS (SELECT c4.id, c4.city, height, greatest(c4.x_min, m.x_min) AS x_min, least(c4.x_max, m.x_max) AS x_max, greatest(c4.y_min, m.y_min) AS y_min, least(c4.y_max, m.y_max) AS y_max FROM c4 JOIN mf m ON m.city = c4.city),
pw AS (SELECT city, height, CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, (least(x_max, (cx + 1) * {RES}) - greatest(x_min, cx * {RES})) * (least(y_max, (cy + 1) * {RES}) - greatest(y_min, cy * {RES})) AS area FROM w, range(45) a(cy), range(45) b(cx)
  WHERE x_max > x_min AND y_max > y_min AND x_min < (cx + 1) * {RES} AND x_max > cx * {RES} AND y_min < (cy + 1) * {RES} AND y_max > cy * {RES}),
nt AS (SELECT city, CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx FROM mf, range(90) a(cy), range(90) b(cx) WHERE x_min < (cx + 1) * {RES} AND x_max > cx * {RES} AND y_min < (cy + 1) * {RES} AND y_max > cy * {RES})"""


@query(f"WITH {duck('f4')}, {CLEAN}, {MANIFEST}, {_CUT} SELECT nt.city, nt.cy, nt.cx, ROUND(coalesce(SUM(area), 0) / {RES * RES}, 6) AS footprint FROM nt LEFT JOIN pw ON pw.city = nt.city AND pw.cy = nt.cy AND pw.cx = nt.cx GROUP BY 1, 2, 3")
def g23_footprint_batch(spark, d):
    return V.footprint_batch(_manifest(spark, d), _f4(spark, d), RES).select("city", "cy", "cx", _r("footprint"))


@query(f"WITH {duck('f4')}, {CLEAN}, {MANIFEST}, {_CUT} SELECT nt.city, nt.cy, nt.cx, ROUND(SUM(height * area) / SUM(area), 6) AS cell_height FROM nt LEFT JOIN pw ON pw.city = nt.city AND pw.cy = nt.cy AND pw.cx = nt.cx GROUP BY 1, 2, 3")
def g24_height_batch(spark, d):
    return V.height_batch(_manifest(spark, d), _f4(spark, d), RES).select("city", "cy", "cx", _r("cell_height"))


@query(f"WITH {duck('f4')} SELECT f4.id, f4.city, n FROM f4 LEFT JOIN (SELECT id, COUNT(*) AS n FROM f4 WHERE height_raw IS NOT NULL GROUP BY 1) h ON h.id = f4.id")
def r01_left_merge(spark, d):
    boxes = _f4(spark, d)
    return boxes.select("id", "city").join(boxes.filter("height_raw is not null").groupBy("id").agg(F.count("*").alias("n")), "id", "left")
