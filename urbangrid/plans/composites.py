"""Queries on scenes, masks and composites (fixtures F1, F6, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import composite as C
from ..sources.fixtures import duck, fixture, load
from .registry import query

ROLES = "CASE band WHEN 'view' THEN 'R' WHEN 'click' THEN 'G' WHEN 'purchase' THEN 'B' WHEN 'signup' THEN 'NIR' ELSE 'SCL' END"
# wide pixels: bands side by side, with cloud and a sun azimuth for the shadow direction
WIDE = f"""w AS (SELECT scene_id, y, x, MAX(CASE WHEN band = 'view' THEN value END) AS r, MAX(CASE WHEN band = 'signup' THEN value END) AS nir,
  MAX(cloud) AS cloud, MAX(y) % 4 * 90 + 15 AS azimuth, MAX(y + x) % 8 AS scl FROM f1 GROUP BY 1, 2, 3)"""
NEAR = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


def _f1(spark, sf_dir):
    return fixture(spark, sf_dir, "f1")


def _wide(spark, sf_dir):
    px = _f1(spark, sf_dir)
    band = lambda n: F.max(F.when(F.col("band") == n, F.col("value")))
    return px.groupBy("scene_id", "y", "x").agg(band("view").alias("r"), band("signup").alias("nir"), F.max("cloud").alias("cloud")).select("*", (F.col("y") % 4 * 90 + 15).alias("azimuth"), ((F.col("y") + F.col("x")) % 8).alias("scl"))


def _meta(spark, sf_dir):
    return fixture(spark, sf_dir, "f6").withColumn("pol", F.split("pol", ","))


def _r6(c):
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


@query(f"WITH {duck('f6')} SELECT scene_id, mode, ROUND(cloudy_pct, 6) AS cloudy_pct FROM f6 WHERE pol = 'VV,VH' AND mode = 'IW' AND cloudy_pct < 20")
def c01_filter_scenes(spark, sf_dir):
    return C.filter_scenes(_meta(spark, sf_dir)).select("scene_id", "mode", _r6("cloudy_pct"))


@query(f"WITH {duck('f6')} SELECT scene_id, acquired FROM f6 WHERE acquired >= TIMESTAMP '1996-01-01' AND acquired < TIMESTAMP '1996-12-31'")
def c02_year_window(spark, sf_dir):
    return C.year_window(_meta(spark, sf_dir), 1990, 1996, 2001).select("scene_id", "acquired")


@query(f"""WITH {duck('f6')} SELECT scene_id, 's1' AS kind, CAST(0 AS BIGINT) AS season_rank FROM f6 WHERE (lat > 0 AND acquired >= TIMESTAMP '1996-12-01' AND acquired < TIMESTAMP '1997-03-01') OR (lat <= 0 AND acquired >= TIMESTAMP '1996-06-01' AND acquired < TIMESTAMP '1996-09-01')
UNION ALL SELECT scene_id, CASE WHEN month(acquired) < 7 THEN 'spr' ELSE 'aut' END, CAST(CASE WHEN (lat > 0) = (month(acquired) > 7) THEN 0 ELSE 1 END AS BIGINT) FROM f6 WHERE year(acquired) = 1996 AND month(acquired) IN (3, 4, 5, 9, 10, 11)""")
def c03_season_window(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    s1 = C.season_window(meta, 1996).select("scene_id", F.lit("s1").alias("kind"), F.lit(0).cast("long").alias("season_rank"))
    return s1.unionByName(C.season_rank(meta, 1996).select("scene_id", F.col("season").alias("kind"), F.col("season_rank").cast("long")))


@query(f"WITH {duck('f6')} SELECT scene_id, x_min, x_max FROM f6 WHERE x_max >= 9.5 AND x_min <= 12.5")
def c04_filter_bounds(spark, sf_dir):
    return C.filter_bounds(_meta(spark, sf_dir), (10.0, 0.0, 12.0, 1.0), (0.5, 0.0)).select("scene_id", "x_min", "x_max")


@query(f"WITH {duck('f1')} SELECT band, y, x, CAST(i * 25 AS INTEGER) AS p, ROUND(q[i], 6) AS value FROM (SELECT band, y, x, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM f1 GROUP BY 1, 2, 3), (SELECT unnest([1, 2, 3]) AS i)")
def c05_percentile_composite(spark, sf_dir):
    px = _f1(spark, sf_dir)
    many = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = px.groupBy("band", "y", "x").agg(many.alias("v")).select("band", "y", "x", F.posexplode("v").alias("i", "value"))
    return out.select("band", "y", "x", ((F.col("i") + 1) * 25).alias("p"), _r6("value"))


@query(f"WITH {duck('f1')} SELECT band, y, x, CAST(i * 25 AS INTEGER) AS p, ROUND(q[i], 6) AS value FROM (SELECT band, y, x, quantile_disc(value, [0.25, 0.5, 0.75]) AS q FROM f1 GROUP BY 1, 2, 3), (SELECT unnest([1, 2, 3]) AS i)")
def c05_sketch_composite(spark, sf_dir):
    """Quartiles from sketches of two parts of the scenes, merged; cells have fewer values than a sketch holds, so they are exact."""
    px, first = _f1(spark, sf_dir), F.crc32("scene_id") % 2 == 0
    kept = C.merge_sketches(C.sketch_composite(px.filter(first)), C.sketch_composite(px.filter(~first)))
    out = C.sketch_percentile(kept, [25, 50, 75]).select("band", "y", "x", F.posexplode("value").alias("i", "value"))
    return out.select("band", "y", "x", ((F.col("i") + 1) * 25).alias("p"), _r6("value"))


@query(f"WITH {duck('f1')} SELECT band, y, x, ROUND(AVG(value), 9) AS value FROM f1 GROUP BY 1, 2, 3")
def c06_mean_composite(spark, sf_dir):
    return C.composite(_f1(spark, sf_dir), "mean").select("band", "y", "x", F.round("value", 9).alias("value"))


@query("""SELECT o_orderkey, ROUND(o_totalprice, 6) AS o_totalprice, CAST(f.l_linenumber AS BIGINT) AS l_linenumber, CAST(f.l_partkey AS BIGINT) AS l_partkey, f.l_quantity AS l_quantity FROM orders JOIN
  (SELECT l_orderkey, arg_min({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_quantity': l_quantity}, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS f FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def c07_join_first(spark, sf_dir):
    left = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    right = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = C.join_first(left, right, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return out.select("o_orderkey", _r6("o_totalprice"), F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"), "l_quantity")


@query(f"WITH {duck('f1')} SELECT scene_id, band, y, x, CAST(cloud > 50 AS BIGINT) AS cloud_flag FROM f1")
def c08_cloud_flag(spark, sf_dir):
    return C.cloud_flag(_f1(spark, sf_dir)).select("scene_id", "band", "y", "x", F.col("cloud_flag").cast("long"))


@query(f"WITH {duck('f1')}, {WIDE} SELECT scene_id, y, x, CAST(nir < 75 AND scl <> 6 AS BIGINT) AS dark FROM w")
def c09_dark_pixel(spark, sf_dir):
    return C.dark_pixel(_wide(spark, sf_dir), scale=500).select("scene_id", "y", "x", F.col("dark").cast("long"))


_SHADOW = """s AS (SELECT DISTINCT scene_id, y - CAST(ROUND(k * sin(radians(90 - azimuth))) AS BIGINT) AS y, x + CAST(ROUND(k * cos(radians(90 - azimuth))) AS BIGINT) AS x FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE cloud > 80)"""


@query(f"WITH {duck('f1')}, {WIDE}, {_SHADOW} SELECT * FROM s")
def c10_project_shadow(spark, sf_dir):
    return C.project_shadow(C.cloud_flag(_wide(spark, sf_dir), "cloud", 80), dist=0.5)


@query(f"""WITH {duck('f1')}, {WIDE}, {_SHADOW} SELECT w.scene_id, w.y, w.x, CAST(s.y IS NOT NULL AS BIGINT) AS projected, CASE WHEN nir IS NULL AND scl <> 6 THEN NULL ELSE CAST(s.y IS NOT NULL AND nir < 75 AND scl <> 6 AS BIGINT) END AS shadow_flag
FROM w LEFT JOIN s ON w.scene_id = s.scene_id AND w.y = s.y AND w.x = s.x""")
def c11_shadow_flag(spark, sf_dir):
    px = C.dark_pixel(C.cloud_flag(_wide(spark, sf_dir), "cloud", 80), scale=500)
    return C.shadow_flag(px, 0.5).select("scene_id", "y", "x", F.col("projected").cast("long"), F.col("shadow_flag").cast("long"))


@query(f"""WITH {duck('f2')}, m AS (SELECT a.y, a.x, MIN(b.height) AS value FROM f2 a JOIN f2 b ON {NEAR} GROUP BY 1, 2)
SELECT a.y, a.x, ROUND(MAX(b.value), 6) AS opened FROM m a JOIN m b ON {NEAR} GROUP BY 1, 2""")
def c12_focal_min_max(spark, sf_dir):
    px = fixture(spark, sf_dir, "f2").select(F.lit("one").alias("scene_id"), "y", "x", F.col("height").alias("value"))
    return C.opened_mask(px).select("y", "x", F.round("value", 6).alias("opened"))


@query(f"WITH {duck('f1')} SELECT scene_id, ROUND(100 * SUM(CAST(cloud > 50 AS INT)) / COUNT(*), 6) AS cloudy FROM f1 GROUP BY 1")
def c13_cloudy_percentage(spark, sf_dir):
    return C.cloudy_percentage(C.cloud_flag(_f1(spark, sf_dir)), "cloud_flag").select("scene_id", _r6("cloudy"))


@query(f"""WITH {duck('f1')}, {WIDE}, v AS (SELECT scene_id, y, x, greatest(cloud / 100.0, CAST(scl = 3 AS DOUBLE)) AS v FROM w)
SELECT a.scene_id, a.y, a.x, ROUND(-AVG(b.v), 6) AS score FROM v a JOIN v b ON a.scene_id = b.scene_id AND {NEAR} GROUP BY 1, 2, 3""")
def c14_quality_score(spark, sf_dir):
    px = _wide(spark, sf_dir).select("scene_id", "y", "x", (F.col("cloud") / 100).alias("cloud_score"), (F.col("scl") == 3).cast("int").alias("shadow_flag"))
    return C.quality_score(px).select("scene_id", "y", "x", _r6("score"))


@query(f"""WITH {duck('f1')}, {WIDE}, g AS (SELECT scene_id, y, x, dayofyear(CAST(scene_id AS DATE)) % 2 AS season_rank, cloud AS v FROM w), sh AS (SELECT unnest([-1, 0, 1]) AS d),
m AS (SELECT a.scene_id, a.season_rank, a.y, a.x, MIN(b.v) AS v FROM g a, sh p, sh q JOIN g b ON a.scene_id = b.scene_id AND b.y = a.y + p.d AND b.x = a.x + q.d GROUP BY ALL),
o AS (SELECT a.scene_id, a.season_rank, a.y, a.x, MAX(b.v) AS v FROM m a, sh p, sh q JOIN m b ON a.scene_id = b.scene_id AND b.y = a.y + p.d AND b.x = a.x + q.d GROUP BY ALL),
s AS (SELECT season_rank, t.t AS threshold, scene_id FROM o, (SELECT unnest(range(20, 81, 5)) AS t) t GROUP BY ALL HAVING 100 * AVG(CAST(v > t.t AS INT)) < 30)
SELECT CAST(season_rank AS BIGINT) AS season_rank, CAST(threshold AS BIGINT) AS threshold, COUNT(*) AS n_scenes FROM s GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1""")
def c15_adaptive_threshold(spark, sf_dir):
    px = _wide(spark, sf_dir).withColumn("season_rank", F.dayofyear(F.col("scene_id").cast("date")) % 2)
    out = C.adaptive_threshold(px, keep=30)
    return out.select(*[F.col(c).cast("long") for c in ("season_rank", "threshold", "n_scenes")])


@query(f"""WITH {duck('f1')}, {WIDE} SELECT y, x, scene_id, ROUND(r, 6) AS r, ROUND(nir, 6) AS nir FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY -cloud DESC, scene_id DESC) AS n FROM w) WHERE n = 1""")
def c16_quality_mosaic(spark, sf_dir):
    px = _wide(spark, sf_dir).withColumn("score", -F.col("cloud"))
    return C.quality_mosaic(px, "score", ["r", "nir"]).select("y", "x", "scene_id", _r6("r"), _r6("nir"))


@query(f"WITH {duck('f1')} SELECT band, y, x, ROUND(arg_max(value, (-cloud, scene_id)), 6) AS value FROM f1 WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def c17_ordered_mosaic(spark, sf_dir):
    px = _f1(spark, sf_dir).withColumn("rank", -F.col("cloud"))
    return C.ordered_mosaic(px, ["rank", "scene_id"]).select("band", "y", "x", _r6("value"))


@query(f"""WITH {duck('f1')}, m AS (SELECT band, y, x, AVG(value) AS v FROM f1 GROUP BY 1, 2, 3)
SELECT y, x, ROUND(CAST(CAST(MAX(CASE WHEN band = 'view' THEN v END) AS FLOAT) AS DOUBLE), 3) AS view, ROUND(CAST(CAST(MAX(CASE WHEN band = 'click' THEN v END) AS FLOAT) AS DOUBLE), 3) AS click FROM m GROUP BY 1, 2""")
def c18_stack_bands(spark, sf_dir):
    out = C.stack_bands(C.composite(_f1(spark, sf_dir), "mean"), ["view", "click"])
    return out.select("y", "x", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("view", "click")])


def _manifest(spark):
    return spark.range(3).select(F.concat(F.lit("city"), F.col("id")).alias("city"), (F.col("id") * 2).alias("x_lo"), (F.col("id") * 2 + 4).alias("x_hi"), (F.col("id") * 30).alias("y_lo"), (F.col("id") * 30 + 25).alias("y_hi"))


_BOXES = "j AS (SELECT 'city' || i AS city, i * 2 AS x_lo, i * 2 + 4 AS x_hi, i * 30 AS y_lo, i * 30 + 25 AS y_hi FROM range(3) r(i))"
_INSIDE = "y BETWEEN y_lo AND y_hi AND x BETWEEN x_lo AND x_hi"


@query(f"WITH {duck('f1')}, {_BOXES} SELECT city, band, y, x, ROUND(quantile_cont(value, 0.5), 6) AS value FROM f1 JOIN j ON {_INSIDE} WHERE band IN ('view', 'click') GROUP BY 1, 2, 3, 4")
def c19_composite_s1(spark, sf_dir):
    return C.composite_s1(_f1(spark, sf_dir), _manifest(spark), ("view", "click")).select("city", "band", "y", "x", _r6("value"))


@query(f"WITH {duck('f1')}, {_BOXES} SELECT city, band, y, x, ROUND(quantile_cont(value, 0.5), 6) AS value FROM f1 JOIN j ON {_INSIDE} WHERE band IN ('view', 'click', 'purchase', 'signup') AND cloud < 20 GROUP BY 1, 2, 3, 4")
def c20_composite_s2(spark, sf_dir):
    return C.composite_s2(_f1(spark, sf_dir), _manifest(spark), ("view", "click", "purchase", "signup")).select("city", "band", "y", "x", _r6("value"))


@query(f"WITH {duck('f2')}, {_BOXES} SELECT city, y, x, ROUND(height, 6) AS height FROM f2 JOIN j ON y BETWEEN y_lo - 1 AND y_hi + 1 AND x BETWEEN x_lo - 1 AND x_hi + 1")
def c21_clip_dem(spark, sf_dir):
    return C.clip_dem(fixture(spark, sf_dir, "f2").select("y", "x", "height"), _manifest(spark), 1).select("city", "y", "x", _r6("height"))


@query(f"""WITH {duck('f1')}, {WIDE}, {_SHADOW.replace('range(1, 6)', 'range(1, 16)').replace('cloud > 80', 'cloud > 50')},
q AS (SELECT w.*, greatest(cloud / 100.0, CASE WHEN nir IS NULL AND scl <> 6 THEN NULL ELSE CAST(s.y IS NOT NULL AND nir < 75 AND scl <> 6 AS DOUBLE) END) AS v FROM w LEFT JOIN s ON w.scene_id = s.scene_id AND w.y = s.y AND w.x = s.x),
n AS (SELECT a.scene_id, a.y, a.x, -ROUND(AVG(b.v), 9) AS score FROM q a JOIN q b ON a.scene_id = b.scene_id AND {NEAR} GROUP BY 1, 2, 3)
SELECT y, x, scene_id, ROUND(r, 6) AS r FROM (SELECT w.*, row_number() OVER (PARTITION BY w.y, w.x ORDER BY score DESC, w.scene_id DESC) AS k FROM w JOIN n ON w.scene_id = n.scene_id AND w.y = n.y AND w.x = n.x) WHERE k = 1""")
def c22_cloud_free_composite(spark, sf_dir):
    out = C.cloud_free_composite(_wide(spark, sf_dir), ["r"], scale=500)
    return out.select("y", "x", "scene_id", _r6("r"))


@query(f"WITH {duck('f6')} SELECT scene_id, city_id || '_' || year(acquired) || '_sentinel_2_50pt_' || printf('%.2f', ROUND(x_min, 2)) || '_' || printf('%.2f', ROUND(x_max, 2)) AS name FROM f6")
def c23_output_name(spark, sf_dir):
    df = _meta(spark, sf_dir).withColumn("yr", F.year("acquired"))
    return C.output_name(df, "city_id", "yr", "sentinel_2", 50, ("x_min", "x_max")).select("scene_id", "name")


@query(f"""WITH {duck('f1')}, c AS (SELECT band, y, x, quantile_cont(value, 0.5) AS value FROM f1 WHERE cloud < 80 GROUP BY 1, 2, 3),
s AS (SELECT band, MIN(value) AS lo, quantile_cont(value, 0.98) - quantile_cont(value, 0.02) AS span FROM c GROUP BY 1),
r AS (SELECT c.band, y, x, CASE WHEN span = 0 THEN NULL ELSE least(1.0, greatest(0.0, (value - lo) / span)) END AS v FROM c JOIN s ON c.band = s.band)
SELECT y, x, ROUND(SUM(CASE WHEN band = 'view' THEN v END), 6) AS r, ROUND(SUM(CASE WHEN band = 'click' THEN v END), 6) AS g, ROUND(SUM(CASE WHEN band = 'signup' THEN v END), 6) AS nir FROM r GROUP BY 1, 2""")
def flagship_urban_cells(spark, sf_dir):
    """Median composite of clear scenes, every band rescaled by its percentiles, bands side by side."""
    from ..operators.patches import rescale_band

    px = C.composite(_f1(spark, sf_dir).filter("cloud < 80"))
    scaled = rescale_band(px)
    pick = lambda n: F.round(F.sum(F.when(F.col("band") == n, F.col("value"))), 6)
    return scaled.groupBy("y", "x").agg(pick("view").alias("r"), pick("click").alias("g"), pick("signup").alias("nir"))


def _vv(name, expr_spark, sql):
    def run(spark, sf_dir):
        wide = _f1(spark, sf_dir).groupBy("y", "x").agg(*[F.avg(F.when(F.col("band") == b, F.col("value"))).alias(a) for a, b in (("r", "view"), ("g", "click"), ("b", "purchase"), ("nir", "signup"))]).dropna()
        return wide.select("y", "x", F.round(expr_spark(), 6).alias("value"))

    run.__name__ = name
    base = f"WITH {duck('f1')}, v AS (SELECT * FROM (SELECT y, x, AVG(CASE WHEN band = 'view' THEN value END) AS r, AVG(CASE WHEN band = 'click' THEN value END) AS g, AVG(CASE WHEN band = 'purchase' THEN value END) AS b, AVG(CASE WHEN band = 'signup' THEN value END) AS nir FROM f1 GROUP BY 1, 2) WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND nir IS NOT NULL)"
    query(f"{base} SELECT y, x, ROUND({sql}, 6) AS value FROM v")(run)


_vv("p10_backscatter", lambda: S.backscatter(F.col("r") / 10 - 30), "least(1.0, pow(10.0, (r / 10 - 30) / 10))")
_vv("p13_vvh", lambda: S.vvh(S.backscatter(F.col("r") / 10 - 30), S.backscatter(F.col("g") / 10 - 30)), "least(1.0, pow(10.0, (r / 10 - 30) / 10)) * pow(5.0, least(1.0, pow(10.0, (g / 10 - 30) / 10)))")
_vv("p14_luminance", lambda: S.luminance("r", "g", "b"), "0.2126 * r + 0.7152 * g + 0.0722 * b")
_vv("p15_normalized_index", lambda: S.normalized_index("nir", "r"), "CASE WHEN nir + r = 0 THEN 0 ELSE (nir - r) / (nir + r) END")
