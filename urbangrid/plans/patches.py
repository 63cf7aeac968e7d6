"""Queries on patches, features and models (fixtures F1, F2, F3, F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import models as M
from ..operators import patches as P
from ..sources.fixtures import duck, fixture
from ..sources.shared import stored
from .registry import query

# patches of 8 x 8 cells, values scaled to 0..1, in long form
LONG = """ln AS (SELECT CAST(vec_id AS BIGINT) AS patch_id, p // 8 AS i, p % 8 AS j, least(1.0, greatest(0.0, CAST(v AS DOUBLE) * 2 + 0.5)) AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
CUT = "f2c AS (SELECT y AS cy, x AS cx FROM f2)"


def _around(lo: int, hi: int) -> str:
    """Every centre with the cells of its window: an equi-join on the shifted cell."""
    return f"f2c, (SELECT unnest(range({lo}, {hi + 1})) AS dy) o, (SELECT unnest(range({lo}, {hi + 1})) AS dx) p JOIN f2 ON f2.y = cy + dy AND f2.x = cx + dx"


def _windows_sql(raster: str, size: int, lo: int) -> str:
    """wf: band, cy, cx, v for every place of every window; places without a value take the nearest one of the window."""
    return f"""wa AS (SELECT n.band, cy, cx, dy, dx, r.v FROM f2c, (SELECT DISTINCT band FROM {raster}) n, (SELECT unnest(range({lo}, {lo + size})) AS dy) o, (SELECT unnest(range({lo}, {lo + size})) AS dx) p
  LEFT JOIN {raster} r ON r.band = n.band AND r.y = cy + dy AND r.x = cx + dx),
wf AS (SELECT band, cy, cx, v FROM wa WHERE v IS NOT NULL UNION ALL SELECT a.band, a.cy, a.cx, arg_min(b.v, ((a.dy - b.dy) ** 2 + (a.dx - b.dx) ** 2, b.dy, b.dx))
  FROM wa a JOIN wa b ON a.v IS NULL AND b.v IS NOT NULL AND a.band = b.band AND a.cy = b.cy AND a.cx = b.cx GROUP BY a.band, a.cy, a.cx, a.dy, a.dx)"""


def _r(c, n=6, name=None):
    return (F.round(c, n) + F.lit(0.0)).alias(name or c)


def _patches(spark, d):
    scaled = F.transform("embedding", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double") * 2 + 0.5)))
    return fixture(spark, d, "f3").select("patch_id", scaled.alias("patch"))


def _long(spark, d, band="R"):
    return P.to_long(_patches(spark, d), 8).withColumn("band", F.lit(band))


def _px(spark, d):
    return fixture(spark, d, "f2").select(F.lit("height").alias("band"), "y", "x", F.col("height").alias("value"))


def _centers(spark, d):
    return fixture(spark, d, "f2").select(F.col("y").alias("cy"), F.col("x").alias("cx"))


def _sums(df):
    present = F.filter("patch", lambda v: v.isNotNull())
    return df.select("cy", "cx", "size", F.size(present).cast("long").alias("n"), F.round(F.aggregate(present, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _patch_sql(size: int, lo: int, hi: int) -> str:
    return f"SELECT cy, cx, CAST({size} AS INTEGER) AS size, COUNT(height) AS n, ROUND(SUM(height), 6) AS total FROM {_around(lo, hi)} GROUP BY 1, 2"


@query(f"WITH {duck('f2')}, {CUT} {_patch_sql(5, -2, 2)} UNION ALL {_patch_sql(4, -1, 2)}")
def p01_extract_patches(spark, d):
    return _sums(P.extract_patches(_px(spark, d), _centers(spark, d), 5, 16)).unionByName(_sums(P.extract_patches(_px(spark, d), _centers(spark, d), 4, 16)))


@query(f"WITH {duck('f2')}, {CUT} {_patch_sql(3, -1, 1)} UNION ALL {_patch_sql(5, -2, 2)}")
def p02_multi_size_patches(spark, d):
    return _sums(P.multi_size_patches(_px(spark, d), _centers(spark, d), [3, 5]))


@query(f"WITH {duck('f2')}, {CUT} SELECT cy, cx, ROUND(SUM(height), 6) AS h, ROUND(SUM(footprint), 6) AS f FROM {_around(-1, 1)} GROUP BY 1, 2")
def p03_assemble_patches(spark, d):
    f2 = fixture(spark, d, "f2")
    other = f2.select(F.lit("footprint").alias("band"), "y", "x", F.col("footprint").alias("value"))
    out = P.assemble_patches(_centers(spark, d), [(_px(spark, d), ["height"]), (other, ["footprint"])], 3)
    total = lambda c: F.round(F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v), 6)
    return out.select("cy", "cx", total("height").alias("h"), total("footprint").alias("f"))


@query(f"WITH {duck('f2')}, {CUT} {_patch_sql(2, 0, 1)}")
def p04_aux_patch(spark, d):
    return _sums(P.extract_patches(_px(spark, d), _centers(spark, d), P.aux_patch_size(5, 0.5), 16))


@query("SELECT vec_id AS patch_id, ROUND(COUNT(*) FILTER ((vec_id + p) % 97 = 0) / 64.0, 6) AS ratio FROM (SELECT vec_id, unnest(range(64)) AS p FROM embeddings) GROUP BY 1 HAVING COUNT(*) FILTER ((vec_id + p) % 97 = 0) / 64.0 <= 0.01")
def p05_nan_ratio(spark, d):
    holed = _patches(spark, d).withColumn("patch", F.transform("patch", lambda v, k: F.when((F.col("patch_id") + k) % 97 != 0, v)))
    return P.keep_complete(holed, ["patch"], 0.01).select("patch_id", F.round(S.nan_ratio("patch"), 6).alias("ratio"))


@query(f"""WITH {duck('f2')}, h AS (SELECT y, x, CASE WHEN (y + x) % 9 <> 0 THEN height END AS v FROM f2),
n AS (SELECT a.y, a.x, arg_min(b.v, ((b.y - a.y) ** 2 + (b.x - a.x) ** 2, b.y, b.x)) AS v FROM h a JOIN h b ON a.v IS NULL AND b.v IS NOT NULL GROUP BY 1, 2)
SELECT y, x, ROUND(v, 6) AS value FROM h WHERE v IS NOT NULL UNION ALL SELECT y, x, ROUND(v, 6) FROM n""")
def p06_fill_nan_nearest(spark, d):
    px = _px(spark, d).withColumn("value", F.when((F.col("y") + F.col("x")) % 9 != 0, F.col("value")))
    return P.fill_nan_nearest(px).select("y", "x", _r("value"))


@query(f"""WITH {duck('f1')}, s AS (SELECT band, MIN(value) AS lo, quantile_cont(value, 0.98) - quantile_cont(value, 0.02) AS span FROM f1 GROUP BY 1)
SELECT scene_id, f1.band, y, x, ROUND(least(1.0, greatest(0.0, (value - lo) / span)), 6) AS value FROM f1 JOIN s ON f1.band = s.band""")
def p08_rescale_band(spark, d):
    return P.rescale_band(fixture(spark, d, "f1")).select("scene_id", "band", "y", "x", _r("value"))


@query(f"""WITH {LONG}, s AS (SELECT patch_id, MIN(v) AS lo, quantile_cont(v, 0.98) - quantile_cont(v, 0.02) AS span FROM ln GROUP BY 1)
SELECT ln.patch_id, i, j, ROUND(CASE WHEN span = 0 THEN 0 ELSE least(1.0, greatest(0.0, (v - lo) / span)) END, 5) AS v FROM ln JOIN s ON ln.patch_id = s.patch_id""")
def p09_rescale_patch(spark, d):
    return P.rescale_patch(_long(spark, d)).select("patch_id", "i", "j", _r("v", 5))


@query(f"WITH {LONG} SELECT patch_id, i, j, ROUND(floor(v * 255) / 255.0, 6) AS v FROM ln")
def p11_quantise(spark, d):
    return _long(spark, d).select("patch_id", "i", "j", F.round(S.quantise("v"), 6).alias("v"))


@query(f"WITH {LONG} SELECT patch_id, CAST(b * 64 + (7 - i) * 8 + j AS BIGINT) AS p, ROUND(CASE b WHEN 0 THEN v ELSE 1 - v END, 6) AS v FROM ln, (VALUES (0), (1)) t(b)")
def p12_order_bands(spark, d):
    px = _patches(spark, d).select("patch_id", F.transform("patch", lambda v: 1 - v).alias("VH"), F.col("patch").alias("VV"))
    return P.order_bands(px, 8, ("VV", "VH"), flip=True).select("patch_id", F.posexplode("features").alias("p", "v")).select("patch_id", F.col("p").cast("long").alias("p"), _r("v"))


def _hash(*parts) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15) AS BIGINT)"


@query(f"""WITH {LONG}, h AS (SELECT patch_id, CASE WHEN {_hash('patch_id', "'3'")} % 6 < 3 THEN {_hash('patch_id', "'3'")} % 6 + 1 ELSE 0 END AS f FROM (SELECT DISTINCT patch_id FROM ln))
SELECT ln.patch_id, CASE WHEN f IN (1, 3) THEN 7 - i ELSE i END AS i, CASE WHEN f IN (2, 3) THEN 7 - j ELSE j END AS j, ROUND(v, 6) AS v FROM ln JOIN h ON ln.patch_id = h.patch_id""")
def p16_augment_flip(spark, d):
    return P.to_long(P.augment_flip(_patches(spark, d), 8, 3), 8).select("patch_id", "i", "j", _r("v"))


def _unit(salt: int) -> str:
    return f"(({_hash('patch_id', 'i * 8 + j', chr(39) + '3' + chr(39), chr(39) + str(salt) + chr(39))} % 1000003 + 0.5) / CAST(1000003 AS DOUBLE))"


@query(f"WITH {LONG} SELECT patch_id, i, j, ROUND(v + sqrt(-2 * ln({_unit(1)})) * cos(2 * pi() * {_unit(2)}) * sqrt(CAST(0.01 AS DOUBLE)), 6) + 0.0 AS v FROM ln")
def p17_augment_noise(spark, d):
    return P.to_long(P.augment_noise(_patches(spark, d), 0.01, 3), 8).select("patch_id", "i", "j", _r("v"))


@query(f"""WITH {duck('f2')}, g AS (SELECT y AS cy, x AS cx, height, footprint, y % 3 AS city FROM f2 WHERE height > 10 AND height < 600 AND NOT (footprint >= 0 AND footprint < 0.2) AND NOT (footprint < 0.8 AND height > 20)),
n AS (SELECT cy, cx, COUNT(*) AS k FROM g JOIN f2 ON y BETWEEN cy - 1 AND cy + 1 AND x BETWEEN cx - 1 AND cx + 1 GROUP BY 1, 2)
SELECT g.city, g.cy, g.cx, (row_number() OVER (PARTITION BY city ORDER BY g.cy, g.cx) - 1) // 50 AS chunk FROM g JOIN n ON g.cy = n.cy AND g.cx = n.cx WHERE k = 9""")
def p18_patch_dataset(spark, d):
    f2 = stored(fixture(spark, d, "f2").select("y", "x", "height", "footprint"), "cells")
    px = f2.select(F.lit("height").alias("band"), "y", "x", F.col("height").alias("value"))
    labels = f2.select((F.col("y") % 3).alias("city"), "y", "x", "height", "footprint")
    return P.patch_dataset(px, labels, 3, 50, h_min=10.0, area_min=0.2).select("city", "cy", "cx", "chunk")


@query(f"WITH {duck('f2')}, {CUT} SELECT cy, cx, ROUND(SUM(height) - 10000.0 * (9 - COUNT(*)), 6) AS total FROM {_around(-1, 1)} GROUP BY 1, 2")
def p19_patch_exchange(spark, d):
    out = P.patch_exchange(_px(spark, d), _centers(spark, d), 3)
    return out.select("cy", "cx", F.round(F.aggregate("patch", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# ---------------------------------------------------------------- features
@query(f"WITH {LONG} SELECT patch_id, ROUND(AVG(v), 6) AS \"Mean\", ROUND(stddev_pop(v), 6) AS \"Std\", ROUND(MAX(v), 6) AS \"Max\", ROUND(MIN(v), 6) AS \"Min\", ROUND(quantile_cont(v, 0.5), 6) AS \"50pt\", ROUND(quantile_cont(v, 0.25), 6) AS \"25pt\", ROUND(quantile_cont(v, 0.75), 6) AS \"75pt\" FROM ln GROUP BY 1")
def x01_band_statistics(spark, d):
    return X.band_stats(_long(spark, d)).select("patch_id", *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in X.STATISTICS])


_NB = "ON a.patch_id = b.patch_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1"


def _morph_sql(first: str, second: str, src: str = "ln", name: str = "op") -> str:
    return f"{name}1 AS (SELECT a.patch_id, a.i, a.j, {first}(b.v) AS v FROM {src} a JOIN {src} b {_NB} GROUP BY 1, 2, 3), {name} AS (SELECT a.patch_id, a.i, a.j, {second}(b.v) AS v FROM {name}1 a JOIN {name}1 b {_NB} GROUP BY 1, 2, 3)"


@query(f"WITH {LONG}, {_morph_sql('MIN', 'MAX')} SELECT patch_id, i, j, ROUND(v, 6) AS v FROM op")
def x02_opening(spark, d):
    return X.opening(_long(spark, d), 3).select("patch_id", "i", "j", _r("v"))


@query(f"WITH {LONG}, {_morph_sql('MAX', 'MIN')} SELECT patch_id, i, j, ROUND(v, 6) AS v FROM op")
def x03_closing(spark, d):
    return X.closing(_long(spark, d), 3).select("patch_id", "i", "j", _r("v"))


def _rec_sql(sign: str) -> str:
    """Values spread from the marker to neighbours as far as the image lets them (sign: the image turned over)."""
    return f"""WITH RECURSIVE {LONG}, im AS (SELECT patch_id, i, j, {sign}v AS v FROM ln), er AS (SELECT a.patch_id, a.i, a.j, MIN(b.v) AS v FROM im a JOIN im b {_NB} GROUP BY 1, 2, 3),
rc(patch_id, i, j, v) AS (SELECT * FROM er UNION SELECT b.patch_id, b.i, b.j, least(a.v, b.v) FROM rc a JOIN im b {_NB} JOIN er m ON m.patch_id = b.patch_id AND m.i = b.i AND m.j = b.j WHERE least(a.v, b.v) > m.v)
SELECT patch_id, i, j, ROUND({sign}MAX(v), 6) + 0.0 AS v FROM rc GROUP BY 1, 2, 3"""


@query(_rec_sql(""))
def x04_opening_rec(spark, d):
    return X.opening_rec(_long(spark, d), 3).select("patch_id", "i", "j", _r("v"))


@query(_rec_sql("-"))
def x05_closing_rec(spark, d):
    return X.closing_rec(_long(spark, d), 3).select("patch_id", "i", "j", _r("v"))


SIZES = [1, 3, 5, 7, 9, 11, 13]


def _filter_sql(name: str, src: str, fn: str, r: int) -> str:
    """A square minimum or maximum, one direction after the other."""
    step = lambda out, src, c, o: f"{out} AS MATERIALIZED (SELECT a.patch_id, a.i, a.j, {fn}(b.v) AS v FROM {src} a, (SELECT unnest(range(-{r}, {r + 1})) AS d) o JOIN {src} b ON b.patch_id = a.patch_id AND b.{c} = a.{c} + d AND b.{o} = a.{o} GROUP BY 1, 2, 3)"
    return step(f"{name}r", src, "i", "j") + ", " + step(name, f"{name}r", "j", "i")


def _profiles_sql() -> str:
    """op: method, size, patch_id, i, j, v at all sizes."""
    parts, every = [], []
    for m, first, second in (("opening", "MIN", "MAX"), ("closing", "MAX", "MIN")):
        every.append(f"SELECT '{m}' AS m, 1 AS k, patch_id, i, j, v FROM ln")
        for k in SIZES[1:]:
            parts += [_filter_sql(f"{m}{k}a", "ln", first, k // 2), _filter_sql(f"{m}{k}", f"{m}{k}a", second, k // 2)]
            every.append(f"SELECT '{m}', {k}, patch_id, i, j, v FROM {m}{k}")
    return ", ".join(parts) + ", op AS (" + " UNION ALL ".join(every) + ")"


@query(f"WITH {LONG}, {_profiles_sql()} SELECT a.patch_id, CAST(b.k AS INTEGER) AS size, ROUND(AVG(abs(a.v - b.v)), 6) AS dmp FROM op a JOIN op b ON a.m = 'opening' AND b.m = 'opening' AND b.k = CASE a.k WHEN 1 THEN 3 ELSE a.k + 2 END AND a.patch_id = b.patch_id AND a.i = b.i AND a.j = b.j GROUP BY 1, 2")
def x06_dmp_mean(spark, d):
    return X.dmp_mean(_long(spark, d), SIZES).select("patch_id", "size", _r("dmp"))


_GLCM = f"""{LONG}, gl AS (SELECT patch_id, i, j, CAST(floor(round(v * 255) / 32) AS INTEGER) AS g FROM ln WHERE i BETWEEN 1 AND 5 AND j BETWEEN 1 AND 5),
pr AS (SELECT a.patch_id, a.g AS a, b.g AS b FROM gl a JOIN gl b ON a.patch_id = b.patch_id AND (b.i - a.i, b.j - a.j) IN ((0, 1), (1, 1), (1, 0), (1, -1))),
gm AS (SELECT patch_id, a, b, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY patch_id) AS p FROM pr GROUP BY 1, 2, 3)"""


@query(f"WITH {_GLCM} SELECT patch_id, a, b, ROUND(p, 6) AS p FROM gm")
def x07_glcm(spark, d):
    return X.glcm(_long(spark, d), 5, 8).select("patch_id", "a", "b", _r("p"))


_TEX = {
    "x08_glcm_mean": ("mean", "SUM(p) / 64"),
    "x09_glcm_variance": ("variance", "SUM(p * p) / 64 - (SUM(p) / 64) ** 2"),
    "x10_glcm_homogeneity": ("homogeneity", "SUM(p / (1 + (a - b) ** 2))"),
    "x11_glcm_contrast": ("contrast", "SUM(p * (a - b) ** 2)"),
    "x12_glcm_dissimilarity": ("dissimilarity", "SUM(p * abs(a - b))"),
    "x13_glcm_entropy": ("entropy", "SUM(-p * ln(p))"),
    "x14_glcm_2nd_moment": ("2nd_moment", "SUM(p * p)"),
    "x15_glcm_correlation": ("correlation", "coalesce(CASE WHEN abs((SUM(p * a * a) - SUM(p * a) ** 2) * (SUM(p * b * b) - SUM(p * b) ** 2)) > 1e-12 THEN (SUM(p * a * b) - SUM(p * a) * SUM(p * b)) / ((SUM(p * a * a) - SUM(p * a) ** 2) * (SUM(p * b * b) - SUM(p * b) ** 2)) END, 0)"),
}


def _texture(name, stat, sql):
    def run(spark, d):
        return X.texture(_long(spark, d), 5, 8, [stat]).select("patch_id", (F.round(F.col(f"`{stat}`"), 6) + F.lit(0.0)).alias("value"))

    run.__name__ = name
    query(f"WITH {_GLCM} SELECT patch_id, ROUND({sql}, 6) + 0.0 AS value FROM gm GROUP BY 1")(run)


for _name, (_stat, _sql) in _TEX.items():
    _texture(_name, _stat, _sql)

_W4 = "w4 AS (SELECT patch_id, i, j, v AS r, 1 - v AS g, v * v AS b, sqrt(v) AS nir FROM ln)"


def _wide(spark, d):
    v = F.col("v")
    return _long(spark, d).select("patch_id", "i", "j", v.alias("R"), (1 - v).alias("G"), (v * v).alias("B"), F.sqrt(v).alias("NIR"))


@query(f"WITH {LONG}, {_W4} SELECT patch_id, ROUND(AVG(CASE WHEN r + nir = 0 THEN 0 ELSE (r - nir) / (r + nir) END), 6) AS ndi_r_nir, ROUND(AVG(CASE WHEN g + b = 0 THEN 0 ELSE (g - b) / (g + b) END), 6) AS ndi_g_b, ROUND(AVG(0.2126 * r + 0.7152 * g + 0.0722 * b), 6) AS luminance FROM w4 GROUP BY 1")
def x16_spectral_features(spark, d):
    return X.spectral_features(_wide(spark, d)).select("patch_id", _r("ndi_R_NIR", 6, "ndi_r_nir"), _r("ndi_G_B", 6, "ndi_g_b"), _r("luminance"))


def _arrays(spark, d):
    """Patches with four bands, each a function of the values."""
    band = lambda f: F.transform("patch", f)
    return _patches(spark, d).select("patch_id", F.col("patch").alias("R"), band(lambda v: 1 - v).alias("G"), band(lambda v: v * v).alias("B"), band(lambda v: F.sqrt(v)).alias("NIR"))


# the bands from the first: an opening of 1 - v is 1 - the closing of v; v * v and sqrt(v) rise with v
_BANDS = (("R", "v", 0), ("G", "1 - v", 1), ("B", "v * v", 0), ("NIR", "sqrt(v)", 0))
_TEXTURE_SQL = dict(_TEX.values())


def _features_sql(windows: tuple, chosen: str = "") -> str:
    names = lambda b, k: f"'50pt@{b}@{k}'"
    parts = []
    stats = {"Mean": "AVG(v)", "Std": "stddev_pop(v)", "Max": "MAX(v)", "Min": "MIN(v)", "50pt": "quantile_cont(v, 0.5)", "25pt": "quantile_cont(v, 0.25)", "75pt": "quantile_cont(v, 0.75)"}
    for b, f, _ in _BANDS:
        parts += [f"SELECT patch_id, {names(b, k)} AS name, {q} AS x FROM (SELECT patch_id, {f} AS v FROM ln) GROUP BY 1" for k, q in stats.items()]
    f = {b: f"({f})" for b, f, _ in _BANDS}
    order = ("R", "G", "B", "NIR")
    for k, a in enumerate(order):
        parts += [f"SELECT patch_id, '50pt@spectral@ndi_{a}_{b}', AVG(CASE WHEN {f[a]} + {f[b]} = 0 THEN 0 ELSE ({f[a]} - {f[b]}) / ({f[a]} + {f[b]}) END) FROM ln GROUP BY 1" for b in order[k + 1 :]]
    parts.append(f"SELECT patch_id, '50pt@spectral@luminance', AVG(0.2126 * {f['R']} + 0.7152 * {f['G']} + 0.0722 * {f['B']}) FROM ln GROUP BY 1")
    for b, g, turned in _BANDS:
        for m in ("opening", "closing"):
            of = {"opening": "closing", "closing": "opening"}[m] if turned else m
            x, y = g.replace("v", "a.v"), g.replace("v", "b.v")
            parts.append(f"SELECT a.patch_id, '50pt@{b}@{m}@' || b.k || '@dmp', AVG(abs(({x}) - ({y}))) FROM op a JOIN op b ON a.m = '{of}' AND b.m = '{of}' AND b.k = CASE a.k WHEN 1 THEN 3 ELSE a.k + 2 END AND a.patch_id = b.patch_id AND a.i = b.i AND a.j = b.j GROUP BY a.patch_id, b.k")
    shape = []
    for b, g, _ in _BANDS:
        for w in windows:
            lo, hi = max(0, 3 - (w - 1) // 2), min(7, 3 + w // 2)
            t = f"{b}{w}"
            shape.append(f"""gl{t} AS (SELECT patch_id, i, j, CAST(floor(round(({g}) * 255) / 32) AS INTEGER) AS g FROM ln WHERE i BETWEEN {lo} AND {hi} AND j BETWEEN {lo} AND {hi}),
pr{t} AS (SELECT a.patch_id, a.g AS a, b.g AS b FROM gl{t} a, (VALUES (0, 1), (1, 1), (1, 0), (1, -1)) o(di, dj) JOIN gl{t} b ON a.patch_id = b.patch_id AND b.i = a.i + di AND b.j = a.j + dj),
gm{t} AS MATERIALIZED (SELECT patch_id, a, b, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY patch_id) AS p FROM pr{t} GROUP BY 1, 2, 3)""")
            parts += [f"SELECT patch_id, '50pt@{b}@w{w}@{s}', {q} FROM gm{t} GROUP BY 1" for s, q in _TEXTURE_SQL.items()]
    return f"WITH {LONG}, {_profiles_sql()}, {', '.join(shape)} SELECT patch_id, name, ROUND(x, 7) + 0.0 AS x FROM ({' UNION ALL '.join(parts)}) {chosen}"


@query(_features_sql((3, 5, 7)))
def x17_assemble_features(spark, d):
    """Every feature of every patch, by name."""
    out = X.patch_features(_arrays(spark, d), 8, "50pt", SIZES, [3, 5, 7])
    return out.select("patch_id", F.explode(F.arrays_zip("names", "features")).alias("f")).select("patch_id", F.col("f.names").alias("name"), _r("f.features", 7, "x"))


@query(_features_sql((3,), "WHERE name LIKE '%@R@%' AND name NOT LIKE '%closing%' AND name NOT LIKE '%@1_@dmp'"))
def x18_feature_dataset(spark, d):
    """The feature table of patches in long form."""
    long = _arrays(spark, d).select("patch_id", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("patch")) for b in ("R", "G", "B", "NIR")])).alias("s")).select("patch_id", "s.*")
    out = X.assemble_features(P.to_long(long, 8, keys=("patch_id", "band")), 8, "50pt", [1, 3, 5, 7, 9], [3], methods=("opening",))
    rows = out.select("patch_id", F.explode(F.arrays_zip("names", "features")).alias("f")).select("patch_id", F.col("f.names").alias("name"), _r("f.features", 7, "x"))
    return rows.filter("name like '%@R@%'")


@query(f"WITH {LONG} SELECT patch_id, ROUND(AVG(least(1.0, pow(10.0, (v * 30 - 30) / 10))), 6) AS \"VV\", ROUND(AVG(least(1.0, pow(10.0, (v * 20 - 20) / 10))), 6) AS \"VH\" FROM ln GROUP BY 1")
def x19_backscatter_features(spark, d):
    one = _long(spark, d, "VV").withColumn("v", F.col("v") * 30 - 30)
    two = _long(spark, d, "VH").withColumn("v", F.col("v") * 20 - 20)
    return X.backscatter_features(one.unionByName(two)).select("patch_id", _r("VV"), _r("VH"))


@query(f"WITH {LONG} SELECT patch_id, ROUND(MAX(v) - MIN(v), 6) AS span FROM ln GROUP BY 1")
def x20_registry(spark, d):
    own = {**X.STATISTICS, "Span": lambda c: F.max(c) - F.min(c)}
    return _long(spark, d).groupBy("patch_id").agg(X.pick(own, "Span")(F.col("v")).alias("span")).select("patch_id", _r("span"))


# ---------------------------------------------------------------- models
COLS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def _f5(spark, d):
    return fixture(spark, d, "f5")


@query(f"WITH {duck('f5')}, v AS (SELECT 'l_quantity' AS name, var_pop(l_quantity) AS v FROM f5 UNION ALL SELECT 'l_discount', var_pop(l_discount) FROM f5 UNION ALL SELECT 'flat', 0.0) SELECT name FROM v WHERE v > 1e-6")
def m01_variance_filter(spark, d):
    f5 = _f5(spark, d).withColumn("flat", F.lit(1.0))
    return spark.createDataFrame([(n,) for n in M.variance_filter(f5, ["l_quantity", "l_discount", "flat"])], "name string")


@query(f"WITH {duck('f5')}, s AS (SELECT AVG(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM f5) SELECT sample_id, ROUND((l_quantity - m) / d, 6) AS l_quantity FROM f5, s")
def m02_standardise(spark, d):
    f5 = _f5(spark, d)
    return M.standardise(f5, ["l_quantity"]).transform(f5).select("sample_id", _r("l_quantity"))


@query()
def m03_m04_preprocessors(spark, d):
    from pyspark.ml.functions import vector_to_array

    f5 = _f5(spark, d)
    return M.fit_preprocessors(f5, COLS, 3).transform(f5).select("sample_id", vector_to_array("features").alias("components"))


def _vvh(spark, d):
    px = fixture(spark, d, "f1").groupBy("scene_id", "y", "x").agg(*[F.avg(F.when(F.col("band") == b, F.col("value"))).alias(a) for a, b in (("vv_db", "view"), ("vh_db", "click"))]).dropna()
    return px.select(F.concat_ws("-", "scene_id", "y", "x").alias("sample_id"), S.backscatter(F.col("vv_db") / 10 - 30).alias("vv"), S.backscatter(F.col("vh_db") / 10 - 30).alias("vh")).withColumn("vvh", S.vvh("vv", "vh")).withColumn("h", -2 * F.pow("vvh", F.lit(0.4)) + 3)


@query("SELECT 'a' AS name, CAST(-2 AS DOUBLE) AS value UNION ALL SELECT 'b', CAST(0.4 AS DOUBLE) UNION ALL SELECT 'c', CAST(3 AS DOUBLE)")
def m05_vvh_fit(spark, d):
    """The heights are made from the curve -2 x^0.4 + 3, so the fit has to find these numbers."""
    p = M.vvh_fit(_vvh(spark, d))
    return spark.createDataFrame([(k, round(v, 2)) for k, v in p.items()], "name string, value double")


@query(f"""WITH {duck('f1')}, w AS (SELECT scene_id, y, x, AVG(CASE WHEN band = 'view' THEN value END) AS p, AVG(CASE WHEN band = 'click' THEN value END) AS q FROM f1 GROUP BY 1, 2, 3),
k AS (SELECT y, x, least(1.0, pow(10.0, (p / 10 - 30) / 10)) * pow(5.0, least(1.0, pow(10.0, (q / 10 - 30) / 10))) AS v FROM w WHERE p IS NOT NULL AND q IS NOT NULL),
m AS (SELECT v, -2 * pow(v, 0.4) + 3 + ((y * 7 + x * 13) % 11 - 5) / 200.0 AS h FROM k), g1 AS (SELECT (i - 200) / 20.0 AS b FROM range(401) r(i) WHERE i <> 200),
e1 AS (SELECT b, regr_slope(h, pow(v, b)) AS a, regr_intercept(h, pow(v, b)) AS c, regr_syy(h, pow(v, b)) * (1 - regr_r2(h, pow(v, b))) AS sse FROM m, g1 GROUP BY 1),
t1 AS (SELECT b FROM e1 WHERE abs(a) <= 100 AND abs(c) <= 100 ORDER BY sse LIMIT 1), g2 AS (SELECT b + (i - 100) / 2000.0 AS b FROM t1, range(201) r(i)),
e2 AS (SELECT b, regr_slope(h, pow(v, b)) AS a, regr_intercept(h, pow(v, b)) AS c, regr_syy(h, pow(v, b)) * (1 - regr_r2(h, pow(v, b))) AS sse FROM m, g2 GROUP BY 1),
t2 AS (SELECT b FROM e2 WHERE abs(a) <= 100 AND abs(c) <= 100 ORDER BY sse LIMIT 1), g3 AS (SELECT b + (i - 100) / 200000.0 AS b FROM t2, range(201) r(i)),
e3 AS (SELECT b, regr_slope(h, pow(v, b)) AS a, regr_intercept(h, pow(v, b)) AS c, regr_syy(h, pow(v, b)) * (1 - regr_r2(h, pow(v, b))) AS sse, COUNT(*) AS n FROM m, g3 GROUP BY 1)
SELECT CAST(ROUND(b, 2) AS DOUBLE) AS b, ROUND(sqrt(sse / n), 6) AS rmse FROM e3 WHERE abs(a) <= 100 AND abs(c) <= 100 ORDER BY sse LIMIT 1""")
def m05_vvh_fit_noisy(spark, d):
    """The exponent and the error of the curve fitted to heights that lie off it."""
    at = F.split("sample_id", "-")
    off = ((F.element_at(at, -2).cast("long") * 7 + F.element_at(at, -1).cast("long") * 13) % 11 - 5) / 200.0
    noisy = _vvh(spark, d).withColumn("h", F.col("h") + off)
    p = M.vvh_fit(noisy)
    return noisy.agg(F.round(F.lit(p["b"]), 2).alias("b"), F.round(F.sqrt(F.avg(F.pow(F.col("h") - M.vvh_predict("vvh", p), 2))), 6).alias("rmse"))


@query(f"""WITH {duck('f1')}, w AS (SELECT scene_id, y, x, AVG(CASE WHEN band = 'view' THEN value END) AS a, AVG(CASE WHEN band = 'click' THEN value END) AS b FROM f1 GROUP BY 1, 2, 3),
k AS (SELECT scene_id || '-' || y || '-' || x AS sample_id, least(1.0, pow(10.0, (a / 10 - 30) / 10)) * pow(5.0, least(1.0, pow(10.0, (b / 10 - 30) / 10))) AS v FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT sample_id, ROUND(1.5 * pow(v, 0.7) - 0.25, 6) AS height FROM k""")
def m06_vvh_predict(spark, d):
    return _vvh(spark, d).select("sample_id", F.round(M.vvh_predict("vvh", {"a": 1.5, "b": 0.7, "c": -0.25}), 6).alias("height"))


def _samples(spark, d):
    """Id, label and columns of the samples, joined and written once: learners pass over them several times."""
    return stored(_f5(spark, d).select("sample_id", S.log_target("y_true").alias("label"), *COLS), "samples")


def _training(spark, d):
    f5 = _samples(spark, d)
    prepared = M.fit_preprocessors(f5, COLS, 4)
    return prepared, prepared.transform(f5).select("sample_id", "label", "features")


@query()
def m07_random_forest(spark, d):
    _, df = _training(spark, d)
    return M.fit_rf(df, 10, 5).transform(df).select("sample_id", "prediction")


@query()
def m08_boosted_trees(spark, d):
    _, df = _training(spark, d)
    return M.fit_gbt(df, 5, 4).transform(df).select("sample_id", "prediction")


_EDGES = [[5.0 * k for k in range(1, 10)], [5.5 * k for k in range(1, 9)], [0.015, 0.035, 0.055, 0.075]]


@query(f"""WITH {duck('f5')}, r AS (SELECT AVG(y_true) AS m, COUNT(*) AS n FROM f5), e AS (SELECT 0 AS feature, unnest({_EDGES[0]}) AS t UNION ALL SELECT 1, unnest({_EDGES[1]}) UNION ALL SELECT 2, unnest({_EDGES[2]})),
v AS (SELECT 0 AS feature, l_quantity AS x, m - y_true AS g FROM f5, r UNION ALL SELECT 1, p_size, m - y_true FROM f5, r UNION ALL SELECT 2, l_tax, m - y_true FROM f5, r),
s AS (SELECT e.feature, t, SUM(g) FILTER (x <= t) AS gl, COUNT(*) FILTER (x <= t) AS hl, SUM(g) FILTER (x > t) AS gr, COUNT(*) FILTER (x > t) AS hr FROM e JOIN v USING (feature) GROUP BY 1, 2),
b AS (SELECT *, (gl * gl / (hl + 25.0) + gr * gr / (hr + 25.0) - power(gl + gr, 2) / (hl + hr + 25.0)) / 2 - 1.5 AS gain FROM s WHERE hl > 0 AND hr > 0 ORDER BY gain DESC, feature, t LIMIT 1)
SELECT CAST(feature AS INTEGER) AS feature, CAST(t AS DOUBLE) AS threshold, ROUND(gain, 2) AS gain, ROUND(-0.3 * gl / (hl + 25.0), 6) AS left_weight, ROUND(-0.3 * gr / (hr + 25.0), 6) AS right_weight FROM b""")
def m08_boosted_split(spark, d):
    """The first split of boosted trees, with its gain and weights under gamma 1.5 and an L2 term of 25, over all samples."""
    df = _f5(spark, d).withColumn("features", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "p_size", "l_tax")]))
    model = M.fit_gbt(df, 1, 1, gamma=1.5, rate=0.3, label="y_true", l2=25.0, edges=_EDGES)
    (_, _, feature, threshold, gain), weight = model.splits()[0], model.trees[0].weight
    return spark.createDataFrame([(feature, threshold, round(gain, 2), round(float(weight[1]), 6), round(float(weight[2]), 6))], "feature int, threshold double, gain double, left_weight double, right_weight double")


def _scaled(spark, d):
    f5 = _samples(spark, d)
    return M.standardise(f5, COLS).transform(f5)


@query()
def m09_bagged_kernel(spark, d):
    df = _scaled(spark, d)
    return M.predict_bagged_kernel(df, M.fit_bagged_kernel(df, COLS, 4, 0.2, 1.5), COLS, 1.5).select("sample_id", "prediction")


@query()
def m10_kernel_regression(spark, d):
    df = _scaled(spark, d)
    return M.fit_kernel(df, 48, 1.5, COLS).transform(df).select("sample_id", "prediction")


@query()
def m11_grid_search(spark, d):
    return M.grid_search_vvh(_vvh(spark, d), [2.0, 5.0, 8.0])


@query()
def m11_grid_search_ml(spark, d):
    """Cross-validated R2 of a linear model for each penalty, over contiguous folds."""
    from pyspark.ml.regression import LinearRegression

    _, df = _training(spark, d)
    fit = lambda train, penalty: LinearRegression(featuresCol="features", labelCol="label", regParam=penalty).fit(train).transform
    return M.search(df, fit, [{"penalty": p} for p in (0.0, 0.1, 10.0)], 3).groupBy("penalty").agg(F.avg("r2").alias("r2"))


@query(f"""WITH {duck('f5')}, n AS (SELECT *, (row_number() OVER (ORDER BY sample_id, l_tax, l_discount) - 1) * 3 // COUNT(*) OVER () AS fold FROM f5), k AS (SELECT DISTINCT fold AS f FROM n),
r AS (SELECT f, AVG(y_true) AS m FROM k JOIN n ON n.fold <> f GROUP BY 1), tr AS (SELECT r.f, m - y_true AS g, l_quantity, CAST(p_size AS DOUBLE) AS p_size, l_tax FROM r JOIN n ON n.fold <> f),
e AS (SELECT 0 AS feature, unnest({_EDGES[0]}) AS t UNION ALL SELECT 1, unnest({_EDGES[1]}) UNION ALL SELECT 2, unnest({_EDGES[2]})),
v AS (SELECT f, 0 AS feature, l_quantity AS x, g FROM tr UNION ALL SELECT f, 1, p_size, g FROM tr UNION ALL SELECT f, 2, l_tax, g FROM tr),
s AS (SELECT f, e.feature, t, SUM(g) FILTER (x <= t) AS gl, COUNT(*) FILTER (x <= t) AS hl, SUM(g) FILTER (x > t) AS gr, COUNT(*) FILTER (x > t) AS hr FROM e JOIN v USING (feature) GROUP BY 1, 2, 3),
b AS (SELECT s.*, l2 FROM s, (SELECT unnest([1.0, 500.0, 20000.0]) AS l2) WHERE hl > 0 AND hr > 0 QUALIFY row_number() OVER (PARTITION BY f, l2 ORDER BY gl * gl / (hl + l2) + gr * gr / (hr + l2) - power(gl + gr, 2) / (hl + hr + l2) DESC, feature, t) = 1),
p AS (SELECT b.l2, n.fold, y_true, m - 0.5 * CASE WHEN CASE feature WHEN 0 THEN l_quantity WHEN 1 THEN p_size ELSE l_tax END <= t THEN gl / (hl + l2) ELSE gr / (hr + l2) END AS y_fit FROM n JOIN b ON b.f = n.fold JOIN r ON r.f = n.fold)
SELECT CAST(l2 AS DOUBLE) AS l2, CAST(fold AS INTEGER) AS fold, ROUND(1 - SUM(power(y_true - y_fit, 2)) / (SUM(y_true * y_true) - power(SUM(y_true), 2) / COUNT(*)), 6) AS r2 FROM p GROUP BY 1, 2""")
def m11_search_boosted(spark, d):
    """L2 terms of boosted trees searched over contiguous folds: one split from given edges, so that SQL can fit it as well."""
    df = _f5(spark, d).withColumn("features", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "p_size", "l_tax")])).select("sample_id", "l_tax", "l_discount", "y_true", "features")
    fit = lambda train, l2: M.fit_gbt(train, 1, 1, rate=0.5, label="y_true", l2=l2, edges=_EDGES).transform
    return M.search(df, fit, [{"l2": v} for v in (1.0, 500.0, 20000.0)], 3, ("sample_id", "l_tax", "l_discount"), "y_true").select("l2", "fold", _r("r2"))


@query()
def m11_search_learners(spark, d):
    """Forests, boosted trees and bags of kernel regressions, two settings each, over two contiguous folds."""
    samples = _samples(spark, d)
    dealt = stored(M.folds(samples, 2, ["sample_id"]), "folds")
    df = stored(M.fit_preprocessors(samples, COLS, 4).transform(dealt).select("label", "features", "fold"), "features")  # each fit passes over it many times
    forest = M.search(df, lambda train, depth: M.fit_rf(train, 8, int(depth)).transform, [{"depth": v} for v in (2.0, 6.0)], 2).select(F.lit("forest").alias("learner"), F.col("depth").alias("setting"), "fold", "r2")
    boosted = M.search(df, lambda train, gamma: M.fit_gbt(train, 4, 3, gamma=gamma).transform, [{"gamma": v} for v in (0.0, 50.0)], 2).select(F.lit("boosted").alias("learner"), F.col("gamma").alias("setting"), "fold", "r2")
    flat = M.standardise(samples, COLS).transform(dealt)
    bag = lambda train, width: lambda rows: M.predict_bagged_kernel(rows, M.fit_bagged_kernel(train, COLS, 3, 0.3, width), COLS, width)
    bags = M.search(flat, bag, [{"width": v} for v in (1.5, 4.0)], 2).select(F.lit("bags").alias("learner"), F.col("width").alias("setting"), "fold", "r2")
    return forest.unionByName(boosted).unionByName(bags)


@query(f"WITH {duck('f5')}, s AS (SELECT split_part(grp, '@', 1) AS p, split_part(grp, '@', 2) AS fold, AVG(y_pred) AS r2 FROM f5 GROUP BY 1, 2), o AS (SELECT p, AVG(r2) AS mean, stddev_pop(r2) AS std FROM s GROUP BY 1) SELECT p, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, CAST(rank() OVER (ORDER BY ROUND(mean, 12) DESC) AS INTEGER) AS rank FROM o")
def m12_cv_report(spark, d):
    scores = _f5(spark, d).groupBy(S.regex_key("grp", "^([^@]*)").alias("p"), S.regex_key("grp", r"@(\d+)$").alias("fold")).agg(F.avg("y_pred").alias("r2"))
    return M.cv_report(scores, ["p"]).select("p", _r("mean"), _r("std"), "rank")


def _mean_model():
    return lambda batch: batch.mean(axis=1)


def _two_outputs():
    def predict(batch):
        return {"footprint": batch.mean(axis=1), "height": 100 * batch.max(axis=1)}

    return predict


@query(f"WITH {LONG} SELECT patch_id, ROUND(AVG(v), 6) AS prediction FROM ln GROUP BY 1")
def m13_score_patches(spark, d):
    return M.score_patches(_patches(spark, d), _mean_model, "patch", 128).select("patch_id", _r("prediction"))


@query(f"""WITH {duck('f2')}, {CUT}, p AS (SELECT cy, cx, AVG(least(1.0, pow(10.0, (height - 60) / 10))) AS vv, AVG(least(1.0, pow(10.0, (footprint * 10 - 30) / 10))) AS vh FROM {_around(-1, 1)} GROUP BY 1, 2)
SELECT cy, cx, ROUND(exp(0.5 * pow(vv * pow(5.0, vh), 0.4) + 1), 6) AS height FROM p""")
def m15_predict_vvh(spark, d):
    f2 = fixture(spark, d, "f2")
    px = f2.select(F.lit("VV").alias("band"), "y", "x", (F.col("height") - 60).alias("value")).unionByName(f2.select(F.lit("VH").alias("band"), "y", "x", (F.col("footprint") * 10 - 30).alias("value")))
    return M.predict_vvh(px, _centers(spark, d), {"a": 0.5, "b": 0.4, "c": 1.0}, 3).select("cy", "cx", _r("height"))


@query(f"""WITH {duck('f2')}, f2c AS (SELECT y AS cy, x AS cx FROM f2), px AS (SELECT 'VV' AS band, y, x, height - 60 AS v FROM f2 UNION ALL SELECT 'VH', y, x, footprint * 10 - 30 FROM f2), {_windows_sql('px', 3, -1)},
p AS (SELECT cy, cx, AVG(CASE WHEN band = 'VV' THEN least(1.0, pow(10.0, v / 10)) END) AS vv, AVG(CASE WHEN band = 'VH' THEN least(1.0, pow(10.0, v / 10)) END) AS vh FROM wf GROUP BY 1, 2)
SELECT cy, cx, ROUND(exp(0.5 * pow(vv * pow(5.0, vh), 0.4) + 1), 6) AS height FROM p""")
def m15_predict_vvh_extent(spark, d):
    """The heights of the raster's extent, which both bands must cover, holes filled."""
    f2 = fixture(spark, d, "f2")
    box = f2.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()
    px = f2.select(F.lit("VV").alias("band"), "y", "x", (F.col("height") - 60).alias("value")).unionByName(f2.select(F.lit("VH").alias("band"), "y", "x", (F.col("footprint") * 10 - 30).alias("value")))
    return M.predict_vvh(px, _centers(spark, d), {"a": 0.5, "b": 0.4, "c": 1.0}, 3, extent=tuple(box), fill=True).select("cy", "cx", _r("height"))


@query()
def m16_predict_ml(spark, d):
    """From pixels to heights: windows, features, preparation, forest."""
    f2 = stored(fixture(spark, d, "f2").select("y", "x", "height", "footprint"), "cells")
    options = {"size": 3, "bands": ["R", "NIR"], "sizes": [1, 3], "windows": [3]}
    table = stored(M.feature_columns(_bands(f2), f2.select(F.col("y").alias("cy"), F.col("x").alias("cx")), **options), "features")
    labels = f2.select(F.col("y").alias("cy"), F.col("x").alias("cx"), S.log_target(F.col("height") + 1).alias("label"))
    prepared = M.fit_preprocessors(table, [c for c in table.columns if c not in ("cy", "cx")], 4)
    model = M.fit_rf(prepared.transform(table).join(labels, ["cy", "cx"]).select("features", "label"), 5, 4)
    return M.predict_ml(table, prepared, model).select("cy", "cx", "height")


def _two_bands(spark, d):
    return _bands(fixture(spark, d, "f2"))


def _bands(f2):
    return f2.select(F.lit("R").alias("band"), "y", "x", F.col("height").alias("value")).unionByName(f2.select(F.lit("NIR").alias("band"), "y", "x", F.col("footprint").alias("value")))


_SCALED = """px AS (SELECT 'R' AS band, y, x, height AS v FROM f2 UNION ALL SELECT 'NIR', y, x, footprint FROM f2),
st AS (SELECT band, MIN(v) AS lo, quantile_cont(v, 0.98) - quantile_cont(v, 0.02) AS span FROM px GROUP BY 1),
sc AS (SELECT px.band, y, x, least(1.0, greatest(0.0, (v - lo) / span)) AS v FROM px JOIN st ON px.band = st.band)"""


@query(f"""WITH {duck('f2')}, {CUT}, {_SCALED}, {_windows_sql('sc', 3, -1)}, m AS (SELECT cy, cx, AVG(floor(v * 255) / 255.0) AS m FROM wf GROUP BY 1, 2)
SELECT cy, cx, ROUND(CASE WHEN m > 0.6 THEN 0.6 WHEN m < 0 THEN 0 ELSE m END, 6) AS value FROM m""")
def m17_predict_single(spark, d):
    return M.predict_single(_two_bands(spark, d), _centers(spark, d), _mean_model, 3, ["R", "NIR"], hi=0.6).select("cy", "cx", _r("value"))


@query(f"""WITH {duck('f2')}, {CUT}, {_SCALED}, {_windows_sql('sc', 3, -1)}, m AS (SELECT cy, cx, AVG(floor(v * 255) / 255.0) AS m, 100 * MAX(floor(v * 255) / 255.0) AS t FROM wf GROUP BY 1, 2)
SELECT cy, cx, ROUND(CASE WHEN m > 1 THEN 1 WHEN m < 0 THEN 0 ELSE m END, 6) AS footprint, ROUND(CASE WHEN t > 80 THEN 80 WHEN t < 0 THEN 0 ELSE t END, 6) AS height FROM m""")
def m18_predict_multi(spark, d):
    out = M.predict_multi(_two_bands(spark, d), _centers(spark, d), _two_outputs, 3, ["R", "NIR"], h_max=80.0)
    return out.select("cy", "cx", _r("footprint"), _r("height"))


@query(f"""WITH {duck('f1')}, f2c AS (SELECT DISTINCT y AS cy, x AS cx FROM f1), cm AS (SELECT band, y, x, quantile_cont(value, 0.5) / 100 AS v FROM f1 WHERE band IN ('view', 'click') AND cloud < 60 GROUP BY 1, 2, 3),
{_windows_sql('cm', 3, -1)}, m AS (SELECT cy, cx, AVG(v) AS m, 100 * MAX(v) AS t FROM wf GROUP BY 1, 2 HAVING COUNT(*) = 18)
SELECT cy // 20 AS region_y, cx // 20 AS region_x, 'footprint' AS variable, cy AS y, cx AS x, ROUND(least(1.0, greatest(0.0, m)), 6) AS value FROM m
UNION ALL SELECT cy // 20, cx // 20, 'height', cy, cx, ROUND(least(100.0, greatest(2.0, t)), 6) FROM m""")
def m19_tiled_map(spark, d):
    obs = fixture(spark, d, "f1").withColumn("value", F.col("value") / 100)
    centers = obs.select(F.col("y").alias("cy"), F.col("x").alias("cx")).distinct()
    out = M.tiled_map(obs, centers, _two_outputs, 3, ["view", "click"], block=20, max_cloud=60, h_min=2.0, h_max=100.0)
    return out.select("region_y", "region_x", "variable", "y", "x", _r("value"))
