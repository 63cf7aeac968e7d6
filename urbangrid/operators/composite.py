"""Scene selection, cloud and shadow masking, composites over time.

Pixels are rows (scene_id, band, y, x, value).  Neighbourhoods and shadows are made by exploding each cell to the few cells it reaches and an
equi-join or aggregate on the cell, so no plan compares cells pairwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("scene_id", "y", "x")


def filter_scenes(meta: DataFrame, pol: tuple = ("VV", "VH"), mode: str = "IW", max_cloud: float = 20) -> DataFrame:
    """Scenes with all polarisations, the mode and less cloud than max_cloud."""
    has = F.lit(True)
    for p in pol:
        has = has & F.array_contains("pol", p)
    return meta.filter(has & (F.col("mode") == mode) & (F.col("cloudy_pct") < max_cloud))


def year_window(meta: DataFrame, year: int, lo: int, hi: int, time: str = "acquired") -> DataFrame:
    """Scenes of the year (clamped to lo..hi) from January 1 up to, and without, December 31."""
    y = min(max(year, lo), hi)
    return meta.filter((F.col(time) >= F.lit(f"{y}-01-01").cast("timestamp")) & (F.col(time) < F.lit(f"{y}-12-31").cast("timestamp")))


def _between(time: str, a: str, b: str) -> Column:
    return (F.col(time) >= F.lit(a).cast("timestamp")) & (F.col(time) < F.lit(b).cast("timestamp"))


def season_window(meta: DataFrame, year: int, lat: str = "lat", time: str = "acquired") -> DataFrame:
    """Radar season by hemisphere: north December 1 to March 1, south June 1 to September 1."""
    north = F.col(lat) > 0
    return meta.filter((north & _between(time, f"{year}-12-01", f"{year + 1}-03-01")) | (~north & _between(time, f"{year}-06-01", f"{year}-09-01")))


def season_rank(meta: DataFrame, year: int, lat: str = "lat", time: str = "acquired") -> DataFrame:
    """Optical seasons with `season` and `season_rank`: north autumn before spring, south spring before autumn; other scenes go."""
    spring, autumn = _between(time, f"{year}-03-01", f"{year}-06-01"), _between(time, f"{year}-09-01", f"{year}-12-01")
    kept = meta.filter(spring | autumn).withColumn("season", F.when(spring, "spr").otherwise("aut"))
    return kept.withColumn("season_rank", F.when((F.col(lat) > 0) == (F.col("season") == "aut"), 0).otherwise(1))


def padded(extent: tuple, padding) -> tuple:
    """(x_min, y_min, x_max, y_max) grown by a number or (dx, dy)."""
    dx, dy = padding if isinstance(padding, (tuple, list)) else (padding, padding)
    return extent[0] - dx, extent[1] - dy, extent[2] + dx, extent[3] + dy


def filter_bounds(meta: DataFrame, extent: tuple, padding=0.0) -> DataFrame:
    """Scenes whose box touches the padded extent (columns x_min, x_max and, where there, y_min, y_max)."""
    x0, y0, x1, y1 = padded(extent, padding)
    touch = (F.col("x_max") >= x0) & (F.col("x_min") <= x1)
    if {"y_min", "y_max"} <= set(meta.columns):
        touch = touch & (F.col("y_max") >= y0) & (F.col("y_min") <= y1)
    return meta.filter(touch)


def composite(px: DataFrame, how: str = "percentile", p: float = 50, approx: bool = False, by: tuple = ("band", "y", "x")) -> DataFrame:
    """Per band and cell over scenes: the p-th percentile (linear between ranks) or the mean."""
    if how == "mean":
        value = F.avg("value")
    elif approx:
        value = F.percentile_approx("value", p / 100)
    else:
        value = F.percentile("value", F.lit(p / 100))
    return px.groupBy(*by).agg(value.alias("value"))


SKETCH_K = 512  # a cell's quantiles are values of the cell at their rank while it has at most this many; above, ranks are off by about 1.6 / k


def sketch_composite(px: DataFrame, k: int = SKETCH_K, by: tuple = ("band", "y", "x")) -> DataFrame:
    """Per band and cell a quantile sketch (KLL) of its values, at most a few times k numbers however many scenes there are.

    Null and NaN are no values; a cell without any keeps its row, with an empty sketch.
    """
    value = F.col("value").cast("double")
    return px.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(value), value), k).alias("sketch"))


def merge_sketches(*sketches: DataFrame, k: int = SKETCH_K, by: tuple = ("band", "y", "x")) -> DataFrame:
    """One sketch for each cell from tables of sketches: those of new scenes are merged with those kept, and no old scene is read."""
    return reduce(DataFrame.unionByName, [s.select(*by, "sketch") for s in sketches]).groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_percentile(sketches: DataFrame, p: float | list[float] = 50) -> DataFrame:
    """The p-th percentile of each cell's sketch, a value of the cell (the first whose rank reaches p), or an array for several; null for a cell without values."""
    ranks = F.array(*[F.lit(q / 100) for q in p]) if isinstance(p, list) else F.lit(p / 100)
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.withColumn("value", F.when(some, F.kll_sketch_get_quantile_double("sketch", ranks))).drop("sketch")


def join_first(left: DataFrame, right: DataFrame, left_on: str, right_on: str, order_by: list[str]) -> DataFrame:
    """Each left row with the first right row of its key in the given order; left rows without one go."""
    kept = [c for c in right.columns if c != right_on]
    first = right.groupBy(right_on).agg(F.min_by(F.struct(*kept), F.struct(*order_by)).alias("__first"))
    return left.join(first, left[left_on] == first[right_on]).select(*left.columns, "__first.*")


def cloud_flag(px: DataFrame, prob: str = "cloud", threshold: float = 50) -> DataFrame:
    """Adds cloud_flag: 1 where the probability is above the threshold, else 0."""
    return px.withColumn("cloud_flag", F.when(F.col(prob) > threshold, 1).otherwise(0))


def dark_pixel(px: DataFrame, nir: str = "nir", land: str = "scl", nir_dark: float = 0.15, scale: float = 1e4, water: int = 6) -> DataFrame:
    """Adds dark: near infrared below nir_dark * scale on land."""
    return px.withColumn("dark", ((F.col(nir) < nir_dark * scale) & (F.col(land) != water)).cast("int"))


def project_shadow(px: DataFrame, azimuth: str = "azimuth", dist: float = 1.5, flag: str = "cloud_flag") -> DataFrame:
    """Distinct cells (scene_id, y, x) that lie within dist * 10 steps from a cloud cell along 90 - azimuth degrees."""
    a = F.radians(90 - F.col(azimuth))
    k = F.explode(F.sequence(F.lit(1), F.lit(int(dist * 10))))
    step = px.filter(F.col(flag) == 1).select("scene_id", "y", "x", azimuth, k.alias("k"))
    return step.select("scene_id", (F.col("y") - F.round(F.col("k") * F.sin(a)).cast("long")).alias("y"), (F.col("x") + F.round(F.col("k") * F.cos(a)).cast("long")).alias("x")).distinct()


def shadow_flag(px: DataFrame, dist: float = 1.5) -> DataFrame:
    """Adds projected (0/1) and shadow_flag = projected and dark."""
    reach = project_shadow(px, dist=dist).withColumn("projected", F.lit(1))
    out = px.join(reach, list(CELL), "left").withColumn("projected", F.coalesce("projected", F.lit(0)))
    return out.withColumn("shadow_flag", F.col("projected") * F.col("dark"))


def focal(px: DataFrame, fn: str, radius: float = 1.5, value: str = "value", keys: tuple = ("scene_id",)) -> DataFrame:
    """Minimum, maximum or mean of the present cells within a square of int(radius) cells to each side, for every present cell."""
    r = int(radius)
    cells = px.select(*keys, "y", "x", value)
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-r, r + 1) for dx in range(-r, r + 1)])
    spread = cells.select(*keys, "y", "x", value, F.explode(near).alias("o")).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), value, ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("own"))
    agg = {"min": F.min, "max": F.max, "avg": F.avg}[fn]
    # a cell gets its neighbours by one aggregate; cells that are not present themselves have no own row
    return spread.groupBy(*keys, "y", "x").agg(agg(value).alias(value), F.max("own").alias("own")).filter("own").drop("own")


def opened_mask(px: DataFrame, value: str = "value", radius: float = 1.5) -> DataFrame:
    """Focal minimum, then focal maximum."""
    return focal(focal(px, "min", radius, value), "max", radius, value)


def cloudy_percentage(px: DataFrame, mask: str = "mask", area: str | None = None, footprint: str | None = None) -> DataFrame:
    """scene_id, cloudy: 100 * masked area / footprint area (cells count as 1, and the footprint as all cells, where not given)."""
    a = F.col(area) if area else F.lit(1.0)
    whole = F.max(footprint) if footprint else F.sum(a)
    return px.groupBy("scene_id").agg((100 * F.try_divide(F.sum(F.col(mask) * a), whole)).alias("cloudy"))


def quality_score(px: DataFrame, cloud: str = "cloud_score", shadow: str = "shadow_flag") -> DataFrame:
    """scene_id, y, x, score: minus the 3 x 3 mean of the greater of cloud score and shadow flag, to nine decimals, so that equal means are ties."""
    worst = px.withColumn("value", F.greatest(F.col(cloud).cast("double"), F.col(shadow).cast("double")))
    return focal(worst, "avg", 1, "value").select(*CELL, (-F.round("value", 9)).alias("score"))


def adaptive_threshold(px: DataFrame, lo: int = 20, hi: int = 80, step: int = 5, keep: float = 2.0) -> DataFrame:
    """The first (season_rank, threshold) for which some scene is less than `keep` percent cloudy; all thresholds in one pass.

    px: scene_id, y, x, cloud, season_rank.  A cell is cloudy at a threshold when its opened flag is set.  Gives season_rank, threshold,
    n_scenes; no row where none fits.
    """
    keys = ("season_rank", "scene_id")
    # minimum and maximum commute with a threshold, so the score is opened once and compared with every threshold
    opened = focal(focal(px.withColumn("value", F.col("cloud")), "min", 1, "value", keys), "max", 1, "value", keys)
    every = [*range(lo, hi + 1, step)]
    shares = opened.groupBy(*keys).agg(F.array(*[F.struct(F.lit(t).alias("threshold"), (100 * F.avg((F.col("value") > t).cast("int"))).alias("cloudy")) for t in every]).alias("s"))
    share = shares.select(*keys, F.explode("s").alias("s")).select(*keys, "s.*").filter(F.col("cloudy") < keep)
    fits = share.groupBy("season_rank", "threshold").agg(F.count("*").alias("n_scenes"))
    return fits.groupBy().agg(F.min(F.struct("season_rank", "threshold", "n_scenes")).alias("best")).filter("best is not null").select("best.*")


def quality_mosaic(px: DataFrame, score: str, bands: list[str]) -> DataFrame:
    """Per cell, all bands of the scene with the highest score (ties: the greater scene_id)."""
    best = F.max_by(F.struct("scene_id", *bands), F.struct(score, "scene_id"))
    return px.groupBy("y", "x").agg(best.alias("b")).select("y", "x", "b.*")


def ordered_mosaic(px: DataFrame, order: list[str], value: str = "value", by: tuple = ("band", "y", "x")) -> DataFrame:
    """Per cell, the last value that is not null in the given order."""
    return px.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def stack_bands(px: DataFrame, names: list[str], by: tuple = ("y", "x")) -> DataFrame:
    """One wide row for each cell, bands as float columns."""
    return px.groupBy(*by).agg(*[F.max(F.when(F.col("band") == n, F.col("value"))).cast("float").alias(n) for n in names])


def _in_cities(obs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Observations in the boxes of the manifest (city, x_lo, x_hi, y_lo, y_hi): a job list, short by nature, sent to every task
    only by the planner's own size check; cells meet their box by an equi-join on blocks of 16 cells."""
    tile = 16
    boxes = manifest.withColumn("ty", F.explode(F.sequence(F.floor(F.col("y_lo") / tile), F.floor(F.col("y_hi") / tile)))).withColumn("tx", F.explode(F.sequence(F.floor(F.col("x_lo") / tile), F.floor(F.col("x_hi") / tile))))
    cells = obs.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    return cells.join(boxes, ["ty", "tx"]).filter(F.col("y").between(F.col("y_lo"), F.col("y_hi")) & F.col("x").between(F.col("x_lo"), F.col("x_hi"))).drop("ty", "tx", "x_lo", "x_hi", "y_lo", "y_hi")


def composite_s1(obs: DataFrame, manifest: DataFrame, bands: tuple = ("VV", "VH"), p: float = 50) -> DataFrame:
    """Radar composite of every manifest city in one plan: city, band, y, x, value."""
    return composite(_in_cities(obs.filter(F.col("band").isin(*bands)), manifest), p=p, by=("city", "band", "y", "x"))


def composite_s2(obs: DataFrame, manifest: DataFrame, bands: tuple = ("R", "G", "B", "NIR"), max_cloud: float = 20) -> DataFrame:
    """Optical median composite of clear observations for every manifest city in one plan."""
    clear = obs.filter(F.col("band").isin(*bands) & (F.col("cloud") < max_cloud))
    return composite(_in_cities(clear, manifest), p=50, by=("city", "band", "y", "x"))


def clip_dem(dem: DataFrame, manifest: DataFrame, padding: int = 0) -> DataFrame:
    """Elevation cells in the padded box of every manifest city."""
    grown = manifest.select("city", *[(F.col(c) + (padding if c.endswith("hi") else -padding)).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")])
    return _in_cities(dem, grown)


def cloud_free_composite(px: DataFrame, bands: list[str], threshold: float = 50, nir_dark: float = 0.15, scale: float = 1e4, dist: float = 1.5) -> DataFrame:
    """One cloud-free value for each cell: clouds, dark cells, shadows, quality score, best scene.

    px: scene_id, y, x, cloud, azimuth, scl, nir and the bands.
    """
    flagged = shadow_flag(dark_pixel(cloud_flag(px, "cloud", threshold), "nir", "scl", nir_dark, scale), dist).withColumn("cloud_score", F.col("cloud") / 100)
    scored = flagged.join(quality_score(flagged), list(CELL))
    return quality_mosaic(scored, "score", bands)


def output_name(df: DataFrame, city: str, year: str, kind: str = "sentinel_1", p: int = 50, extent: tuple | None = None, precision: int = 2) -> DataFrame:
    """Adds name: city_year_kind_NNpt, with the rounded extent where its four columns are given."""
    parts = [F.col(city).cast("string"), F.col(year).cast("string"), F.lit(kind), F.lit(f"{p}pt")]
    if extent:
        parts += [F.format_string(f"%.{precision}f", F.round(F.col(c), precision)) for c in extent]
    return df.withColumn("name", F.concat_ws("_", *parts))
