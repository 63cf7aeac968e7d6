"""Summaries of finished maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import select_tiles
from .grid import clip_raster


def get_by_extent(df: DataFrame, variable: str, extent: tuple, cells: tuple[int, int, int, int], nodata: float = -255.0) -> DataFrame:
    """y, x, value of one variable within the extent: tiles are pruned first, later tiles win, the rest is clipped; no-data is null."""
    tiles = select_tiles(df, extent)
    px = tiles.select("y", "x", F.when(F.col(variable) != nodata, F.col(variable)).alias("value"), "lat_tile", "lon_tile").filter("value is not null")
    one = px.groupBy("y", "x").agg(F.max_by("value", F.struct("lat_tile", "lon_tile")).alias("value"))
    return clip_raster(one, cells)


def raster_to_points(px: DataFrame, grid: dict, extent: tuple | None = None, value: str = "value") -> DataFrame:
    """lon, lat, value of the centres of cells above 0, within the extent (lon_min, lat_min, lon_max, lat_max) where given; a side that is None is open."""
    out = px.filter(F.col(value) > 0).select((F.lit(grid["x0"]) + (F.col("x") + 0.5) * grid["dx"]).alias("lon"), (F.lit(grid["y0"]) - (F.col("y") + 0.5) * grid["dy"]).alias("lat"), F.col(value).alias("value"))
    for c, side, within in zip(("lon", "lat", "lon", "lat"), extent or (), ("__ge__", "__ge__", "__le__", "__le__")):
        if side is not None:
            out = out.filter(getattr(F.col(c), within)(side))
    return out


def hexbin(points: DataFrame, radius: float, lo: float = 3.0, hi: float = 30.0, lat0: float | None = None) -> DataFrame:
    """q, t (axial hexagon key), n, mean_height, mean_clipped of points with value >= lo; radius in metres.

    lat0 is the latitude at which a degree of longitude is measured (the mean latitude where not given).
    """
    kept = points.filter(F.col("value") >= lo)
    if lat0 is None:
        lat0 = kept.agg(F.avg("lat")).first()[0] or 0.0
    x, y = F.col("lon") * (111320.0 * math.cos(math.radians(lat0))), F.col("lat") * 110540.0
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / radius, (y * (2 / 3)) / radius
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    key_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    key_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return kept.groupBy(key_q.cast("long").alias("q"), key_r.cast("long").alias("t")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_height"), F.avg(F.least(F.lit(hi), F.greatest(F.lit(lo), "value"))).alias("mean_clipped"))


def joint_histogram(px: DataFrame, bins: int, height_range: tuple, footprint_range: tuple) -> DataFrame:
    """footprint_bin, height_bin, n, density = n / (all * bin area) of cells in both ranges with a height above 0; the last bin is closed."""
    (h0, h1), (f0, f1) = height_range, footprint_range
    kept = px.filter((F.col("height") > 0) & F.col("height").between(h0, h1) & F.col("footprint").between(f0, f1))
    number = lambda c, lo, hi: F.least(F.lit(bins), F.width_bucket(F.col(c), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))) - 1
    counts = kept.groupBy(number("footprint", f0, f1).alias("footprint_bin"), number("height", h0, h1).alias("height_bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    area = (h1 - h0) / bins * ((f1 - f0) / bins)
    return counts.withColumn("density", F.col("n") / (F.lit(total) * area))
