"""Regular grids: cells, centres, blocks, extents, clipping, resampling, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def layer_extent(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounding box of boxes (x_min, y_min, x_max, y_max)."""
    return df.groupBy(*(by or [])).agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def cell_count(length: float, step: float) -> int:
    return math.ceil(round(round(length, 6) / step, 6))


def fishnet(spark: SparkSession, extent: tuple, height: float, width: float) -> DataFrame:
    """cell_id (row by row from the top), y, x and the cell's box."""
    x0, y0, x1, y1 = extent
    nrow, ncol = cell_count(y1 - y0, height), cell_count(x1 - x0, width)
    cell = spark.range(nrow * ncol).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / ncol).alias("y"), (F.col("id") % ncol).alias("x"))
    return cell.select("*", (F.lit(x0) + F.col("x") * width).alias("x_min"), (F.lit(x0) + (F.col("x") + 1) * width).alias("x_max"), (F.lit(y1) - (F.col("y") + 1) * height).alias("y_min"), (F.lit(y1) - F.col("y") * height).alias("y_max"))


def grid_centers(spark: SparkSession, extent: tuple, res: float) -> DataFrame:
    """y, x, lon, lat of cell centres, row by row from the top."""
    x0, y0, x1, y1 = extent
    nrow, ncol = round((y1 - y0) / res), round((x1 - x0) / res)
    cell = spark.range(nrow * ncol).select(F.floor(F.col("id") / ncol).alias("y"), (F.col("id") % ncol).alias("x"))
    return cell.select("y", "x", (F.lit(x0) + res * (F.col("x") + 0.5)).alias("lon"), (F.lit(y1) - res * (F.col("y") + 0.5)).alias("lat"))


def block_of(i: Column, n: int, n_sub: int) -> Column:
    """Block of position i when n positions are split evenly into n_sub blocks, the first n % n_sub one longer."""
    size, extra = divmod(n, n_sub)
    return F.when(i < extra * (size + 1), F.floor(i / (size + 1))).otherwise(extra + F.floor((i - extra * (size + 1)) / max(1, size)))


def split_region(df: DataFrame, nrow: int, ncol: int, n_sub: int) -> DataFrame:
    """Adds block_y, block_x: n_sub by n_sub blocks; the pair is a partition key."""
    return df.withColumn("block_y", block_of(F.col("y"), nrow, n_sub)).withColumn("block_x", block_of(F.col("x"), ncol, n_sub))


def split_extent(spark: SparkSession, extent: tuple, dx: float, dy: float) -> DataFrame:
    """Sub-regions of dx by dy: region, and its box, cut at the extent."""
    x0, y0, x1, y1 = extent
    nx, ny = cell_count(x1 - x0, dx), cell_count(y1 - y0, dy)
    cell = spark.range(nx * ny).select(F.col("id").alias("region"), F.floor(F.col("id") / nx).alias("r"), (F.col("id") % nx).alias("c"))
    least = lambda lo, k, step, hi: F.least(F.lit(lo) + k * step, F.lit(hi))
    return cell.select("region", (F.lit(x0) + F.col("c") * dx).alias("x_min"), least(x0, F.col("c") + 1, dx, x1).alias("x_max"), (F.lit(y0) + F.col("r") * dy).alias("y_min"), least(y0, F.col("r") + 1, dy, y1).alias("y_max"))


def check_extent(metas: DataFrame, extent: tuple, padding: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """The common box of all inputs (greatest lower, least upper bounds) and `covers`: whether it holds the padded extent."""
    x0, y0, x1, y1 = extent
    box = metas.groupBy(*(by or [])).agg(F.max("x_min").alias("x_min"), F.max("y_min").alias("y_min"), F.min("x_max").alias("x_max"), F.min("y_max").alias("y_max"))
    ok = (F.col("x_min") <= x0 - padding) & (F.col("y_min") <= y0 - padding) & (F.col("x_max") >= x1 + padding) & (F.col("y_max") >= y1 + padding)
    return box.withColumn("covers", ok)


def point_to_cell(df: DataFrame, grid: dict, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds y, x of the cell that holds the point (north-up grid)."""
    return df.withColumn("y", F.floor((F.lit(grid["y0"]) - F.col(lat)) / grid["dy"])).withColumn("x", F.floor((F.col(lon) - grid["x0"]) / grid["dx"]))


def clip_raster(px: DataFrame, extent: tuple[int, int, int, int], padding: int = 0) -> DataFrame:
    """Cells with y_min - padding <= y <= y_max + padding, and x alike; plain comparisons that reach the scan."""
    y0, x0, y1, x1 = extent
    return px.filter((F.col("y") >= y0 - padding) & (F.col("y") <= y1 + padding) & (F.col("x") >= x0 - padding) & (F.col("x") <= x1 + padding))


def resample_nearest(src: DataFrame, dst: DataFrame, src_grid: dict, dst_grid: dict, value: str = "value") -> DataFrame:
    """dst cells (y, x) with the value of the source cell under their centre; indices are clamped to the source's edge."""
    lon = F.lit(dst_grid["x0"]) + (F.col("y") * 0 + F.col("x") + 0.5) * dst_grid["dx"]
    lat = F.lit(dst_grid["y0"]) - (F.col("y") + 0.5) * dst_grid["dy"]
    clamp = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), c))
    sy = clamp(F.floor((F.lit(src_grid["y0"]) - lat) / src_grid["dy"]), src_grid["nrow"])
    sx = clamp(F.floor((lon - src_grid["x0"]) / src_grid["dx"]), src_grid["ncol"])
    asked = dst.select("y", "x", sy.cast("long").alias("sy"), sx.cast("long").alias("sx"))
    return asked.join(src.select(F.col("y").alias("sy"), F.col("x").alias("sx"), value), ["sy", "sx"], "left").select("y", "x", value)


def reproject_xy(df: DataFrame, src: int, dst: int, x: str = "x", y: str = "y") -> DataFrame:
    """Adds rx, ry: coordinates between EPSG 4326 and 3857 in closed form; the same code is no change."""
    from ..functions.scalars import from_web_mercator, web_mercator

    if src == dst:
        return df.withColumn("rx", F.col(x)).withColumn("ry", F.col(y))
    if {src, dst} != {4326, 3857}:
        raise ValueError("only EPSG 4326 and 3857 are known")
    rx, ry = (web_mercator if src == 4326 else from_web_mercator)(x, y)
    return df.withColumn("rx", rx).withColumn("ry", ry)
