"""Tables in and out: manifests, pixels, polygons, sample stores, catalogs, parameters, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..schemas import POLYGONS, TILE, manifest_schema
from .shared import stored


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A job manifest (CSV with header, with or without byte-order mark) under its fixed schema."""
    return spark.read.option("header", True).schema(manifest_schema(kind)).csv(path)


def read_pixels(spark: SparkSession, path: str, bands: list[str] | None = None, extent: tuple[int, int, int, int] | None = None, tile: int = TILE) -> DataFrame:
    """Cells of bands within extent (y_min, x_min, y_max, x_max, inclusive cell numbers) of a table with columns ty, tx.

    Tiles outside the extent are passed over by folder, or by the row groups' bounds in what write_tiles wrote.
    """
    px = spark.read.parquet(path)
    if bands:
        px = px.filter(F.col("band").isin(*bands))
    if extent:
        y0, x0, y1, x1 = extent
        px = px.filter(F.col("ty").between(y0 // tile, y1 // tile) & F.col("tx").between(x0 // tile, x1 // tile) & F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
    return px.drop("ty", "tx")


def tiled(px: DataFrame, tile: int = TILE) -> DataFrame:
    return px.withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int"))


def _spread(c: Column) -> Column:
    """The 31 low bits of a number at every second place of a long."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def z_order(row, column) -> Column:
    """Place of a tile on the Z curve; rows and columns from -2^30 on."""
    low = lambda c: _spread(F.col(c).cast("long") + (1 << 30))
    return F.shiftleft(low(row), 1).bitwiseOR(low(column))


def write_tiles(px: DataFrame, path: str, tile: int = TILE) -> None:
    """Pixels with their tile (ty, tx), sorted along the Z curve of tiles, for read_pixels: as many files as the rows are dealt to, not as there are tiles."""
    placed = tiled(px, tile).withColumn("__curve", z_order("ty", "tx"))
    keys = ["__curve", *[c for c in ("band", "y", "x") if c in px.columns]]
    placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__curve").write.mode("overwrite").parquet(path)


def write_pixels(px: DataFrame, path: str, grid: dict, tile: int = TILE, cells_per_file: int = 16_000_000) -> None:
    """Pixels in files of about even size, and a one-row table of the grid; null values get the grid's no-data value only here.

    Cells lie along the Z curve of their tiles, so a file holds a few patches of the raster, however many tiles the world has and however full one is.
    files: a row for each file with its box, so that an extent names the files to read.
    """
    spark = px.sparkSession
    placed = tiled(px.withColumn("value", F.coalesce("value", F.lit(float(grid["nodata"])))), tile).withColumn("__curve", z_order("ty", "tx"))
    keys = ["__curve", *[c for c in ("band", "y", "x") if c in px.columns]]
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__curve", "ty", "tx")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", cells_per_file).parquet(f"{path}/pixels")
    boxes = spark.read.parquet(f"{path}/pixels").groupBy(F.col("_metadata.file_name").alias("file"))
    boxes.agg(*[f(c).alias(f"{c}_{n}") for c in ("y", "x") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
    spark.createDataFrame([grid]).write.mode("overwrite").parquet(f"{path}/grid")


def read_raster(spark: SparkSession, path: str, bands: list[str] | None = None, extent: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, dict]:
    """What write_pixels wrote: pixels with no-data as null, and the grid; of an extent (as in read_pixels) only the files whose boxes meet it."""
    grid = spark.read.parquet(f"{path}/grid").first().asDict()
    px = spark.read.parquet(f"{path}/pixels")
    if extent:
        y0, x0, y1, x1 = extent
        meets = (F.col("y_min") <= y1) & (F.col("y_max") >= y0) & (F.col("x_min") <= x1) & (F.col("x_max") >= x0)
        files = [r.file for r in spark.read.parquet(f"{path}/files").filter(meets).select("file").collect()]
        within = F.col("y").between(y0, y1) & F.col("x").between(x0, x1)
        px = spark.read.schema(px.schema).parquet(*[f"{path}/pixels/{f}" for f in files]).filter(within) if files else px.filter(F.lit(False))
    if bands:
        px = px.filter(F.col("band").isin(*bands))
    return px.withColumn("value", F.when(F.col("value") != grid["nodata"], F.col("value"))), grid


def read_polygons(spark: SparkSession, path: str, fmt: str = "geojson") -> DataFrame:
    """id, rings and attributes from GeoJSON feature lines (polygons and multi-polygons, a row for each polygon) or from Parquet."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    point = T.ArrayType(T.DoubleType())
    text = spark.read.text(path).filter(F.col("value").contains('"Feature"'))
    head = F.from_json("value", "id long, properties map<string,string>, geometry struct<type:string>")
    one = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), T.ArrayType(T.ArrayType(point)))
    many = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), T.ArrayType(T.ArrayType(T.ArrayType(point))))
    rows = text.select(head.alias("h"), "value").select("h.id", "h.properties", F.when(F.col("h.geometry.type") == "MultiPolygon", many).when(F.col("h.geometry.type") == "Polygon", F.array(one)).alias("polys"))
    rings = F.transform("poly", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("id", "properties", F.explode_outer("polys").alias("poly")).select("id", rings.cast(POLYGONS["rings"].dataType).alias("rings"), "properties")


def sample_chunks(df: DataFrame, group: str, order: list[str], chunk_size: int = 100_000) -> DataFrame:
    """Adds chunk: rows of a group in order, chunk_size to a chunk.

    Positions come from ranges of the full key, so a city with most of the rows is not one task.
    """
    out = dense_position(df, [group], order, df.count())
    return out.withColumn("chunk", F.floor(F.col("position") / chunk_size)).drop("position")


RANGE_ROWS = 1_000_000  # rows of a range where their number is known


def dense_position(df: DataFrame, groups: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """Adds position 0..n-1 in the given order inside each group.

    With the number of rows given there are as many ranges as keep each to about RANGE_ROWS, else as many as shuffles have partitions.

    Rows are dealt to ranges of the full key (groups and order; Spark samples it, so a hot group or ids with a common prefix are cut as finely as
    any) and sorted there; a row's place in its range and the counts of its group in earlier ranges give the position.  The ranges are written once,
    as a second run could sample other bounds; the only windows run over the counts, a row for each range and each group in it.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = () if rows is None or rows <= least * RANGE_ROWS else (-(-rows // RANGE_ROWS),)  # a number of one's own is not coalesced
    dealt = df.repartitionByRange(*many, *groups, *order).sortWithinPartitions(*groups, *order)
    local = F.monotonically_increasing_id()
    placed = stored(dealt.withColumn("__range", F.shiftright(local, 33)).withColumn("__place", local.bitwiseAND((1 << 33) - 1)), "positions")
    sizes = placed.groupBy(*groups, "__range").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__range").alias("__r"), (before - F.col("__first")).alias("__start"))
    starts = stored(starts, "starts")  # its size is known then, and the rows are not shuffled for it while it is small
    on = (F.col("__range") == F.col("__r")) & reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)), F.lit(True))
    return placed.join(starts, on).withColumn("position", F.col("__start") + F.col("__place")).select(*df.columns, "position")


def write_samples(df: DataFrame, path: str, group: str = "city", order: tuple = ("sample_id",), chunk_size: int = 100_000) -> None:
    """Sample store: folders by group, column chunk, at most chunk_size rows to a file."""
    sample_chunks(df, group, list(order), chunk_size).write.mode("overwrite").option("maxRecordsPerFile", chunk_size).partitionBy(group).parquet(path)


def keyed_samples(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds key 0..n-1 over the whole table."""
    return dense_position(df.withColumn("__all", F.lit(0)), ["__all"], order, df.count()).withColumnRenamed("position", "key").drop("__all")


def group_spans(df: DataFrame, group: str) -> DataFrame:
    """group, begin, end: half-open spans of a global index over sorted groups (one row for each group)."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    end = F.sum("n").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, 0))
    return n.select(group, (end - F.col("n")).alias("begin"), end.alias("end"))


def index_samples(df: DataFrame, idx: DataFrame, group: str = "grp", width: int = 1024) -> DataFrame:
    """i, group, shift for global indices i: the span that holds i, found by an equi-join on buckets of `width` indices."""
    spans = group_spans(df, group).filter(F.col("end") > F.col("begin"))
    bucketed = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    return idx.withColumn("__b", F.floor(F.col("i") / width)).join(bucketed, "__b").filter((F.col("i") >= F.col("begin")) & (F.col("i") < F.col("end"))).select("i", group, (F.col("i") - F.col("begin")).alias("shift"))


def select_tiles(df: DataFrame, extent: tuple[float, float, float, float], spacing: float = 9.0) -> DataFrame:
    """Rows whose tile corner (lon_tile, lat_tile) touches the extent (lon_min, lat_min, lon_max, lat_max): floor, ceil, half-open."""
    import math

    lo_x, lo_y = (math.floor(v / spacing) * spacing for v in extent[:2])
    hi_x, hi_y = (math.ceil(v / spacing) * spacing for v in extent[2:])
    return df.filter((F.col("lon_tile") >= lo_x) & (F.col("lon_tile") < hi_x) & (F.col("lat_tile") >= lo_y) & (F.col("lat_tile") < hi_y))


def check_patches(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rows whose patches all hold size * size values; the rest are counted by count_rejects."""
    return df.filter(reduce(lambda a, b: a & b, (F.coalesce(F.size(c) == s * s, F.lit(False)) for c, s in sizes.items())))


def count_rejects(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    ok = reduce(lambda a, b: a & b, (F.coalesce(F.size(c) == s * s, F.lit(False)) for c, s in sizes.items()))
    return df.agg(F.sum(ok.cast("long")).alias("accepted"), F.sum((~ok).cast("long")).alias("rejected"))


def mosaic(*rasters: DataFrame, by: tuple = ("band", "y", "x")) -> DataFrame:
    """One raster from several: per cell the last source's value; missing values never overwrite."""
    ranked = [r.select(*by, "value", F.lit(i).alias("src")) for i, r in enumerate(rasters)]
    return reduce(DataFrame.unionByName, ranked).filter(F.col("value").isNotNull()).groupBy(*by).agg(F.max_by("value", "src").alias("value"))


def band_names(px: DataFrame) -> list[str]:
    """The names of a raster's bands, sorted: all of them; a table whose bands are no handful of names is an error."""
    names = [r.band for r in px.select("band").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 bands; is the column a band name?")
    return sorted(n for n in names if n is not None)


def feature_catalog(spark: SparkSession, suffixes: list[str], bands: list[str], stats: list[str]) -> DataFrame:
    """position, name: suffix@band@stat in nested order."""
    names = [f"{s}@{b}@{t}" for s in suffixes for b in bands for t in stats]
    return spark.createDataFrame([*enumerate(names)], "position long, name string")


def save_params(params: dict[str, float], path: str, spark: SparkSession) -> None:
    spark.createDataFrame([({k: float(v) for k, v in params.items()},)], "params map<string,double>").write.mode("overwrite").parquet(path)


def load_params(path: str, spark: SparkSession) -> dict[str, float]:
    return dict(spark.read.parquet(path).first().params)


def append_run(spark: SparkSession, path: str, run_id: str, params: dict) -> None:
    """Adds one run's settings to the runs table."""
    spark.createDataFrame([(run_id, {k: str(v) for k, v in params.items()})], "run_id string, params map<string,string>").write.mode("append").parquet(path)
