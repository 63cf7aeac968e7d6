"""Buildings as boxes or polygons: overlay with cells, densities, heights, stacked shapes, masks.

A shape meets the cells of its bounding box by exploding them (an equi-join on the cell), never by comparing every shape with every cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .components import connected_components
from .polygons import RINGS, cell_pieces, contained, in_ring, overlap_edges

# Metres in each unit of height.
UNITS = {"m": 1.0, "cm": 0.01, "FLOOR": 3.0, "feet": 0.3048}


def _cells(df: DataFrame, res: float) -> DataFrame:
    """Adds cy, cx for every cell (of res, from 0) that the box meets; boxes without area go."""
    solid = df.filter((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / res), F.ceil(F.col(hi) / res) - 1))
    return solid.withColumn("cy", span("y_min", "y_max")).withColumn("cx", span("x_min", "x_max"))


def overlay(boxes: DataFrame, res: float) -> DataFrame:
    """The boxes' columns with cy, cx and area: one row for each piece of a box in a cell."""
    side = lambda lo, hi, c: F.least(F.col(hi), (F.col(c) + 1) * res) - F.greatest(F.col(lo), F.col(c) * res)
    return _cells(boxes, res).withColumn("area", side("x_min", "x_max", "cx") * side("y_min", "y_max", "cy"))


def overlay_polygons(polys: DataFrame, res: float) -> DataFrame:
    """id, cy, cx, area for polygons with holes (column rings): exact areas of their pieces, cut a batch at a time."""
    return cell_pieces(polys, ["id"], res, shapes=False)


def with_box(polys: DataFrame) -> DataFrame:
    """Adds the bounding box of the outer ring."""
    xs, ys = F.element_at("rings", 1)["x"], F.element_at("rings", 1)["y"]
    return polys.drop("x_min", "x_max", "y_min", "y_max").select("*", F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))


def as_rings(boxes: DataFrame) -> DataFrame:
    """Boxes as polygons with one ring of four corners."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return boxes.withColumn("rings", F.array(F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"))))


def footprint_density(pieces: DataFrame, net: DataFrame, res: float, scale: float = 1.0, by: tuple = ()) -> DataFrame:
    """cy, cx, footprint: area of the pieces * scale / res^2, 0 where there is none (net: all cells cy, cx)."""
    total = pieces.groupBy(*by, "cy", "cx").agg(F.sum("area").alias("__a"))
    return net.join(total, [*by, "cy", "cx"], "left").select(*by, "cy", "cx", (F.coalesce("__a", F.lit(0.0)) * scale / (res * res)).alias("footprint"))


def cell_height(pieces: DataFrame, net: DataFrame, height: str = "height", scale: float = 1.0, by: tuple = ()) -> DataFrame:
    """cy, cx, cell_height: area-weighted mean of max(height * scale, 2), 3 for a missing height; null where there is no piece."""
    h = F.greatest(F.coalesce(F.col(height) * scale, F.lit(3.0)), F.lit(2.0))
    sums = pieces.withColumn("__h", F.when(F.col(height).isNull(), F.lit(3.0)).otherwise(h)).groupBy(*by, "cy", "cx").agg(F.try_divide(F.sum(F.col("__h") * F.col("area")), F.sum("area")).alias("cell_height"))
    return net.join(sums, [*by, "cy", "cx"], "left")


def drop_null_geometry(df: DataFrame, geometry: str = "rings") -> DataFrame:
    return df.filter(F.col(geometry).isNotNull())


def overlapping_pairs(boxes: DataFrame, res: float, by: tuple = ()) -> DataFrame:
    """src < dst: pairs of boxes with a common inner point; each is found in the first cell both meet, so once."""
    a = _cells(boxes, res).select(*by, "cy", "cx", "id", "x_min", "x_max", "y_min", "y_max")
    b = a.select(*by, "cy", "cx", *[F.col(c).alias(f"{c}_2") for c in ("id", "x_min", "x_max", "y_min", "y_max")])
    meet = (F.col("x_min") < F.col("x_max_2")) & (F.col("x_min_2") < F.col("x_max")) & (F.col("y_min") < F.col("y_max_2")) & (F.col("y_min_2") < F.col("y_max"))
    first = (F.col("cx") == F.floor(F.greatest("x_min", "x_min_2") / res)) & (F.col("cy") == F.floor(F.greatest("y_min", "y_min_2") / res))
    return a.join(b, [*by, "cy", "cx"]).filter((F.col("id") < F.col("id_2")) & meet & first).select(F.col("id").alias("src"), F.col("id_2").alias("dst"))


def _distinct_boxes(boxes: DataFrame, by: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """One of each set of equal boxes (the least id), and edges that hang the others on it: copies cost a row each, not a pair each."""
    corners = ["x_min", "x_max", "y_min", "y_max"]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.col("id").isNotNull())
    rows = boxes.filter(known).select(*by, "id", *corners)
    one = stored(rows.groupBy(*by, *corners).agg(F.min("id").alias("id")), "boxes")
    equal = rows.select(*by, *corners, F.col("id").alias("src")).join(one.withColumnRenamed("id", "dst"), [*by, *corners]).filter("src <> dst").select("src", "dst")
    return one, equal


def overlap_groups(shapes: DataFrame, res: float, by: tuple = (), **options) -> DataFrame:
    """Adds group: the least id of the shapes (polygons if there is a column rings, else boxes) that overlap, directly or through others.

    Boxes are compared within their cells as long as no cell holds more than `limit`; else, and for polygons, see polygons.overlap_edges.
    Overlap means a common inner point, within the same values of `by`; a shape without area, sound corners or a value of `by` is alone.
    """
    if "rings" in shapes.columns:
        edges = overlap_edges(shapes, res, by, **options)
    else:
        sound_ = shapes.filter((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")))
        solid, equal = _distinct_boxes(sound_, by)
        most = _cells(solid, res).groupBy(*by, "cy", "cx").count().agg(F.max("count").alias("n")).first().n or 0
        edges = overlapping_pairs(solid, res, by) if most <= options.get("limit", 128) else overlap_edges(as_rings(solid), res, by, **options)
        edges = edges.unionByName(equal)
    parts = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("__group"))
    return shapes.join(parts, "id", "left").withColumn("group", F.coalesce("__group", "id")).drop("__group")


def contains_join(outer: DataFrame, inner: DataFrame, res: float, tol: float = 1e-6) -> DataFrame:
    """outer_id, inner_id: outer shapes that hold inner shapes shrunk by tol.

    Equal shapes are compared once and their pairs made by joins of the members, dealt evenly.
    Boxes meet on the cell of the inner box's centre; if either side has a column rings, both are taken as polygons (see polygons.contained).
    """
    if "rings" in outer.columns or "rings" in inner.columns:
        outer, inner = (df if "rings" in df.columns else as_rings(df) for df in (outer, inner))
        (outer, of_outer), (inner, of_inner) = (_classes(df.select("id", F.col("rings").cast(RINGS).alias("rings")), ["rings"]) for df in (outer, inner))
        held = contained(outer, inner, res, tol)
    else:
        corners = ["x_min", "x_max", "y_min", "y_max"]
        (outer, of_outer), (inner, of_inner) = (_classes(df.select("id", *corners), corners) for df in (outer, inner))
        held = _boxes_held(outer, inner, res, tol)
    return _members_of(stored(held, "held"), of_outer, of_inner)


def _classes(shapes: DataFrame, geometry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, geometry) of each set of equal shapes, and (class, id) for every shape; the class is a row of its own, whatever ids repeat."""
    hashed = shapes.withColumn("__h", F.sha2(F.to_json(F.struct(*geometry)), 256))
    one = hashed.groupBy("__h").agg(*[F.first(c).alias(c) for c in geometry])
    one = stored(one.withColumn("__class", F.monotonically_increasing_id()), "classes")
    of = stored(hashed.select("__h", "id").join(one.select("__h", "__class"), "__h").select("__class", "id"), "members")
    return one.select(F.col("__class").alias("id"), *geometry), of


CHUNK = 1_000  # members of a class that are joined as one row


def _chunks(of: DataFrame, ids: str) -> DataFrame:
    """class, and its members' ids in lists of about CHUNK."""
    n = of.groupBy("__class").agg(F.count("*").alias("__n"))
    dealt = of.join(n, "__class").withColumn("__c", F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / CHUNK)))
    return dealt.groupBy("__class", "__c").agg(F.collect_list("id").alias(ids)).drop("__c")


def _members_of(held: DataFrame, of_outer: DataFrame, of_inner: DataFrame) -> DataFrame:
    """outer_id, inner_id of the members of the classes: rows of two lists are dealt evenly before they are unfolded, so a hot class is many tasks."""
    a = _chunks(of_outer, "__outer").withColumnRenamed("__class", "outer_id")
    b = _chunks(of_inner, "__inner").withColumnRenamed("__class", "inner_id")
    lists = held.join(a, "outer_id").join(b, "inner_id").select("__outer", "__inner")
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    return lists.repartition(parts).select(F.explode("__outer").alias("outer_id"), "__inner").select("outer_id", F.explode("__inner").alias("inner_id"))


def _boxes_held(outer: DataFrame, inner: DataFrame, res: float, tol: float) -> DataFrame:
    """outer_id, inner_id of boxes that hold boxes."""
    a = _cells(outer, res).select("cy", "cx", F.col("id").alias("outer_id"), *[F.col(c).alias(f"o_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    mid = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / 2 / res)
    b = inner.select(mid("y_min", "y_max").alias("cy"), mid("x_min", "x_max").alias("cx"), F.col("id").alias("inner_id"), "x_min", "x_max", "y_min", "y_max")
    inside = (F.col("o_x_min") <= F.col("x_min") + tol) & (F.col("o_x_max") >= F.col("x_max") - tol) & (F.col("o_y_min") <= F.col("y_min") + tol) & (F.col("o_y_max") >= F.col("y_max") - tol)
    return a.join(b, ["cy", "cx"]).filter(inside).select("outer_id", "inner_id")


def clean_height(df: DataFrame, field: str = "height_raw", unit: str = "unit") -> DataFrame:
    """Adds height in metres: unit factor, at least 2; 3 where missing; an unknown unit is an error."""
    factor = reduce(lambda acc, u: acc.when(F.col(unit) == u, F.lit(UNITS[u])), UNITS, F).otherwise(F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(F.col(unit), F.lit("null")))).cast("double"))
    return df.withColumn("height", F.when(F.col(field).cast("double").isNull(), F.lit(3.0)).otherwise(F.greatest(F.col(field).cast("double") * factor, F.lit(2.0))))


def merge_height(df: DataFrame, group: str = "group", height: str = "height", area: Column | None = None) -> DataFrame:
    """group, height: area-weighted mean over a merged shape's parts (boxes unless an area is given), and their number."""
    a = area if area is not None else (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    return df.groupBy(group).agg(F.try_divide(F.sum(F.col(height) * a), F.sum(a)).alias("height"), F.count("*").alias("n_parts"))


def explode_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each polygon of a multi-part geometry (struct type, rings); other types go, attributes are copied."""
    return df.withColumn("__p", F.explode(parts)).filter(F.col("__p.type") == "Polygon").withColumn("rings", F.col("__p.rings")).drop("__p", parts)


def add_row_id(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds a dense id 0..n-1 in the given order; "_" goes before a name that is taken."""
    from ..sources.io import keyed_samples

    while name in df.columns:
        name = "_" + name
    return keyed_samples(df, order).withColumnRenamed("key", name)


def attach_height(boxes: DataFrame, raster: DataFrame, res: float, nrow: int, ncol: int, value: str = "value", fill: float | None = None) -> DataFrame:
    """Adds raster_height: area-weighted mean of the raster under a box (missing and negative values count as 0), at least 2, two decimals.

    Cells off the raster take the edge's value; a box without area stays null unless fill is given.
    """
    pieces = overlay(boxes, res).select("id", "area", F.least(F.lit(nrow - 1), F.greatest(F.lit(0), "cy")).cast("long").alias("y"), F.least(F.lit(ncol - 1), F.greatest(F.lit(0), "cx")).cast("long").alias("x"))
    v = F.when(F.col(value) > 0, F.col(value)).otherwise(F.lit(0.0))
    mean = pieces.join(raster.select("y", "x", value), ["y", "x"], "left").groupBy("id").agg(F.round(F.greatest(F.round(F.sum(v * F.col("area")) / F.sum("area"), 9), F.lit(2.0)), 2).alias("raster_height"))
    out = boxes.join(mean, "id", "left")
    return out if fill is None else out.withColumn("raster_height", F.coalesce("raster_height", F.lit(fill)))


def mask_by_polygon(px: DataFrame, polys: DataFrame, grid: dict, value: str = "value") -> DataFrame:
    """Cells whose centre lies in a polygon (and in none of its holes) keep their value; others become null."""
    lon, lat = F.lit(grid["x0"]) + (F.col("x") + 0.5) * grid["dx"], F.lit(grid["y0"]) - (F.col("y") + 0.5) * grid["dy"]
    box = with_box(polys).select("rings", "x_min", "x_max", "y_min", "y_max")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    met = box.withColumn("y", span((F.lit(grid["y0"]) - F.col("y_max")) / grid["dy"], (F.lit(grid["y0"]) - F.col("y_min")) / grid["dy"])).withColumn("x", span((F.col("x_min") - grid["x0"]) / grid["dx"], (F.col("x_max") - grid["x0"]) / grid["dx"]))
    inside = in_ring(lon, lat, F.element_at("rings", 1)) & ~F.exists(F.slice("rings", 2, F.size("rings")), lambda r: in_ring(lon, lat, r))
    kept = met.filter(inside).select("y", "x").distinct().withColumn("__in", F.lit(True))
    return px.join(kept, ["y", "x"], "left").withColumn(value, F.when(F.col("__in"), F.col(value))).drop("__in")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """All rows of the layers; attributes that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def _net(manifest: DataFrame, res: float) -> DataFrame:
    """city, cy, cx: all cells of every manifest box (city, x_min, x_max, y_min, y_max)."""
    return _cells(manifest, res).select("city", "cy", "cx")


def _within(boxes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Boxes cut to their city's extent (an equi-join on the city)."""
    m = manifest.select("city", *[F.col(c).alias(f"m_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    cut = boxes.join(m, "city")
    for a in ("x", "y"):
        cut = cut.withColumn(f"{a}_min", F.greatest(f"{a}_min", f"m_{a}_min")).withColumn(f"{a}_max", F.least(f"{a}_max", f"m_{a}_max"))
    return cut.drop(*[f"m_{c}" for c in ("x_min", "x_max", "y_min", "y_max")])


def footprint_batch(manifest: DataFrame, boxes: DataFrame, res: float, scale: float = 1.0) -> DataFrame:
    """city, cy, cx, footprint for every manifest city in one plan."""
    return footprint_density(overlay(_within(boxes, manifest), res), _net(manifest, res), res, scale, ("city",))


def height_batch(manifest: DataFrame, boxes: DataFrame, res: float) -> DataFrame:
    """city, cy, cx, cell_height for every manifest city in one plan."""
    return cell_height(overlay(_within(clean_height(boxes), manifest), res), _net(manifest, res), "height", by=("city",))
