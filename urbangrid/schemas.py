"""Column layouts of the tables the operators take and give.

A raster is a table of cells: scene_id, band, y, x, value (row y grows southwards, column x eastwards); no-data is NULL.
A grid is a dict of plain numbers: x0, y0 (upper left corner), dx, dy (step, both positive), nrow, ncol, crs, nodata.
"""

from __future__ import annotations

from pyspark.sql import types as T

PIXELS = T.StructType([
    T.StructField("scene_id", T.StringType()), T.StructField("band", T.StringType()),
    T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("value", T.DoubleType()),
])

POLYGONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("rings", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))),
])

_TEXT, _INT, _DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()

# Columns of the job manifests.
MANIFESTS = {
    "labels": [("City", _TEXT), ("SHP_Path", _TEXT), ("SRTM_Path", _TEXT), ("Year", _INT), ("BuildingHeightField", _TEXT), ("Unit", _TEXT)],
    "patches": [("City", _TEXT), ("BuildingHeight_Path", _TEXT), ("BuildingFootprint_Path", _TEXT)],
    "scenes": [("City", _TEXT), ("BuildingHeight_Path", _TEXT), ("BuildingFootprint_Path", _TEXT), ("SHP_Path", _TEXT), ("Season", _TEXT), ("height_min", _DOUBLE), ("area_min", _DOUBLE)],
    "cases": [("City", _TEXT), ("Path", _TEXT), ("Year", _INT)],
}

TILE = 256  # cells along a tile's side


def manifest_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in MANIFESTS[kind]])


def grid(x0: float, y0: float, step: float, nrow: int, ncol: int, crs: int = 4326, nodata: float = -1e6) -> dict:
    return {"x0": x0, "y0": y0, "dx": step, "dy": step, "nrow": nrow, "ncol": ncol, "crs": crs, "nodata": nodata}
