"""Polygons on cells against sample points, dense cells, unsound shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbangrid.operators import polygons, vector

SCHEMA = "id long, rings array<array<struct<x:double,y:double>>>"


def _ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _shapes(n, seed, reach=40):
    """Boxes, L-shapes, diamonds and frames on whole numbers: all edges lie on rows, columns and diagonals."""
    rng, out = random.Random(seed), []
    for i in range(n):
        x, y, a, kind = rng.randrange(reach), rng.randrange(reach), rng.randrange(2, 7), rng.randrange(4)
        if kind == 0:
            rings = [[(x, y), (x + a, y), (x + a, y + 2), (x, y + 2)]]
        elif kind == 1:
            rings = [[(x, y), (x + a, y), (x + a, y + 1), (x + 1, y + 1), (x + 1, y + a), (x, y + a)]]
        elif kind == 2:
            rings = [[(x + a, y), (x + 2 * a, y + a), (x + a, y + 2 * a), (x, y + a)]]
        else:
            rings = [[(x, y), (x + a + 2, y), (x + a + 2, y + a + 2), (x, y + a + 2), (x, y)], [(x + 1, y + 1), (x + a + 1, y + 1), (x + a + 1, y + a + 1), (x + 1, y + a + 1)]]
        if rng.random() < 0.5:
            rings = [r[::-1] for r in rings]
        out.append((i, rings))
    return out


def _points(rings):
    """The quarters of unit cells that the shape holds: a point in each of the four triangles between the diagonals."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    found = set()
    for cx in range(min(xs), max(xs)):
        for cy in range(min(ys), max(ys)):
            for k, (dx, dy) in enumerate(((0.5, 0.2), (0.5, 0.8), (0.2, 0.5), (0.8, 0.5))):
                px, py, odd = cx + dx, cy + dy, False
                for r in rings:
                    for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
                        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                            odd = not odd
                if odd:
                    found.add((cx, cy, k))
    return found


def _table(spark, shapes):
    return spark.createDataFrame([(i, [_ring(r) for r in rings]) for i, rings in shapes], SCHEMA)


def _groups(cells):
    root = {i: i for i in cells}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(cells)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if cells[i] & cells[j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("res, limit, rounds", [(1000.0, 4, 6), (5.0, 2, 1), (1000.0, 4, 0)])
def test_groups_of_polygons_equal_sample_points(spark, res, limit, rounds):
    shapes = _shapes(70, 5, 60)
    cells = {i: _points(r) for i, r in shapes}
    got = {r.id: r.group for r in vector.overlap_groups(_table(spark, shapes), res, limit=limit, rounds=rounds).collect()}
    want = _groups(cells)
    assert got == want and 5 < len(set(want.values())) < 65


def test_containment_of_polygons_equals_sample_points(spark):
    shapes = _shapes(90, 8, 12)
    cells = {i: _points(r) for i, r in shapes}
    table = _table(spark, shapes)
    want = {(i, j) for i in cells for j in cells if cells[j] <= cells[i]}
    for res, limit in ((3.0, 128), (1000.0, 4)):
        got = [(r.outer_id, r.inner_id) for r in polygons.contained(table, table, res, limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_areas_of_pieces_equal_sample_points(spark):
    shapes = _shapes(60, 3)
    got = {(r.id, r.cx, r.cy): r.area for r in vector.overlay_polygons(_table(spark, shapes), 4.0).collect()}
    want = {}
    for i, rings in shapes:
        for cx, cy, _ in _points(rings):
            want[i, cx // 4, cy // 4] = want.get((i, cx // 4, cy // 4), 0) + 0.25
    assert got == pytest.approx(want)


def test_slanted_areas_equal_a_closed_form():
    """A polygon turned by an angle and a moved copy of it: the common area of two squares along a diagonal."""
    turn = lambda a, p: np.array(p) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    for angle in (0.1, 0.7, 1.3):
        a, b = (polygons.edges_of(turn(angle, np.array(square) + d), np.array([0, 4])) for d in (0, 0.25))
        assert polygons.common_area(a, b) == pytest.approx(0.75**2)
        assert not polygons._overlap(a, polygons.edges_of(turn(angle, np.array(square) + [1, 0]), np.array([0, 4])))


def test_a_cell_with_very_many_shapes(spark):
    """100,000 shapes in one cell: 60,000 in pairs over the whole cell, 40,000 nearly equal ones stacked in a corner."""
    n = spark.range(100_000)
    k = F.floor(F.col("id") / 2)
    x, y = (k % 200) * 0.004 + (F.col("id") % 2) * 0.001, F.floor(k / 200) * 0.005
    slip = (F.col("id") - 60_000) * 1e-9
    stacked = F.col("id") >= 60_000
    boxes = n.withColumn("x_min", F.when(stacked, 0.85 + slip).otherwise(x)).withColumn("y_min", F.when(stacked, 0.85 - slip).otherwise(y))
    boxes = boxes.withColumn("x_max", F.col("x_min") + F.when(stacked, 0.1).otherwise(0.002)).withColumn("y_max", F.col("y_min") + F.when(stacked, 0.1).otherwise(0.002))
    got = vector.overlap_groups(boxes, 1.0)
    wrong = got.filter(F.col("group") != F.when(stacked, 60_000).otherwise(F.col("id") - F.col("id") % 2))
    assert got.count() == 100_000 and wrong.count() == 0


def test_unsound_shapes_stand_alone(spark):
    square = _ring([(0, 0), (1, 0), (1, 1), (0, 1)])
    rows = [(1, [square], "a"), (2, [square], "a"), (3, [square], None), (4, None, "a"), (5, [], "a"), (6, [[]], "a"), (7, [square[:2]], "a"), (8, [[{"x": None, "y": 0.0}, *square]], "a"), (9, [[{"x": float("nan"), "y": 0.0}, *square]], "a"), (10, [square], "b"), (11, [_ring([(1, 0), (2, 0), (2, 1), (1, 1)])], "a")]
    df = spark.createDataFrame(rows, SCHEMA + ", component string")
    got = {r.id: r.group for r in vector.overlap_groups(df, 3.0, ("component",)).collect()}
    assert got == {i: i for i in range(1, 12)} | {2: 1}
    assert vector.overlap_groups(df.limit(0), 3.0).count() == 0 and polygons.contained(df.limit(0), df, 3.0).count() == 0
    held = {(r.outer_id, r.inner_id) for r in polygons.contained(df, df, 0.3).collect()}
    assert held == {(i, j) for i in (1, 2, 3, 10) for j in (1, 2, 3, 10)} | {(11, 11)}


def test_boxes_and_polygons_hold_the_same(spark, sf_dir):
    from urbangrid.sources.fixtures import fixture

    boxes = fixture(spark, sf_dir, "f4").select("id", "x_min", "x_max", "y_min", "y_max")
    outer = boxes.filter("id % 3 = 0").select("id", *[(F.col(c) + (1 if c.endswith("max") else -1)).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])
    one, two = ({tuple(r) for r in vector.contains_join(o, boxes, 2.5).collect()} for o in (outer, vector.as_rings(outer)))
    assert one == two and len(one) > 10
