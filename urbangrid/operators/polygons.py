"""Polygons with holes on cells: cutting, common areas, groups of overlapping shapes, containment.

A polygon is cut by halving its range of cells until single cells are left, all rings of a batch at once in flat arrays.  Cells that hold too many
shapes are cut on as a quadtree, so no task compares more than `limit` shapes with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .components import connected_components

RINGS = "array<array<struct<x:double,y:double>>>"
FAN = 4  # a dense cell is cut into FAN x FAN cells
WORK = 1 << 19  # corners that are cut together


# ---------------------------------------------------------------- flat rings
def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (n, 2), first corner of each ring (m + 1), and rings of each row, of a column of polygons."""
    rings = column.flatten()
    points = rings.flatten()
    xy = np.stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")], 1) if len(points) else np.zeros((0, 2))
    return xy, np.concatenate([[0], np.cumsum(_lengths(rings))]), _lengths(column)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def nested(xy: np.ndarray, start: np.ndarray, rings: np.ndarray) -> pa.Array:
    """The column that `flat` reads."""
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0], pa.float64()), pa.array(xy[:, 1], pa.float64())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rings)]), pa.int32()), pa.ListArray.from_arrays(pa.array(start, pa.int32()), points))


def _before(start: np.ndarray) -> np.ndarray:
    """Place of the corner before each corner in its ring."""
    before, full = np.arange(start[-1]) - 1, start[1:] > start[:-1]
    before[start[:-1][full]] = start[1:][full] - 1
    return before


def clip(xy: np.ndarray, start: np.ndarray, axis: int, at: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every ring cut to its side of its own line (axis coordinate = at), new corners exactly on it (Sutherland and Hodgman 1974)."""
    size = np.diff(start)
    line = np.repeat(at, size)
    d = (xy[:, axis] - line) * np.repeat(np.where(above, 1.0, -1.0), size)
    before = _before(start)
    e = d[before]
    cross, keep = (e < 0) & (d > 0) | (e > 0) & (d < 0), d >= 0
    ends = np.concatenate([[0], np.cumsum(cross.astype(np.int64) + keep)])
    out = np.empty((ends[-1], 2))
    a, b = xy[before[cross]], xy[cross]
    met = a + (b - a) * (e[cross] / (e[cross] - d[cross]))[:, None]
    met[:, axis] = line[cross]
    out[ends[:-1][cross]] = met
    out[ends[1:][keep] - 1] = xy[keep]
    return out, ends[start]


def ring_areas(xy: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Signed area of each ring, from its first corner's place, so that far-off coordinates cost no digits."""
    size = np.diff(start)
    base = xy[np.minimum(start[:-1], max(len(xy) - 1, 0))] if len(xy) else np.zeros((len(size), 2))
    local = xy - np.repeat(base, size, 0)
    prev = local[_before(start)]
    return np.bincount(np.repeat(np.arange(len(size)), size), prev[:, 0] * local[:, 1] - local[:, 0] * prev[:, 1], len(size)) / 2


def _take(xy: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The named rings, in that order."""
    size = np.diff(start)[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return xy[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], size)], ends


def _ranges(counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the members of the named groups, where groups of the given sizes lie one after another."""
    first, size = (np.cumsum(counts) - counts)[which], counts[which]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def cut(xy: np.ndarray, start: np.ndarray, rings: np.ndarray, box: np.ndarray, size: float) -> Iterator[tuple]:
    """Pieces of polygons in single cells: (row, cy, cx, area, xy, start, rings) in sets of bounded size.

    box holds y0, y1, x0, x1 for each row: the half-open range of cells that the polygon lies in.  The first ring is the outer one, others are holes.
    """
    todo = [(xy, start, rings, np.arange(len(rings)), box)]
    while todo:
        xy, start, rings, row, box = todo.pop()
        first = np.zeros(len(start) - 1, bool)
        first[(np.cumsum(rings) - rings)[rings > 0]] = True
        owner = np.repeat(np.arange(len(rings)), rings)
        area = np.bincount(owner, np.where(first, 1, -1) * np.abs(ring_areas(xy, start)), len(rings)) if len(owner) else np.zeros(len(rings))
        solid = area > 0
        single = (box[:, 1] - box[:, 0] <= 1) & (box[:, 3] - box[:, 2] <= 1)
        done, more = np.flatnonzero(solid & single), np.flatnonzero(solid & ~single)
        if len(done):
            some = _ranges(rings, done)
            yield row[done], box[done, 0], box[done, 2], area[done], *_take(xy, start, some), rings[done]
        if not len(more):
            continue
        if len(more) > 1 and start[-1] > WORK:
            halves = np.array_split(more, 2)
            todo += [(*_take(xy, start, _ranges(rings, h)), rings[h], row[h], box[h]) for h in halves]
            continue
        tall = box[more, 1] - box[more, 0] >= box[more, 3] - box[more, 2]
        for upright in (True, False):
            part = more[tall == upright]
            if not len(part):
                continue
            twice, above = np.repeat(part, 2), np.tile([False, True], len(part))
            b = box[twice].copy()
            lo, hi = (0, 1) if upright else (2, 3)
            mid = (b[:, lo] + b[:, hi]) // 2
            b[:, lo], b[:, hi] = np.where(above, mid, b[:, lo]), np.where(above, b[:, hi], mid)
            r = rings[twice]
            pts, at = clip(*_take(xy, start, _ranges(rings, twice)), 1 if upright else 0, np.repeat(mid * size, r), np.repeat(above, r))
            todo.append((*_drop_empty(pts, at, r), row[twice], b))


def _drop_empty(xy: np.ndarray, start: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without rings that have no corner left; a polygon whose outer ring is gone loses its holes too."""
    full = np.diff(start) > 0
    owner, first = np.repeat(np.arange(len(rings)), rings), (np.cumsum(rings) - rings)
    outer = np.zeros(len(rings), bool)
    outer[rings > 0] = full[first[rings > 0]]
    keep = full & outer[owner]
    return *_take(xy, start, np.flatnonzero(keep)), np.bincount(owner[keep], minlength=len(rings))


def covers(xy: np.ndarray, start: np.ndarray, rings: np.ndarray, cy: np.ndarray, cx: np.ndarray, area: np.ndarray, size: float) -> np.ndarray:
    """Whether a piece is its whole cell: all its edges lie on the cell's border, compared exactly."""
    corner = np.repeat(np.repeat(np.arange(len(rings)), rings), np.diff(start))
    prev, off = xy[_before(start)], np.ones(len(xy), bool)
    for axis, c in ((0, cx), (1, cy)):
        for k in (0, 1):
            at = ((c + k) * size)[corner]
            off &= ~((xy[:, axis] == at) & (prev[:, axis] == at))
    return (np.bincount(corner, off, len(rings)) == 0) & (area > size * size / 2)


# ---------------------------------------------------------------- common areas
def edges_of(xy: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x1, y1, x2, y2 with x1 < x2 of all edges that are not vertical."""
    e = np.concatenate([xy[_before(start)], xy], 1)
    e = e[e[:, 0] != e[:, 2]]
    return np.where((e[:, 0] < e[:, 2])[:, None], e, e[:, [2, 3, 0, 1]])


def _slabs(*sets: np.ndarray) -> np.ndarray:
    """Ordered x between which no edge of one set meets an edge of another."""
    lo, hi = max(e[:, 0].min() for e in sets), min(e[:, 2].max() for e in sets)
    xs = [e[:, [0, 2]].ravel() for e in sets]
    if len(sets) == 2:
        slope = [(e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]) for e in sets]
        cut_at = [e[:, 1] - s * (e[:, 0] - lo) for e, s in zip(sets, slope)]
        for k in range(0, len(sets[0]), 1024):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                x = (lo + (cut_at[1][None, :] - cut_at[0][k : k + 1024, None]) / (slope[0][k : k + 1024, None] - slope[1][None, :])).ravel()
            xs.append(x[np.isfinite(x)])
    xs = np.unique(np.concatenate(xs))
    return np.unique(np.concatenate([[lo, hi], xs[(xs > lo) & (xs < hi)]])) if hi > lo else np.zeros(0)


def common_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area inside both even-odd polygons, given as edges: between neighbouring corners and crossings the common length is linear in x."""
    if not len(a) or not len(b):
        return 0.0
    xs = _slabs(a, b)
    total, e, toggles = 0.0, np.concatenate([a, b]), np.repeat([True, False], [len(a), len(b)])
    step = max(1, (1 << 21) // len(e))
    for k in range(0, len(xs) - 1, step):
        part = xs[k : k + step + 1]
        mid, width = (part[1:] + part[:-1]) / 2, np.diff(part)
        on = (e[:, 0] < mid[:, None]) & (mid[:, None] < e[:, 2])
        y = np.where(on, e[:, 1] + (e[:, 3] - e[:, 1]) * ((mid[:, None] - e[:, 0]) / (e[:, 2] - e[:, 0])), np.inf)
        order = np.argsort(y, 1, kind="stable")
        y, in_a = np.take_along_axis(y, order, 1), toggles[order]
        both = (np.cumsum(in_a, 1) % 2 == 1) & (np.cumsum(~in_a, 1) % 2 == 1)
        both = both[:, :-1] & np.isfinite(y[:, 1:])
        total += float(np.sum(np.where(both, np.diff(np.where(np.isfinite(y), y, 0.0), axis=1), 0.0).sum(1) * width))
    return total


def _trapezoids(e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Middle, width, and lower and upper y at the middle, of the trapezoids of a polygon given as edges; slabs with fewer trapezoids hold zero heights."""
    xs = _slabs(e)
    step = max(1, (1 << 21) // len(e))
    for k in range(0, len(xs) - 1, step):
        part = xs[k : k + step + 1]
        mid, width = (part[1:] + part[:-1]) / 2, np.diff(part)
        on = (e[:, 0] < mid[:, None]) & (mid[:, None] < e[:, 2])
        y = np.sort(np.where(on, e[:, 1] + (e[:, 3] - e[:, 1]) * ((mid[:, None] - e[:, 0]) / (e[:, 2] - e[:, 0])), np.inf), 1)
        y = y[:, : y.shape[1] // 2 * 2]
        y[~np.isfinite(y)] = 0.0
        yield mid, width, y[:, 0::2], y[:, 1::2]


def area_of(e: np.ndarray) -> float:
    """Area of an even-odd polygon given as edges that do not cross."""
    return sum(float(((hi - lo).sum(1) * width).sum()) for _, width, lo, hi in _trapezoids(e)) if len(e) else 0.0


def inner_point(e: np.ndarray) -> tuple[float, float]:
    """The middle of the largest trapezoid of a polygon given as edges."""
    best, at = 0.0, (float("nan"), float("nan"))
    for mid, width, lo, hi in _trapezoids(e):
        size = (hi - lo) * width[:, None]
        if size.size and size.max() > best:
            i, j = np.unravel_index(size.argmax(), size.shape)
            best, at = size[i, j], (float(mid[i]), float((lo[i, j] + hi[i, j]) / 2))
    return at


def shrunk(xy: np.ndarray, start: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """One polygon's rings with every edge moved inwards by tol, corners mitred; as it is where a ring would vanish by that."""
    out = []
    for k in range(len(start) - 1):
        r = xy[start[k] : start[k + 1]]
        r = r[(r != np.roll(r, 1, 0)).any(1)]
        if len(r) < 3:
            continue
        ends = np.array([0, len(r)])
        if (ring_areas(r, ends)[0] > 0) != (k == 0):
            r = r[::-1]
        d = np.roll(r, -1, 0) - r
        n = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None]
        m = np.roll(n, 1, 0)
        moved = r + tol * (n + m) / np.maximum(1 + (n * m).sum(1), 0.01)[:, None]
        flips = (((np.roll(moved, -1, 0) - moved) * d).sum(1) <= 0).any()
        if flips:
            return xy, start
        out.append(moved)
    return (np.concatenate(out), np.cumsum([0] + [len(r) for r in out])) if out else (xy, start)


def _rims(inner: np.ndarray, ends: np.ndarray, outer: np.ndarray, before: np.ndarray, outer_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of pieces: whether an edge of the outer one meets the inner one's bounding box, and whether that box's middle is inside the outer one."""
    if not len(ends) - 1:
        return np.zeros(0, bool), np.zeros(0, bool)
    low, high = np.minimum.reduceat(inner, ends[:-1]), np.maximum.reduceat(inner, ends[:-1])
    pair = np.repeat(np.arange(len(ends) - 1), np.diff(outer_ends))
    prev = outer[before]
    meets = ((np.minimum(prev, outer) < high[pair]) & (np.maximum(prev, outer) > low[pair])).all(1)
    x, y = ((low + high) / 2)[pair].T
    spans = (prev[:, 1] > y) != (outer[:, 1] > y)
    rise = np.where(spans, outer[:, 1] - prev[:, 1], 1.0)
    right = spans & (x < (outer[:, 0] - prev[:, 0]) * ((y - prev[:, 1]) / rise) + prev[:, 0])
    return np.bincount(pair, meets, len(low)) > 0, np.bincount(pair, right, len(low)) % 2 == 1


# ---------------------------------------------------------------- tables
def sound(polys: DataFrame) -> DataFrame:
    """Polygons with an outer ring, all of whose corners are finite numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    corners = F.forall("rings", lambda r: F.coalesce(F.forall(r, lambda p: number(p["x"]) & number(p["y"])), F.lit(False)))
    return polys.filter(F.col("rings").isNotNull() & (F.size("rings") > 0) & F.coalesce(corners, F.lit(False)))


def _cut_table(df: DataFrame, keys: list[str], size: float, shapes: bool) -> DataFrame:
    """keys, cy, cx, area (and rings, cover, corners) of the pieces of polygons in ranges y0, y1, x0, x1 of cells."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["cy long", "cx long", "area double"] + ([f"rings {RINGS}", "cover boolean", "corners long"] if shapes else []))
    names = [*keys, "cy", "cx", "area"] + (["rings", "cover", "corners"] if shapes else [])

    def pieces(batches):
        for b in batches:
            xy, start, rings = flat(b.column("rings"))
            box = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("y0", "y1", "x0", "x1")], 1).astype(np.int64)
            for row, cy, cx, area, pts, at, r in cut(xy, start, rings, box, size):
                cols = [b.column(k).take(pa.array(row)) for k in keys] + [pa.array(cy), pa.array(cx), pa.array(area)]
                if shapes:
                    n = np.bincount(np.repeat(np.arange(len(r)), r), np.diff(at), len(r)).astype(np.int64)
                    cols += [nested(pts, at, r), pa.array(covers(pts, at, r, cy, cx, area, size)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*keys, "rings", "y0", "y1", "x0", "x1").mapInArrow(pieces, out)


def cell_pieces(polys: DataFrame, keys: list[str], res: float, shapes: bool = True) -> DataFrame:
    """Pieces of polygons (column rings) in cells of res, a row for each; shapes without area or with unsound corners have none."""
    xs, ys = F.get("rings", F.lit(0))["x"], F.get("rings", F.lit(0))["y"]
    low, high = lambda c: F.floor(F.array_min(c) / res), lambda c: F.ceil(F.array_max(c) / res)
    ranged = sound(polys).select(*keys, "rings", low(ys).alias("y0"), F.greatest(high(ys), low(ys) + 1).alias("y1"), low(xs).alias("x0"), F.greatest(high(xs), low(xs) + 1).alias("x1"))
    return _cut_table(ranged.filter("x0 is not null and y0 is not null"), keys, res, shapes)


def _children(pieces: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Pieces in cells of `size` cut into the FAN x FAN cells of each."""
    spans = [F.col(c) * FAN + k for c in ("cy", "cx") for k in (0, FAN)]
    return _cut_table(pieces.select(*keys, "rings", *[s.alias(n) for s, n in zip(spans, ("y0", "y1", "x0", "x1"))]), keys, size / FAN, True)


# ---------------------------------------------------------------- groups
def _leaf_edges(ids: list, groups: list, xy: np.ndarray, start: np.ndarray, rings: np.ndarray) -> list[tuple]:
    """Edges that join all overlapping shapes of one leaf, none between shapes that are joined already; the pieces of one leaf only."""
    n, root = len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    known = {}
    for i, g in enumerate(groups):
        root[i] = known.setdefault(g, i)
    ring_ends = np.concatenate([[0], np.cumsum(rings)])
    bounds = start[ring_ends]
    lo, hi = np.minimum.reduceat(xy, bounds[:-1]), np.maximum.reduceat(xy, bounds[:-1])
    boxed = np.array([_is_box(xy[a:b], k) for a, b, k in zip(bounds[:-1], bounds[1:], rings)])
    meet = (lo[:, None] < hi[None]).all(2) & (lo[None] < hi[:, None]).all(2)
    edges, found = {}, []
    for i, j in zip(*np.nonzero(np.triu(meet, 1))):
        a, b = find(i), find(j)
        if a == b:
            continue
        if not (boxed[i] and boxed[j]):
            for k in (i, j):
                if k not in edges:
                    some = start[ring_ends[k] : ring_ends[k + 1] + 1]
                    edges[k] = edges_of(xy[some[0] : some[-1]], some - some[0])
            if not _overlap(edges[i], edges[j]):
                continue
        root[b] = a
        found.append((ids[i], ids[j]))
    return found


def _is_box(points: np.ndarray, rings: int) -> bool:
    """One ring along the four sides of its own bounding box, with its area."""
    if rings != 1:
        return False
    lo, hi, prev = points.min(0), points.max(0), np.roll(points, 1, 0)
    side = ((points == lo) & (prev == lo) | (points == hi) & (prev == hi)).any(1).all()
    return bool(side and abs(ring_areas(points, np.array([0, len(points)]))[0]) > (hi - lo).prod() / 2)


def _overlap(a: np.ndarray, b: np.ndarray) -> bool:
    area = common_area(a, b)
    if area <= 0 or ((a[:, 1] == a[:, 3]).all() and (b[:, 1] == b[:, 3]).all()):
        return area > 0
    return area > 1e-9 * min(area_of(a), area_of(b))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pairs_in(leaves: DataFrame, key: list[str]) -> DataFrame:
    """src, dst: edges inside each leaf; a leaf is one row with a bounded list."""
    spread = leaves.repartition(_partitions(leaves), *key)  # the aggregate's own shuffle, not merged into few tasks where leaves take few bytes
    lists = spread.groupBy(*key).agg(F.collect_list(F.struct("id", "grp", "rings")).alias("m"))

    def join(batches):
        for b in batches:
            src, dst = [], []
            members = b.column("m")
            flatm = members.flatten()
            ids, groups = pc.struct_field(flatm, "id").to_pylist(), pc.struct_field(flatm, "grp").to_pylist()
            xy, start, rings = flat(pc.struct_field(flatm, "rings"))
            ends, ring_ends = np.concatenate([[0], np.cumsum(_lengths(members))]), np.concatenate([[0], np.cumsum(rings)])
            for i, j in zip(ends[:-1], ends[1:]):
                at = start[ring_ends[i] : ring_ends[j] + 1]
                for s, d in _leaf_edges(ids[i:j], groups[i:j], xy[at[0] : at[-1]], at - at[0], rings[i:j]):
                    src.append(s)
                    dst.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return lists.select("m").mapInArrow(join, "src long, dst long")


def overlap_edges(polys: DataFrame, res: float, by: tuple = (), limit: int = 128, corners: int = 20_000, rounds: int = 6) -> DataFrame:
    """src, dst: edges whose components are the groups of polygons with common inner points.  Not all overlapping pairs: at most one a piece.

    Equal shapes hang on the least id.  In a cell that some shape covers wholly, all others hang on that shape.  Other cells compare their pieces if
    they hold at most `limit` shapes with `corners` corners; denser ones are cut on, but for those whose shapes are all joined already.  What is
    still dense after `rounds` cuts is compared in blocks of two chunks of a cell.
    Touching is no overlap; with slanted edges a common area below 1e-9 of the smaller piece counts as touching.  Rows with a null in `by`, without
    id, sound corners or area have no edge; rows of one id are one shape's parts.
    """
    part = F.to_json(F.struct(*by)) if by else F.lit("")
    keyed = sound(polys).filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*by, "id")))).select(part.alias("part"), F.col("id").cast("long").alias("id"), F.col("rings").cast(RINGS).alias("rings"))
    keyed = keyed.withColumn("h", F.sha2(F.to_json("rings"), 256))
    shape = stored(keyed.groupBy("part", "h").agg(F.min("id").alias("id"), F.first("rings").alias("rings")), "shapes")
    equal = keyed.select("part", "h", F.col("id").alias("src")).join(shape.select("part", "h", F.col("id").alias("dst")), ["part", "h"]).filter("src <> dst").select("src", "dst")
    edges, size, cell = [equal], res, ["part", "cy", "cx"]
    open_ = stored(cell_pieces(shape, ["part", "id"], res).withColumn("grp", F.col("id")), "pieces")
    for step in range(rounds + 1):
        full = F.when(F.col("cover"), F.col("id"))
        stat = open_.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("corners").alias("k"), F.min(full).alias("top"), F.min("grp").alias("g0"), F.max("grp").alias("g1"))
        met = open_.join(stat.filter("g0 <> g1"), cell)
        edges.append(met.filter("top is not null and id <> top").select(F.col("id").alias("src"), F.col("top").alias("dst")))
        light = (F.col("n") <= limit) & (F.col("k") <= corners)
        edges.append(_pairs_in(met.filter(F.col("top").isNull() & light), cell))
        dense = met.filter(F.col("top").isNull() & ~light)
        if dense.isEmpty():
            break
        dense = dense.select(*cell, "id", "grp", "rings", "n", "k")
        if step:  # cells whose shapes are joined by now are done
            edges = [stored(reduce(DataFrame.unionByName, edges), "overlaps")]
            named = connected_components(edges[0]).select(F.col("node").alias("id"), "component")
            dense = dense.join(named, "id", "left").withColumn("grp", F.coalesce("component", "id")).drop("component")
            mixed = dense.groupBy(*cell).agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 <> g1")
            dense = dense.join(mixed.select(*cell), cell, "left_semi")
        if step == rounds:
            chunks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("n") / (limit // 2), F.col("k") / (corners // 2)))).cast("long")
            dealt = dense.withColumn("q", chunks).withColumn("c", F.pmod(F.xxhash64("id"), F.col("q"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
            edges.append(_pairs_in(dealt.withColumn("u", F.least("c", "o")).withColumn("v", F.greatest("c", "o")), [*cell, "u", "v"]))
            break
        open_, size = stored(_children(dense, ["part", "id", "grp"], size), "pieces"), size / FAN
    return reduce(DataFrame.unionByName, edges)


# ---------------------------------------------------------------- containment
def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of (x, y) corners."""
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hits = F.filter(pairs, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(hits) % 2 == 1


def contained(outer: DataFrame, inner: DataFrame, res: float, tol: float = 1e-6, limit: int = 128, corners: int = 20_000, rounds: int = 6) -> DataFrame:
    """outer_id, inner_id: outer polygons that hold inner ones whose edges are moved inwards by tol (a shape thinner than that is taken as it is).

    Candidates are the outer polygons around one inner point of the inner one, found on cells; cells that more than `limit` borders cross are cut on.
    A candidate holds it if their common area, summed over the cells, is the whole of it, but for a strip of tol / 1000 along its rim.
    """
    out = sound(outer).select(F.col("id").cast("long").alias("outer_id"), F.col("rings").cast(RINGS).alias("rings"))
    small = sound(inner).select(F.col("id").cast("long").alias("inner_id"), F.col("rings").cast(RINGS).alias("rings"))

    def prepare(batches):
        for b in batches:
            xy, start, rings = flat(b.column("rings"))
            ends, rows, pts, cells = np.concatenate([[0], np.cumsum(rings)]), [], [], []
            for k in range(len(rings)):
                at = start[ends[k] : ends[k + 1] + 1]
                r, s = shrunk(xy[at[0] : at[-1]], at - at[0], tol)
                e = edges_of(r, s)
                if not len(e):
                    continue
                x, y = inner_point(e)
                d = r - r[_before(s)]
                rows.append((k, x, y, area_of(e), float(np.hypot(d[:, 0], d[:, 1]).sum())))
                pts.append(r)
                cells.append(np.diff(s))
            if rows:
                k, x, y, area, rim = (np.array(c) for c in zip(*rows))
                shape = nested(np.concatenate(pts), np.concatenate([[0], np.cumsum(np.concatenate(cells))]), np.array([len(c) for c in cells]))
                yield pa.RecordBatch.from_arrays([b.column("inner_id").take(pa.array(k.astype(np.int64))), shape, *map(pa.array, (x, y, area, rim))], names=["inner_id", "rings", "px", "py", "area", "rim"])

    ready = stored(small.repartition(_partitions(small)).mapInArrow(prepare, f"inner_id long, rings {RINGS}, px double, py double, area double, rim double").filter("area > 0 and not isnan(px)"), "inner")
    pieces = stored(cell_pieces(out, ["outer_id"], res), "outer")

    # leaves: whole cells, and cells with few borders, on every level that was needed
    leaves, open_, size, cell = [], pieces, res, ["cy", "cx"]
    for step in range(rounds + 1):
        stat = open_.filter("not cover").groupBy(*cell).agg(F.count("*").alias("n"), F.sum("corners").alias("k"))
        met = open_.join(stat, cell, "left")
        heavy = ~F.col("cover") & ((F.col("n") > limit) | (F.col("k") > corners))
        last = step == rounds or met.filter(heavy).isEmpty()
        leaves.append((size, met if last else met.filter(~heavy)))
        if last:
            break
        open_, size = stored(_children(met.filter(heavy), ["outer_id"], size), "outer"), size / FAN

    def inside(x, y):
        return F.aggregate("rings", F.lit(False), lambda acc, r: acc != in_ring(x, y, r))

    around = []
    for size, leaf in leaves:
        points = ready.select("inner_id", "px", "py", F.floor(F.col("py") / size).alias("cy"), F.floor(F.col("px") / size).alias("cx"))
        around.append(leaf.select("outer_id", "cy", "cx", "cover", "rings").join(points, cell).filter(F.col("cover") | inside(F.col("px"), F.col("py"))).select("outer_id", "inner_id"))
    pairs = stored(reduce(DataFrame.unionByName, around).distinct(), "candidates")

    def measure(batches):
        for b in batches:
            (xa, sa, ra), (xb, sb, rb) = flat(b.column("rings")), flat(b.column("o_rings"))
            ea, eb = np.concatenate([[0], np.cumsum(ra)]), np.concatenate([[0], np.cumsum(rb)])
            area = b.column("area").to_numpy(zero_copy_only=False).copy()
            crossed, odd = _rims(xa, sa[ea], xb, _before(sb), sb[eb])
            area[~odd] = 0.0
            for k in np.flatnonzero(crossed):
                p, q = sa[ea[k] : ea[k + 1] + 1], sb[eb[k] : eb[k + 1] + 1]
                area[k] = common_area(edges_of(xa[p[0] : p[-1]], p - p[0]), edges_of(xb[q[0] : q[-1]], q - q[0]))
            yield pa.RecordBatch.from_arrays([b.column("outer_id"), b.column("inner_id"), pa.array(area, pa.float64())], names=["outer_id", "inner_id", "common"])

    mine = cell_pieces(ready, ["inner_id"], res).select("inner_id", "cy", "cx", "area", "rings")
    theirs = pieces.select("outer_id", "cy", "cx", F.col("rings").alias("o_rings"))
    # a row costs far more to measure than to send, and a hot outer shape or few bytes would else make few tasks: rows are dealt evenly
    shared = pairs.join(mine, "inner_id").join(theirs, ["outer_id", "cy", "cx"]).select("outer_id", "inner_id", "area", "rings", "o_rings")
    shared = shared.repartition(_partitions(shared)).mapInArrow(measure, "outer_id long, inner_id long, common double")
    total = shared.groupBy("outer_id", "inner_id").agg(F.sum("common").alias("common")).join(ready.select("inner_id", "area", "rim"), "inner_id")
    return total.filter(F.col("common") >= F.col("area") * (1 - 1e-11) - F.col("rim") * (tol * 1e-3)).select("outer_id", "inner_id")
