"""Cluster sizes on grids of height and footprint limits, from component trees of tiles that are merged tile by tile.

For one height limit the masks of rising footprint limits nest, and a component tree (max-tree) holds the clusters of all of them: a node is a cluster
that appears at its level, its parent the cluster it becomes part of at a lower one, its area the cells of it and of all below.  Levels are
the numbers of footprint limits a cell reaches.

Height limits nest as well: a tile takes its cells once, by falling height, and a cell is connected to the nodes of its neighbours by merging their two chains of
ancestors (Wilkinson et al. 2008).  After each limit the tile hands over its tree, cut down to the ancestors of its rim's cells: no other cluster can still
grow.  Clusters only grow as limits fall, and a cluster's part in a tile is never larger than the whole, so the largest area seen at a level is a
running maximum that needs no bookkeeping of which clusters are finished.

Four tiles make a tile of twice the side: their trees are connected over the borders between them and cut down to the new rim, until one is
left for each height limit.  A row holds a tree, so rows are tiles times height limits, whatever the number of footprint limits, and cells are never copied.
A tile's rim is only where other tiles follow, not along the raster's own border, so trees stay as small as the border between two tiles.

Limits that no cell tells apart give the same clusters, so trees are made for the limits that some cell stops at, and hold those levels only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


class ComponentTree:
    """par, lev, area: parent (-1: none), level and area of each node; nodes of one level that lead to one another are one cluster.

    best[l]: the largest area seen at level l.
    """

    def __init__(self, levels: int):
        self.par: list[int] = []
        self.lev: list[int] = []
        self.area: list[int] = []
        self.best = [0] * (levels + 1)

    def add(self, level: int) -> int:
        self.par.append(-1)
        self.lev.append(level)
        self.area.append(1)
        if not self.best[level]:
            self.best[level] = 1
        return len(self.par) - 1

    def top(self, i: int) -> int:
        """The node that stands for i's cluster at i's level."""
        par, lev = self.par, self.lev
        level, r = lev[i], i
        while (p := par[r]) >= 0 and lev[p] == level:
            r = p
        while i != r:
            par[i], i = r, par[i]
        return r

    def connect(self, x: int, y: int) -> None:
        """Merges the chains of ancestors of two nodes whose cells touch."""
        par, lev, area, best, top = self.par, self.lev, self.area, self.best, self.top
        x, y, more = top(x), top(y), 0
        if lev[x] < lev[y]:
            x, y = y, x
        while x != y:
            if y < 0:  # the rest of the chain gains what came over
                while x >= 0:
                    area[x] += more
                    if area[x] > best[lev[x]]:
                        best[lev[x]] = area[x]
                    x = top(par[x]) if par[x] >= 0 else -1
                return
            z = top(par[x]) if par[x] >= 0 else -1
            if z >= 0 and lev[z] >= lev[y]:
                area[x] += more
                if area[x] > best[lev[x]]:
                    best[lev[x]] = area[x]
                x = z
            else:
                own = area[x]
                area[x] += more
                if area[x] > best[lev[x]]:
                    best[lev[x]] = area[x]
                par[x], x, y, more = y, y, z, own

    def ancestors(self, cells: list[int]) -> tuple[dict[int, int], list[int]]:
        """Numbers of all ancestors of the cells' nodes, and the cells' own numbers."""
        number, at = {}, []
        for c in cells:
            i = self.top(c)
            at.append(i)
            while i not in number:
                number[i] = len(number)
                if self.par[i] < 0:
                    break
                i = self.top(self.par[i])
        return number, [number[i] for i in at]

    def cut(self, number: dict[int, int]) -> tuple[list, list, list]:
        """(levels, areas, parents) of the numbered nodes."""
        return [self.lev[i] for i in number], [self.area[i] for i in number], [number[self.top(self.par[i])] if self.par[i] >= 0 else -1 for i in number]

    def graft(self, levels: list, areas: list, parents: list) -> int:
        """Takes over the nodes of another tree; returns the number of its first node here."""
        first = len(self.par)
        self.lev += levels
        self.area += areas
        self.par += [p + first if p >= 0 else -1 for p in parents]
        return first

    def weigh(self, kept: dict[int, int], sums: list[float]) -> None:
        """Adds n ln n of each cluster of the nodes not kept, so that the sum of sums from a level on is that of the level's clusters."""
        for i, p in enumerate(self.par):
            if i not in kept and (p < 0 or self.lev[p] != self.lev[i]):
                v = self.area[i] * math.log(self.area[i])
                sums[self.lev[i]] += v
                if p >= 0:
                    sums[self.lev[p]] -= v


_LISTS = {"best": pa.int64(), "sums": pa.float64(), "levels": pa.int32(), "areas": pa.int64(), "parents": pa.int32(), "rim": pa.int64(), "at": pa.int32()}
_TREES = pa.schema([("h", pa.int32()), ("ty", pa.int64()), ("tx", pa.int64()), *((k, pa.list_(t)) for k, t in _LISTS.items())])
_DDL = "h int, ty long, tx long, best array<long>, sums array<double>, levels array<int>, areas array<long>, parents array<int>, rim array<long>, at array<int>"


def _row(tree: ComponentTree, h: int, ty: int, tx: int, cells: list[int], codes: list[int], sums: list[float] | None) -> tuple:
    number, at = tree.ancestors(cells)
    if sums is not None:
        tree.weigh(number, sums)
    return h, ty, tx, list(tree.best), sums or [], *tree.cut(number), codes, at


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _TREES)], schema=_TREES) if rows else _TREES.empty_table()


def _trees(cells: DataFrame, h_used: np.ndarray, d_used: np.ndarray, tile: int, entropy: bool) -> DataFrame:
    """A row for each number of limits in h_used, by its place: best (and sums) of the whole raster, by places in d_used.

    cells: y, x, hl, lev (limits reached, 1 or more); h_used and d_used hold all values of hl and lev, ascending.
    """
    n_levels = len(d_used)
    corner = cells.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()
    y0, x0 = (corner[0] or 0), (corner[1] or 0)
    y_last, x_last = (corner[2] or 0) - y0, (corner[3] or 0) - x0
    span = max(y_last, x_last) // tile
    wide = tile + 2

    def on_rim(y, x, side):
        """Cells of a tile with that side which may touch another tile of the raster."""
        return ((y % side == 0) & (y > 0)) | ((y % side == side - 1) & (y < y_last)) | ((x % side == 0) & (x > 0)) | ((x % side == side - 1) & (x < x_last))

    def sweep(key, table):
        ty, tx = key[0].as_py(), key[1].as_py()
        y, x, hl, lev = (table.column(c).to_numpy() for c in ("y", "x", "hl", "lev"))
        order = np.lexsort((x, y, -hl))
        codes, place = ((y << 32) + x)[order].tolist(), ((y - ty * tile + 1) * wide + x - tx * tile + 1)[order].tolist()
        outer = on_rim(y, x, tile)[order].tolist()
        hl, lev = np.searchsorted(h_used, hl[order]) + 1, (np.searchsorted(d_used, lev[order]) + 1).tolist()
        tree, grid, rim, rim_codes, out, done = ComponentTree(n_levels), [-1] * (wide * wide), [], [], [], 0
        near = (-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1)
        for h in range(int(hl[0]) - 1, -1, -1):
            stop = int(np.searchsorted(-hl, -h, side="left"))  # the cells that reach more than h limits
            for k in range(done, stop):
                i, p = tree.add(lev[k]), place[k]
                grid[p] = i
                for step in near:
                    if (j := grid[p + step]) >= 0:
                        tree.connect(i, j)
                if outer[k]:
                    rim.append(i)
                    rim_codes.append(codes[k])
            done = stop
            out.append(_row(tree, h, ty, tx, rim, list(rim_codes), [0.0] * (n_levels + 1) if entropy else None))
        return _table(out)

    moved = cells.select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "hl", "lev")
    trees = moved.groupBy(F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).applyInArrow(sweep, _DDL)

    def merging(side):
        def merge(key, table):
            h, ty, tx = (k.as_py() for k in key)
            rows = table.to_pylist()
            tree, sums, cells_, codes, part = ComponentTree(n_levels), np.zeros(n_levels + 1), [], [], []
            for n, r in enumerate(rows):
                first = tree.graft(r["levels"], r["areas"], r["parents"])
                cells_ += [first + i for i in r["at"]]
                codes += r["rim"]
                part += [n] * len(r["rim"])
                tree.best = np.maximum(tree.best, r["best"]).tolist()
                if entropy:
                    sums += r["sums"]
            code, of = np.array(codes, np.int64), np.array(part, np.int64)
            order = np.argsort(code)
            for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
                there = np.searchsorted(code, code + (dy << 32) + dx, sorter=order)
                other = order[np.minimum(there, len(code) - 1)] if len(code) else there
                for i in np.flatnonzero((code[other] == code + (dy << 32) + dx) & (of[other] != of)).tolist():
                    tree.connect(cells_[i], cells_[other[i]])
            y, x = code >> 32, code & 0xFFFFFFFF
            rim = np.flatnonzero(on_rim(y, x, side)).tolist()
            return _table([_row(tree, h, ty, tx, [cells_[i] for i in rim], [codes[i] for i in rim], sums.tolist() if entropy else None)])

        return merge

    side = tile
    while span:
        side, span = 2 * side, span // 2
        trees = stored(trees, "component-trees").groupBy("h", F.shiftright("ty", 1).alias("py"), F.shiftright("tx", 1).alias("px")).applyInArrow(merging(side), _DDL)

    def last(batches):
        """Clusters that still reach the raster's rim are whole as well."""
        for b in batches:
            rows = []
            for r in b.to_pylist():
                tree = ComponentTree(n_levels)
                tree.graft(r["levels"], r["areas"], r["parents"])
                sums = list(r["sums"])
                tree.weigh({}, sums)
                rows.append((r["h"], r["ty"], r["tx"], r["best"], sums, [], [], [], [], []))
            yield from _table(rows).to_batches()

    return trees.mapInArrow(last, _DDL) if entropy else trees


def curves(px: DataFrame, hs: list[float], ds: list[float], criterion: str = "share", tile: int = 256) -> DataFrame:
    """h_id, d_id, value for all pairs of limits, by their places in hs and ds: largest cluster / all cells, or sum of p ln p over cluster shares.

    A cell counts where height >= h and footprint >= d, missing values as 0; a pair without cells has share 1 and entropy 0.  Cells are y, x; of a
    cell given twice the greater height and footprint count.
    """
    spark, entropy = px.sparkSession, criterion == "entropy"
    by_h, by_d = np.argsort(np.asarray(hs, float), kind="stable"), np.argsort(np.asarray(ds, float), kind="stable")
    limits = [np.asarray(v, float)[order] for v, order in ((hs, by_h), (ds, by_d))]

    def reach(batches):
        for b in batches:
            y, x, h, f = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            hl, lev = (np.searchsorted(t, v, side="right") for t, v in zip(limits, (h, f)))
            ok = (hl > 0) & (lev > 0)
            yield pa.RecordBatch.from_arrays([pa.array(v[ok], pa.int64()) for v in (y, x, hl, lev)], names=["y", "x", "hl", "lev"])

    value = lambda c: F.coalesce(F.max(F.nanvl(F.col(c).cast("double"), F.lit(None))), F.lit(0.0)).alias(c)
    one = px.groupBy(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(value("height"), value("footprint"))
    cells = stored(one.mapInArrow(reach, "y long, x long, hl long, lev long"), "levels")
    n_h, n_d = len(hs), len(ds)
    # cells of each pair, from their counts by limits reached: no more rows than pairs
    counts = np.zeros((n_h + 1, n_d + 1), np.int64)
    seen = cells.groupBy("hl", "lev").agg(F.count("*").alias("n")).toArrow()
    hl, lev = seen.column("hl").to_numpy(), seen.column("lev").to_numpy()
    counts[hl, lev] = seen.column("n").to_numpy()
    h_used, d_used = np.unique(hl), np.unique(lev)
    at_h, at_d = np.searchsorted(h_used, np.arange(n_h), side="right"), np.searchsorted(d_used, np.arange(n_d), side="right")  # the first that holds more
    totals = counts[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1][1:, 1:]

    def values(batches):
        for b in batches:
            for h, best, sums in zip(*(c.to_pylist() for c in b.columns)):
                n = totals[h]
                out = np.full(n_d, 0.0 if entropy else 1.0)
                if best is not None:
                    some = n > 0
                    if entropy:
                        s = np.cumsum(np.array(sums)[::-1])[::-1][1:]
                        out[some] = s[at_d[some]] / n[some] - np.log(n[some])
                    else:
                        out[some] = np.maximum.accumulate(np.array(best)[::-1])[::-1][1:][at_d[some]] / n[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n_d, by_h[h]), pa.int32()), pa.array(by_d, pa.int32()), pa.array(out, pa.float64())], names=["h_id", "d_id", "value"])

    found = _trees(cells, h_used, d_used, tile, entropy).select(F.col("h").alias("of"), "best", "sums")
    every = spark.createDataFrame([(h, int(r)) for h, r in enumerate(at_h)], "h int, r int")
    return every.join(found, F.col("r") == F.col("of"), "left").select("h", "best", "sums").mapInArrow(values, "h_id int, d_id int, value double")
