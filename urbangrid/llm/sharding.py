"""Shards of near-equal bytes by a k-d tree over metadata.

Rows of equal text form a group, one point of the tree: its coordinates are the group's metadata (`dims`), its weight the bytes of all its rows.  The
tree starts with the whole table and the number of shards; a node of k shards is split at the weighted median that leaves k // 2 shards' share
on one side, along the dimension in which its points are widest, until each leaf is one shard, that is until leaves reach the target of total / shards.

Coordinates are 16-bit: numbers scaled to the table's range, strings by their crc32.  Ties are broken by 47 bits of the text's hash, so (coordinate, hash) is
a total order of 63-bit keys and a hot value (one source, one language) is cut as finely as any.  All nodes of a level are split together: an aggregate
gives the extent of each node's points, and the median is found digit by digit, each round one exact sum of weights by the next `DIGIT` bits
of the keys that share the median's prefix.  What comes to the driver is bounded by shards * 2^DIGIT rows, whatever the size of the table.

A group at the median goes whole to the side that keeps the halves closer, so equal texts share a shard.  Where that would move the balance by more than
`slack` of a shard (a group of copies that holds much of the table), the group is cut between its rows; a table has at most shards - 1 such cuts.

Size is the UTF-8 bytes of the text and `overhead`.  Only sizes, hashes and metadata are shuffled, never texts.

Defined results: a null text has size `overhead` and is a text of its own, beside the empty one; a null coordinate comes before all others; rows with the same id or
repeated rows are rows of their own; slots follow doc_id (nulls first) in each shard; fewer groups than shards leave shards empty; an empty table gives an empty table;
columns that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import dense_position
from .common import written

DIGIT = 12  # bits a round; six rounds at most
BITS = 63
HASH_BITS = 47
OVERHEAD = 16


@dataclass
class Node:
    """A part of the table that makes `shards` shards from number `first` on."""

    first: int
    shards: int
    dim: int | None = None
    cut: int | None = None  # keys below it go to the left
    low: Node | None = None
    high: Node | None = None
    pieces: list = field(default_factory=list)  # parts of groups that a cut has divided


@dataclass
class Piece:
    """Rows start..stop-1 of a group whose rows were divided."""

    group: str
    coords: tuple
    keys: tuple
    size: int
    start: int
    stop: int

    @property
    def weight(self) -> int:
        return self.size * (self.stop - self.start)


def leaves(node: Node):
    if node.low is None:
        yield node
    else:
        yield from leaves(node.low)
        yield from leaves(node.high)


def _coordinates(df: DataFrame, dims: list[str]) -> list[Column]:
    """Sixteen-bit coordinates of the columns."""
    numeric = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    df = df.select(*[F.when(F.abs(F.col(d).cast("double")) < float("inf"), F.col(d)).alias(d) for d in numeric])
    ends = df.agg(F.lit(0), *[f(d) for d in numeric for f in (F.min, F.max)]).first()[1:] if numeric else ()
    ends = {d: ends[2 * i : 2 * i + 2] for i, d in enumerate(numeric)}
    out = []
    for d in dims:
        if d in ends:
            lo, hi = ends[d]
            x = F.col(d).cast("double")
            c = F.when(F.abs(x) < float("inf"), F.lit(1) if lo is None or lo == hi else 1 + F.floor((x - float(lo)) / (float(hi) - float(lo)) * 65534))
        else:
            c = 1 + F.crc32(F.col(d).cast("string")) % 65535
        out.append(F.coalesce(c.cast("long"), F.lit(0)))
    return out


def _place(node: Node, leaf_of) -> Column:
    """The number of a point's node, by the cuts made so far."""
    if node.low is None:
        return F.lit(leaf_of[id(node)])
    return F.when(F.col(f"k{node.dim}") < F.lit(node.cut), _place(node.low, leaf_of)).otherwise(_place(node.high, leaf_of))


def _split_level(points: DataFrame, root: Node, open_: list[Node], n_dims: int, slack: float) -> None:
    """Splits the given leaves at their weighted medians."""
    every = [*leaves(root)]
    number = {id(x): i for i, x in enumerate(every)}
    placed = points.withColumn("node", _place(root, number))
    wanted = placed.filter(F.col("node").isin(*[number[id(x)] for x in open_]))
    extent = {r["node"]: r for r in wanted.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(f"c{d}").alias(f"{n}{d}") for d in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    medians = []
    for x in open_:
        r = extent.get(number[id(x)])
        coords = [p.coords for p in x.pieces]
        lows = [min([c[d] for c in coords] + ([r[f"lo{d}"]] if r else []), default=0) for d in range(n_dims)]
        highs = [max([c[d] for c in coords] + ([r[f"hi{d}"]] if r else []), default=0) for d in range(n_dims)]
        x.dim = max(range(n_dims), key=lambda d: (highs[d] - lows[d], -d))
        total = (int(r["weight"]) if r else 0) + sum(p.weight for p in x.pieces)
        medians.append(_Median(x, number[id(x)], total, total * (x.shards // 2) / x.shards))
    shift = BITS
    while shift and (searched := [m for m in medians if not m.single]):  # the others are down to one group
        wide, shift = shift, max(0, shift - DIGIT)
        key = _case(searched, lambda m: F.col(f"k{m.node.dim}"))
        near = wanted.withColumn("key", key).filter(F.shiftright("key", wide) == _case(searched, lambda m: F.lit(m.prefix)) if wide < BITS else F.col("key").isNotNull())
        found: dict[int, dict[int, tuple[int, int]]] = {}
        for r in near.groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("weight").alias("weight"), F.count("*").alias("groups")).collect():
            found.setdefault(r["node"], {})[r["digit"]] = (int(r["weight"]), r["groups"])
        for m in searched:
            here = found.get(m.number, {})
            for piece in m.node.pieces:
                k = piece.keys[m.node.dim]
                if wide == BITS or k >> wide == m.prefix:
                    weight, n = here.get(k >> shift, (0, 0))
                    here[k >> shift] = (weight + piece.weight, n + 1)
            m.descend(here, shift)
    heavy = [m for m in medians if m.off() > slack * m.total / m.node.shards]
    groups: dict[int, list] = {}
    if heavy:
        at = placed.withColumn("key", _case(heavy, lambda m: F.when(F.shiftright(f"k{m.node.dim}", m.bits) == m.prefix, F.lit(True)))).filter("key")
        for r in at.select("node", "text_key", "size", "n", *[f"c{d}" for d in range(n_dims)], *[f"k{d}" for d in range(n_dims)]).collect():  # one a node but for equal hashes
            groups.setdefault(r["node"], []).append(Piece(r["text_key"], tuple(r[f"c{d}"] for d in range(n_dims)), tuple(r[f"k{d}"] for d in range(n_dims)), r["size"], 0, r["n"]))
    for m in medians:
        x = m.node
        x.low, x.high = Node(x.first, x.shards // 2), Node(x.first + x.shards // 2, x.shards - x.shards // 2)
        x.cut = (m.prefix + m.leftward()) << m.bits
        room = m.want - m.below
        for q in x.pieces + groups.get(m.number, []):
            if m in heavy and q.keys[x.dim] >> m.bits == m.prefix:  # cut between its rows
                rows = min(q.stop - q.start, max(0, round(room / q.size)))
                room -= rows * q.size
                parts = ((x.low, q.start, q.start + rows), (x.high, q.start + rows, q.stop))
            else:
                parts = ((x.low if q.keys[x.dim] < x.cut else x.high, q.start, q.stop),)
            for side, start, stop in parts:
                if start < stop:
                    side.pieces.append(Piece(q.group, q.coords, q.keys, q.size, start, stop))
        x.pieces = []


@dataclass
class _Median:
    """The search for a node's weighted median: `prefix` of the key without its last `bits`, the bytes below it and the bytes that share it."""

    node: Node
    number: int
    total: int
    want: float
    prefix: int = 0
    bits: int = BITS
    below: int = 0
    weight: int = 0
    single: bool = False

    def descend(self, sums: dict[int, tuple[int, int]], shift: int) -> None:
        """On to the digit that holds the median, down to `shift` bits; no bits are left to search where it holds one group."""
        for digit in sorted(sums):
            self.prefix, self.weight, groups = digit, *sums[digit]
            if self.below + self.weight > self.want:
                break
            self.below += self.weight
        else:  # nothing there, or all of it wanted on the left
            self.below -= self.weight
            groups = 1
        self.bits = shift
        self.single = groups == 1

    def leftward(self) -> bool:
        """Whether the group at the median is better on the left."""
        return self.below + self.weight - self.want < self.want - self.below

    def off(self) -> float:
        return abs(self.below + self.weight * self.leftward() - self.want)


def _case(medians: list[_Median], value) -> Column:
    return F.coalesce(*[F.when(F.col("node") == m.number, value(m)) for m in medians])


def build(groups: DataFrame, n_dims: int, shards: int, slack: float) -> Node:
    """The tree over groups (text_key, size, n, weight, c0.. coordinates, k0.. keys)."""
    root = Node(0, shards)
    while open_ := [x for x in leaves(root) if x.shards > 1]:
        divided = sorted({q.group for x in leaves(root) for q in x.pieces})
        points = groups.filter(~F.col("text_key").isin(*divided)) if divided else groups
        _split_level(points, root, open_, n_dims, slack)
    return root


def sizes(docs: DataFrame, dims: tuple[str, ...], overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_key (digest of the text; empty for a null text) and metadata d0.. of each row."""
    text = F.col(text_col)
    octets = F.coalesce(text, F.lit("")).cast("binary")
    named = [F.col(d).alias(f"d{i}") for i, d in enumerate(dims)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(octets) + overhead).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("text_key"), *named)


def points(rows: DataFrame, n_dims: int) -> DataFrame:
    """text_key, size, n, weight, coordinates c0.. and keys k0.. of each group: the least metadata of its rows."""
    dims = [f"d{i}" for i in range(n_dims)]
    least = rows.groupBy("text_key").agg(F.min("size").alias("size"), F.count("*").alias("n"), *[F.min(d).alias(d) for d in dims])
    tie = F.shiftrightunsigned(F.xxhash64("text_key"), 64 - HASH_BITS)
    groups = least.select("text_key", "size", "n", (F.col("size") * F.col("n")).alias("weight"), tie.alias("tie"), *[c.alias(f"c{i}") for i, c in enumerate(_coordinates(rows, dims))])
    return groups.select("*", *[(F.shiftleft(f"c{i}", HASH_BITS) + F.col("tie")).alias(f"k{i}") for i in range(n_dims)]).drop("tie")


def shard(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("n_chars", "lang", "source"), overhead: int = OVERHEAD, slack: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each row of docs."""
    rows = written(sizes(docs, dims, overhead, id_col, text_col), "sizes")
    groups = written(points(rows, len(dims)), "groups")
    root = build(groups, len(dims), shards, slack)
    every = [*leaves(root)]
    whole = groups.select(F.col("text_key").alias("g"), _place(root, {id(x): x.first for x in every}).cast("int").alias("shard"))
    pieces = [(q.group, q.start, q.stop, x.first) for x in every for q in x.pieces]
    divided = sorted({g for g, *_ in pieces})
    result = rows.filter(~F.col("text_key").isin(*divided)) if divided else rows
    result = result.join(whole, F.col("text_key") == F.col("g")).select("doc_id", "size", "text_crc32", "text_key", "shard")
    if divided:
        numbered = dense_position(rows.filter(F.col("text_key").isin(*divided)).select("doc_id", "size", "text_crc32", "text_key"), ["text_key"], ["doc_id"])
        spans = rows.sparkSession.createDataFrame(pieces, "g string, start long, stop long, shard int")  # at most twice the number of shards
        cut = numbered.join(F.broadcast(spans), (F.col("text_key") == F.col("g")) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop")))
        result = result.unionByName(cut.select("doc_id", "size", "text_crc32", "text_key", "shard"))
    slots = dense_position(result, ["shard"], ["doc_id", "text_key"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
