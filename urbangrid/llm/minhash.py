"""Near-duplicates of word-shingle sets by a signature-coordinate inverted join.

1. Every text becomes its set of hashed shingles and a signature: coordinate k is the shingle that comes first in the k-th pseudo-random
   order.  Texts with equal sets form a class; only the class goes on, so copies cost nothing more.
2. A class is posted under its (coordinate, value) pairs.  Two classes that agree in at least `least` of `coordinates` places
   agree in one of the first coordinates - least + 1, so only this prefix is posted, and lists of one class are dropped.
3. In a list, collisions over the whole signature are counted; a pair is counted in the first list it shares and skipped in later
   ones, by the keys themselves.  Lists above `chunk` classes, or with very long sets, are dealt to pairs of chunks, so no task holds a long list and none is cut short.
4. Of the pairs at or above the match threshold a list gives only a spanning forest, best pairs first: as many rows as members, not all
   pairs.  Each is confirmed on the full sets.  A list where one fails is settled in its block: its members come with their sets, and every pair
   of the list whose ends are not joined yet is tested, until links or pairs run out; again only links of a forest leave the block.
   So classes end in one component exactly when confirmed links join them.

Joins are by shuffle: Spark sizes a table by its file, so what comes of an explode (20 postings a class), an aggregate of it or well-packed ids is taken
for a few MB, and the driver would collect millions of rows to broadcast them.

The chance to miss a pair lies in the signature alone: at the limit of 0.85, 45 of 64 coordinates are missed about once in 2,000 pairs, and far less above it.

Defined results: null or empty texts (or texts of white space) have an empty set, are kept and linked with nothing; with fewer words than a
shingle the whole sequence is one; repeated rows and equal texts are linked; a repeated id is a document of its own on each row, whose links are those of the
row's text; a row without id takes part in links, and has no component (null) where it reaches no id; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.io import dense_position
from .common import likely_among, whole_texts, written

COORDINATES, LEAST, CHUNK = 64, 45, 1024


class _WordHashes(dict):
    """word -> 64-bit hash; bounded, and long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 256:
            if len(self) > 400_000:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles (A-Z lowered; white space is space and \\x09-\\x0D)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    acc = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        acc = _mix(acc ^ h[i : len(h) - size + 1 + i])
    return np.unique(acc)


_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | 1)[:, None]
_FLIP = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the shingle (64 bits) that comes first in its order."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.empty(COORDINATES, np.int64)
    for k in range(0, COORDINATES, 16):
        best[k : k + 16] = ((low ^ _FLIP[k : k + 16]) * _MULTIPLY[k : k + 16]).argmin(axis=1)
    return shingles[best]


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def sketches(docs: DataFrame, n: int, prefix: int) -> DataFrame:
    """doc_id, row_key (of id and text), n_shingles, set_key (digest of the set; null: empty), keys (posting keys, 8 bytes each), sig (16 bits of each coordinate)."""
    spread = np.arange(1, prefix + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, n) for t in b.column(2).to_pylist()]
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([*map(len, sets)], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if g is None else _mix(g[:prefix] ^ spread).astype("<u8").tobytes() for g in sigs], pa.binary()),
                    pa.array([None if g is None else (g >> np.uint64(48)).astype("<u2").tobytes() for g in sigs], pa.binary()),
                ],
                names=["doc_id", "row_key", "n_shingles", "set_key", "keys", "sig"],
            )

    return _keyed_texts(docs).mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_key binary, keys binary, sig binary")


def _roots(n: int):
    root = [*range(n)]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    return root, find


def candidates(sigs: np.ndarray, early: np.ndarray, side: np.ndarray, parts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block with at least `least` equal coordinates and different parts that meet in no earlier list; best first.

    early: the keys under which each member is posted before this list, whole, so that a pair is passed over only where an earlier list does hold
    it; sigs: 16 bits of each coordinate from the list's own on (a pair that is not passed over has none before).
    side: 0 throughout, or 1 and 2 for the two chunks of a block between chunks.
    """
    rows, cols = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    count = np.zeros((len(rows), len(cols)), np.uint8)
    earlier = np.zeros((len(rows), len(cols)), bool)
    for k in range(sigs.shape[1]):
        count += sigs[rows, k][:, None] == sigs[cols, k][None, :]
    for k in range(early.shape[1]):
        earlier |= early[rows, k][:, None] == early[cols, k][None, :]
    good = (count >= least) & ~earlier & (parts[rows][:, None] != parts[cols][None, :])
    i, j = np.nonzero(good if side.any() else np.triu(good, 1))
    order = np.argsort(-count[i, j].astype(np.int16), kind="stable")
    return rows[i[order]], cols[j[order]]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def forest(a: np.ndarray, b: np.ndarray, parts: np.ndarray, good=None) -> list[tuple[int, int]]:
    """Pairs, in their order, that join parts not joined before and pass `good`."""
    names, member = np.unique(parts, return_inverse=True)
    root, find = _roots(len(names))
    left, out = len(names) - 1, []
    for x, y, p, q in zip(a.tolist(), b.tolist(), member[a].tolist(), member[b].tolist()):
        p, q = find(p), find(q)
        if p != q and (good is None or good(x, y)):
            root[p] = q
            left -= 1
            out.append((x, y))
            if left == 0:
                break
    return out


def _blocks(posts: DataFrame, least: int, percent: int | None = None) -> DataFrame:
    """key, i, j, x, y: a spanning forest of each block's candidate pairs, or (with percent and a column shingles) of its links."""
    schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])

    def block(key, rows):
        if len(rows) < 2:
            return []
        side, ids, parts, sigs, early = (list(c) for c in zip(*(r[:5] for r in rows)))
        whole = np.frombuffer(b"".join(early), "<u8").reshape(len(rows), -1) if early[0] else np.empty((len(rows), 0), np.uint64)
        a, b = candidates(np.frombuffer(b"".join(sigs), "<u2").reshape(len(rows), -1), whole, np.array(side), np.array(parts), least)
        good = None
        if percent is not None:
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            good = lambda x, y: linked(sets[x], sets[y], percent)
        return [(*key, min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in forest(a, b, np.array(parts), good)]

    def run(batches):
        key, rows, out = None, [], []
        for b in batches:
            for k, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (k, i, j) != key:
                    out += block(key, rows)
                    key, rows = (k, i, j), []
                rows.append(row)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out = []
        out += block(key, rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    dealt = posts.select("key", "i", "j", "side", "id", "part", "sig", "early", *(["shingles"] if percent is not None else []))
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id").mapInArrow(run, "key long, i int, j int, x long, y long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with `linked`: 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        for b in batches:
            kept = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("set_x").to_pylist(), b.column("set_y").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(kept, pa.bool_())], names=["key", "i", "j", "x", "y", "linked"])

    with_x = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("set_x")).hint("merge"), "x")
    with_y = with_x.join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("set_y")).hint("merge"), "y")
    return with_y.select("key", "i", "j", "x", "y", "set_x", "set_y").mapInArrow(run, "key long, i int, j int, x long, y long, linked boolean")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, least: int = LEAST, chunk: int = CHUNK, chunk_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    prefix = COORDINATES - least + 1
    drawn = written(sketches(docs, shingle, prefix), "sketches")
    # a class is named by a number of its own: two sets whose rows bear one id are two classes
    classes = drawn.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n_set"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    key = F.conv(F.hex(F.substring("keys", F.col("at") * 8 + 1, F.lit(8))), 16, -10).cast("long")
    posted = classes.select("id", "n_set", "keys", F.explode(F.sequence(F.lit(0), F.lit(prefix - 1))).alias("at")).select("id", "n_set", "at", key.alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_set").alias("n_set")).filter("n > 1")
    # a chunk holds about `chunk` members and, where their sets are needed, about chunk_shingles of their shingles
    deal = F.least("n", F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("n_set") / chunk_shingles))).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int")
    marks = classes.select("id", "keys", "sig")
    members = posted.drop("n_set").join(sizes.withColumn("chunks", deal).hint("merge"), "key").withColumn("c", own).join(marks.hint("merge"), "id")
    early, late = F.substring("keys", F.lit(1), F.col("at") * 8), F.substring("sig", F.col("at") * 2 + 1, F.lit(2 * COORDINATES))
    blocks = members.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")).select(
        "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2).alias("side"), "id", F.col("id").alias("part"), late.alias("sig"), early.alias("early")
    )
    posts = written(blocks, "posts")

    pairs = written(_blocks(posts, least), "pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()

    def as_sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    wanted = written(wanted.join(classes.select("id", "row_key").hint("merge"), "id"), "wanted")
    # one text for each class asked for; equal rows meet before they are shuffled
    texts = likely_among(_keyed_texts(docs), "row_key", wanted.select("row_key")).groupBy("row_key").agg(F.first("text").alias("text"))
    sets = written(texts.join(wanted.hint("merge"), "row_key").select("id", "text").mapInArrow(as_sets, "id long, shingles binary"), "sets")
    tested = written(_confirm(pairs, sets, percent), "tested")
    links = tested.filter("linked").select("x", "y")
    open_ = tested.filter("not linked").select("key", "i", "j").distinct()
    if not open_.isEmpty():
        settled = posts.join(open_.hint("merge"), ["key", "i", "j"], "left_semi").join(sets.hint("merge"), "id")
        links = links.unionByName(written(_blocks(settled, least, percent).select("x", "y"), "links"))
    parts = connected_components(links, "x", "y")

    ids = classes.select("id", "least")
    least = parts.join(ids.hint("merge"), F.col("node") == F.col("id")).groupBy("component").agg(F.min("least").alias("component_id"))
    reached = parts.join(least.hint("merge"), "component").select("node", "component_id")
    named = classes.select("set_key", "id", "least").join(reached.hint("merge"), F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("component_id", "least").alias("component"))
    component = F.coalesce("component", "doc_id")
    return drawn.select("doc_id", "n_shingles", "set_key").join(named.hint("merge"), "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows, with their columns, of one document of each group: the one with the smallest id.

    Each row is a document: of rows that share an id, the one whose text comes first goes before the others, and rows without id come after all ids.
    Rows with an empty set stay, each of them.
    """
    n, with_id, ids = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct(F.col("doc_id").cast("long"))).first()
    if n == with_id == ids:
        numbered = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("position"), "text")
    else:  # ids that do not tell rows apart give way to positions
        numbered = dense_position(docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), "text"), [], ["none", "id", "text"])
    found = near_duplicates(numbered.select(F.col("position").alias("doc_id"), "text"), **options)
    kept = found.filter("kept").select(F.col("doc_id").alias("kept"))
    return numbered.join(kept.hint("merge"), F.col("position") == F.col("kept"), "left_semi").select("row.*")
