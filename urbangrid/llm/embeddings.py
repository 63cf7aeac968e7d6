"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector x is rotated at random and stored as its signs, the code, with the factor f = <code / sqrt(d), rotated x>.  For a
vector y, <code / sqrt(d), rotated y> / f is an unbiased estimate of <x, y>, and sqrt((1 - f^2) / f^2 / (d - 1)) * `width` bounds its error
with a confidence that grows as exp(-width^2 / 2).  The rotated y is stored in four bits a component, whose first bit is its sign, so one mark of d / 2
bytes serves as code and as y; the rounding adds its own share to the bound.  Only pairs whose upper bounds reach the limit are computed anew in
double precision, so no pair below the limit is ever linked.

Marks are posted, not vectors: a list first tells which of its members have a pair to compute, and only those (a few in a hundred where most
vectors have no near-duplicate) come again with their vectors.

Index: signs of further rotations make `tables` keys of `bits` bits.  Vectors at the limit share a sign with probability
1 - acos(limit) / pi, so with this many tables they share a key with probability `recall` or more; bits grow with the logarithm of the number
of vectors, so lists keep their length, and tables grow as the recall asks.  Nothing is fitted and every vector is posted.  Lists above
`chunk` are dealt to pairs of chunks.

Equal vectors form a class and are posted once.  A pair counts in the first table it shares; a list gives sums of links and a
spanning forest of the links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (their component is
themselves); vectors of different length do not link; a repeated id is a vector of its own on each row, whose links are those
of the row's vector; a row without id takes part in links and has no component (null) where it reaches no id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import likely_among, written
from .minhash import _roots

CHUNK = 1024


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal d x d matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def layout(n: int, limit: float, recall: float, bucket: int = 128) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(4, math.ceil(math.log2(max(2, n) / bucket)))
    hit = (1 - math.acos(limit) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def codes(unit: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code bits, factors, table values) of unit vectors, one a row."""
    d = unit.shape[1]
    turned = unit @ rotation(d, 0)
    code = turned > 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    signs = np.concatenate([unit @ rotation(d, 1 + r) > 0 for r in range(-(-bits * tables // d))], axis=1)[:, : bits * tables].reshape(len(unit), tables, bits)
    return code, factor, signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def bounds(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of <x_i, y_j> and their error bounds: code and factor of the x, rotated y."""
    d = turned.shape[1]
    estimate = (np.where(code, 1.0, -1.0) @ turned.T) / math.sqrt(d) / factor[:, None]
    return estimate, (width * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1)))[:, None]


TAIL = np.dtype([("d", "<u4"), ("factor", "<f4"), ("step", "<f4")])


def marks(turned: np.ndarray) -> list[bytes]:
    """Rotated unit vectors in four bits a component (signs kept), with length, factor and step."""
    n, d = turned.shape
    step = np.abs(turned).max(axis=1) / 8
    q = (np.clip(np.floor(turned / step[:, None]), -8, 7) + 8).astype(np.uint8)
    q = np.pad(q, ((0, 0), (0, d % 2)), constant_values=8)
    tail = np.zeros(n, TAIL)
    tail["d"], tail["factor"], tail["step"] = d, np.abs(turned).sum(axis=1) / math.sqrt(d), step
    packed = q[:, ::2] << 4 | q[:, 1::2]
    return [x.tobytes() + t.tobytes() for x, t in zip(packed, tail)]


def maybe_linked(a: list[bytes], b: list[bytes], limit: float, width: float) -> np.ndarray:
    """Boolean matrix of the pairs of marks whose bounds, from either side, allow a product of `limit` or more."""

    def opened(m: list[bytes]):
        tail = np.frombuffer(b"".join(x[-TAIL.itemsize :] for x in m), TAIL)
        packed = np.frombuffer(b"".join(x[: -TAIL.itemsize] for x in m), np.uint8).reshape(len(m), -1)
        q = np.stack([packed >> 4, packed & 15], axis=-1).reshape(len(m), -1)[:, : int(tail["d"][0])]
        return np.where(q >= 8, 1.0, -1.0), (q - 7.5) * tail["step"][:, None].astype(float), tail["factor"].astype(float), tail["step"].astype(float)

    def reaches(code, factor, y, step):
        d = y.shape[1]
        estimate = (code @ y.T) / math.sqrt(d) / factor[:, None]
        error = width * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, d - 1))[:, None] + min(width / math.sqrt(12), math.sqrt(d) / 2) * step[None, :]
        return estimate + error / factor[:, None] >= limit - 1e-6

    (ca, ya, fa, sa), (cb, yb, fb, sb) = opened(a), opened(b)
    return reaches(ca, fa, yb, sb) & reaches(cb, fb, ya, sa).T


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9, recall: float = 0.99, width: float = 4.0, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: x.cast("double"))).alias("v"))

    def units(batches):
        for b in batches:
            given = b.column(1).to_pylist()
            x = [None if g is None else np.array(g, np.float64) for g in given]
            x = [None if g is None else (g / np.abs(g).max()) for g in x]  # so that no square over- or underflows
            u = [None if g is None else g / np.sqrt(g @ g) + 0.0 for g in x]
            packed = [None if g is None else g.tobytes() for g in u]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "key", "unit"])

    drawn = written(rows.mapInArrow(units, "vec_id long, key binary, unit binary"), "units")
    # a class is named by a number of its own: two vectors whose rows bear one id are two classes
    classes = drawn.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "unit-classes")
    bits, tables = layout(classes.count(), limit, recall)

    each = -(-bits // 8)  # bytes of a table's value

    def tabled(batches):
        for b in batches:
            given = b.column(1).to_pylist()
            keys, stored, early = [None] * len(given), [None] * len(given), [None] * len(given)
            lengths = np.array([*map(len, given)])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x = np.frombuffer(b"".join(given[i] for i in at), np.float64).reshape(len(at), -1)
                _, _, values = codes(x, bits, tables)
                for i, m, k in zip(at.tolist(), marks(x @ rotation(x.shape[1], 0)), values):
                    keys[i] = k * 4096 + (size // 8) % 4096
                    stored[i] = m
                    early[i] = k.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :each].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stored, pa.binary()), pa.array(early, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "mark", "early", "keys"])

    posted = written(classes.select("id", "unit").mapInArrow(tabled, "id long, mark binary, early binary, keys array<long>"), "unit-codes")
    lists = posted.select("id", "mark", "early", F.posexplode("keys").alias("t", "key")).withColumn("early", F.substring("early", F.lit(1), F.col("t") * each))
    sizes = posted.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    many = lists.join(sizes, ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("c", F.pmod(F.xxhash64("id", "t"), F.col("chunks")).cast("int"))
    blocks = many.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")).select("t", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2).alias("side"), "id", "mark", "early")

    def by_block(batches, handle):
        """Calls handle(block key, rows) for the rows of each block, which lie together."""
        key, rows = None, []
        for b in batches:
            for t, k, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (t, k, i, j) != key:
                    if len(rows) > 1:
                        yield from handle(key, rows)
                    key, rows = (t, k, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield from handle(key, rows)

    def wanted(key: tuple, rows: list):
        """Members of a block that have a pair to compute, not met in an earlier table."""
        t, out = key[0], set()
        lengths = np.array([int(np.frombuffer(r[2][-TAIL.itemsize :], TAIL)["d"][0]) for r in rows])
        for size in np.unique(lengths):
            own = np.flatnonzero(lengths == size)
            some = [rows[m] for m in own]
            side = np.array([r[0] for r in some])
            a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            if not len(a) or not len(b):
                continue
            good = maybe_linked([some[i][2] for i in a], [some[i][2] for i in b], limit, width)
            i, j = np.nonzero(good if side.any() else np.triu(good, 1))
            before = np.frombuffer(b"".join(r[3] for r in some), np.uint8).reshape(len(some), t, each)
            for k in range(0, len(i), 100_000):
                p, q = a[i[k : k + 100_000]], b[j[k : k + 100_000]]
                first = ~(before[p] == before[q]).all(axis=2).any(axis=1)
                out.update(own[p[first]].tolist(), own[q[first]].tolist())
        return [(*key, rows[m][0], rows[m][1]) for m in sorted(out)]

    def batch(out: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["t", "key", "i", "j", "side", "id"])

    def ask(batches):
        out = []
        for row in by_block(batches, wanted):
            out.append(row)
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    place = ("t", "key", "i", "j")
    asked = written(blocks.repartition(*place).sortWithinPartitions(*place).mapInArrow(ask, "t int, key long, i int, j int, side int, id long"), "asked")
    vectors_of = likely_among(classes.select("id", "w", "unit"), "id", asked.select("id").distinct())
    exact = asked.join(vectors_of.hint("merge"), "id").select(*place, "side", "id", "w", "unit")

    def block(t: int, rows: list) -> tuple[list, list]:
        sizes = np.array([len(r[3]) for r in rows])
        links, sums = [], []
        for size in np.unique(sizes):
            some = [r for r, s in zip(rows, sizes) if s == size]
            side = np.array([r[0] for r in some])
            ids, w = np.array([r[1] for r in some]), np.array([r[2] for r in some])
            x = np.frombuffer(b"".join(r[3] for r in some), np.float64).reshape(len(some), -1)
            d = x.shape[1]
            a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            if not len(a) or not len(b):
                continue
            code, factor, keys = codes(x, bits, tables)
            keys = keys[:, :t]
            estimate, error = bounds(code[a], factor[a], x[b] @ rotation(d, 0), width)
            maybe = estimate + error >= limit
            if side.any():
                i, j = np.nonzero(maybe)
            else:
                i, j = np.nonzero(np.triu(maybe, 1))
            for k in range(0, len(i), 100_000):
                p, q = a[i[k : k + 100_000]], b[j[k : k + 100_000]]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= limit
                p, q = p[good], q[good]
                first = ~(keys[p] == keys[q]).any(axis=1)  # not counted in an earlier table
                p, q = p[first], q[first]
                links.append((ids[p], ids[q]))
                found = np.bincount(p, w[q], len(ids)) + np.bincount(q, w[p], len(ids))
                sums += [(int(ids[m]), int(found[m])) for m in np.flatnonzero(found)]
        if not links:
            return [], []
        x, y = (np.concatenate(c) for c in zip(*links))
        names, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        (_, find), forest = (tree := _roots(len(names))), []
        for p, q in zip(back[: len(x)].tolist(), back[len(x) :].tolist()):
            rp, rq = find(p), find(q)
            if rp != rq:
                tree[0][rp] = rq
                forest.append((int(names[p]), int(names[q])))
        return forest, sums

    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("k", pa.int64())])

    def finish(key: tuple, rows: list):
        forest, sums = block(key[0], rows)
        return [*((x, y, None) for x, y in forest), *((x, None, k) for x, k in sums)]

    def run(batches):
        out = []
        for row in by_block(batches, finish):
            out.append(row)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    found = written(exact.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "x long, y long, k long"), "links")
    parts = connected_components(found.filter("y is not null"), "x", "y")
    sums = found.filter("k is not null").groupBy("x").agg(F.sum("k").alias("k"))
    least = parts.join(classes.select("id", "least"), F.col("node") == F.col("id")).groupBy("component").agg(F.min("least").alias("component_id"))
    reached = parts.join(least, "component").select("node", "component_id")
    named = classes.select("key", "id", "w", "least").join(sums, F.col("id") == F.col("x"), "left").join(reached, F.col("id") == F.col("node"), "left")
    named = named.select("key", (F.col("w") - 1 + F.coalesce("k", F.lit(0))).alias("n"), F.coalesce("component_id", "least").alias("component"))
    component = F.coalesce("component", "vec_id")
    return drawn.select("vec_id", "key").join(named, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
