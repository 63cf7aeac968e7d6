"""Document fingerprints by SimHash, and the search for all fingerprints within a Hamming radius.

A text's terms are its words and word pairs, lower-cased; a term seen n times weighs 1 + ln n.  The 64-bit hash of each term votes on 64 signed
counters; a fingerprint bit is set where the votes are positive.

Search: 64 bits are cut into `blocks` blocks.  Two fingerprints at most `radius` bits apart agree in blocks - radius of them, so a
table for each choice of that many blocks, keyed by those bits (a permutation of the fingerprint), brings them together.  A pair counts
only in the first table that it shares.  Distinct fingerprints are posted, with the number of their documents, and a bucket
gives sums, not pairs: copies and near-copies in any number give a row each.  Buckets above `chunk` are dealt to pairs of chunks.

`with_next` puts each document beside the one that follows it in descending doc_id order, without a global sort in one task: ids are cut
into ranges whose upper bounds are ids that occur, so the row at a bound is also sent to the range above it, where it is the
follower of the last row.

Defined results: a null or empty text has the fingerprint of 64 zero bits and is like another empty one; repeated ids are ordered by
length and text; a single document is followed by itself; rows without id come last; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bounds, shuffle_partitions, whole_texts, written
from .minhash import _HASHES, _mix

RADIUS, BLOCKS, CHUNK = 3, 5, 2048


def fingerprint(text: str | None) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    terms, n = np.unique(np.concatenate([_mix(h), _mix(_mix(h[:-1]) ^ h[1:])]), return_counts=True)
    bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1)
    weight = (1 + np.log(n)).astype(np.float32)
    votes = np.zeros(64)
    for k in range(0, len(terms), 65_536):
        votes += weight[k : k + 65_536] @ bits[k : k + 65_536].astype(np.float32)
    return int.from_bytes(np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{fingerprint(t):016x}" for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, next_fingerprint (of the next document in descending doc_id order), and digest and fingerprint of the edited text."""
    spark = docs.sparkSession
    bounds = id_bounds(docs, 4 * shuffle_partitions(spark))

    def ranges(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            missing = pd.isna(doc)
            at = np.searchsorted(bounds, np.where(missing, bounds[0] if len(bounds) else 0, doc).astype(np.int64)) if len(bounds) else np.zeros(len(doc), np.int64)
            packed = pa.array([squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())
            own = pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.zeros(len(at), bool)), b.column(0), packed], names=["range", "guest", "doc_id", "packed"])
            yield own
            edge = np.flatnonzero(~missing & np.isin(np.where(missing, 0, doc).astype(np.int64), bounds)) if len(bounds) else []
            if len(edge):
                guests = own.take(pa.array(edge))
                above = (guests.column(0).to_numpy() + 1) % len(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(above, pa.int32()), pa.array(np.ones(len(edge), bool)), guests.column(2), guests.column(3)], names=["range", "guest", "doc_id", "packed"])

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        held = first = None  # held: (range, doc_id, text, fingerprint)
        out = []

        def finish(following: str, mark: int):
            text = edited(held[2], following)
            out.append((held[1], len(held[2]), f"{held[3]:016x}", f"{mark:016x}", hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), f"{fingerprint(text):016x}"))

        def rows():
            nonlocal out
            done, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), *[pa.string()] * 4))], names=["doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited_sha256", "edited_fingerprint"])

        for b in batches:
            for where, guest, doc, packed in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0] != where:  # only where no row has an id is there no guest
                    finish(first[2], first[3])
                    held = None
                if guest and held is None:
                    continue
                text = expand.decompress(packed).decode("utf-8", "surrogatepass")
                mark = fingerprint(text)
                if held:
                    finish(text, mark)
                    held = None
                if not guest:
                    if first is None or first[0] != where:
                        first = (where, doc, text, mark)
                    held = (where, doc, text, mark)
            if len(out) >= 500:
                yield rows()
        if held:
            finish(first[2], first[3])
        if out:
            yield rows()

    placed = whole_texts(docs).mapInArrow(ranges, "range int, guest boolean, doc_id long, packed binary")
    ordered = placed.repartition(max(shuffle_partitions(spark), len(bounds) // 4), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.length("packed"), "packed")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, fingerprint string, next_fingerprint string, edited_sha256 string, edited_fingerprint string")


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of the permuted tables: every choice of blocks - radius blocks."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def count_within(marks: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """fingerprint, n_docs, n_within: for each distinct fingerprint its documents, and the other documents at most radius bits away."""
    masks = tables(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = marks.groupBy("fingerprint").agg(F.count("*").alias("n_docs")).withColumn("v", F.conv(F.col("fingerprint"), 16, -10).cast("long"))
    posted = distinct.select("v", "n_docs", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    sizes = posted.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    many = posted.join(sizes, ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("c", F.pmod(F.xxhash64("v", "t"), F.col("chunks")).cast("int"))
    blocks_of = many.select("t", "key", "v", "n_docs", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d")).select("t", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2).alias("side"), "v", "n_docs")

    def block(t, rows):
        v, n, side = (np.array(c) for c in zip(*((r[1], r[2], r[0]) for r in rows)))
        v = v.astype(np.int64).view(np.uint64)
        a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        apart = v[a][:, None] ^ v[b][None, :]
        near = np.bitwise_count(apart) <= radius
        if not side.any():
            np.fill_diagonal(near, False)
        for m in masks[:t]:
            near &= (apart & np.uint64(m)) != 0  # counted in an earlier table
        found = np.zeros(len(v), np.int64)
        found[a] += near @ n[b]
        if side.any():
            found[b] += near.T @ n[a]
        return [(int(x), int(k)) for x, k in zip(v.view(np.int64), found) if k]

    def run(batches):
        key, rows, out = None, [], []
        for b in batches:
            for t, k, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (t, k, i, j) != key:
                    out += block(key[0], rows) if len(rows) > 1 else []
                    key, rows = (t, k, i, j), []
                rows.append(row)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist([{"v": x, "k": y} for x, y in out], schema=pa.schema([("v", pa.int64()), ("k", pa.int64())]))
                out = []
        out += block(key[0], rows) if len(rows) > 1 else []
        if out:
            yield pa.RecordBatch.from_pylist([{"v": x, "k": y} for x, y in out], schema=pa.schema([("v", pa.int64()), ("k", pa.int64())]))

    sums = blocks_of.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(run, "v long, k long").groupBy("v").agg(F.sum("k").alias("n_within"))
    return distinct.join(sums, "v", "left").select("fingerprint", "n_docs", F.coalesce("n_within", F.lit(0)).alias("n_within"))


def _like(a: str, b: str):
    apart = F.bit_count(F.conv(F.col(a), 16, -10).cast("long").bitwiseXOR(F.conv(F.col(b), 16, -10).cast("long")))
    return 1 - apart / F.lit(64.0)


def compare(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each document: fingerprints and likenesses, and n_near: other documents within the radius."""
    seen = written(with_next(docs), "fingerprints")
    near = count_within(seen.select("fingerprint"), radius).select("fingerprint", (F.col("n_docs") - 1 + F.col("n_within")).alias("n_near"))
    return seen.join(near, "fingerprint").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", _like("fingerprint", "edited_fingerprint").alias("near_edited"), _like("fingerprint", "next_fingerprint").alias("near_next"), "n_near")
