"""Importance resampling towards a target distribution, with hashed word features and Gumbel draws.

1. Every text becomes an array of hashed features: for its words (A-Z lowered, runs of letters, digits and anything beyond ASCII) the runs of 1 to
   `runs` words, each as the crc32 of its UTF-8 bytes modulo `buckets`.  The arrays are written once, so no text is read or split again.
2. Feature counts of the documents and of the target are summed by Spark, at most `buckets` rows each; they give the gain of each bucket, a table of
   fixed size.  A document's weight is the floored mean of the gains its array names.
3. A weight and a draw from the Gumbel distribution, hashed from doc_id, make the score; the `percent` highest scores of the documents with at least
   `least_words` words are a sample without replacement in proportion to exp(weight / 1000).
4. The cutoff is found by bisection: each job counts, over the written scores, the rows between `TRIALS` evenly spaced trial values, exactly, and goes
   on in the one step that holds the cutoff, until that is one score; among the rows tied at it the same search runs over doc_id.  No sort, no sample,
   nothing but counts comes to the driver.
5. Rows up to the cutoff are dealt to ranges of (score, doc_id) and sorted there; range counts give the ranks.

Defined results: a null or empty text, or one without words, has no features and weight 0; a null doc_id is hashed as nothing after the colon and comes
after all ids in ties; repeated rows are documents of their own, each drawn and ranked for itself (rows tied in score and doc_id stand in the order
of n_features); without target or documents the gains follow the formula; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import dense_position
from .common import written

TRIALS = 256
LAST = 2**63 - 1  # a row without id comes after all ids
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes: whatever is not ASCII counts as a letter


class _Buckets(dict):
    """word -> crc32 modulo the number of buckets; bounded, and long words are not kept."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        b = crc32(word) % self.buckets
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = b
        return b


def features(text: str | None, of: _Buckets, runs: int = 1) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to `runs` words)."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    found = [*map(of.__getitem__, words)]
    for n in range(2, runs + 1):
        found += [of[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.uint16 if of.buckets <= 65_536 else np.uint32)


def arrays(texts: DataFrame, buckets: int, runs: int) -> DataFrame:
    """doc_id, n_words, n_features, features (little-endian bucket numbers) of a table of doc_id and text."""

    def run(batches):
        of = _Buckets(buckets)
        for b in batches:
            rows = [features(t, of, runs) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()), pa.array([f.tobytes() for _, f in rows], pa.binary())], names=["doc_id", "n_words", "n_features", "features"]
            )

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, features binary")


def bucket_counts(drawn: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: a task sends its own sums, Spark adds them up, `buckets` rows come back."""
    kind = np.dtype(np.uint16 if buckets <= 65_536 else np.uint32)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = drawn.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) for each bucket."""
    k, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(all_s) + k) / ((float(s) + 1) * (float(all_t) + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(drawn: DataFrame, gain: np.ndarray, seed: str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    kind = np.dtype(np.uint16 if len(gain) <= 65_536 else np.uint32)

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy()
            weight = np.array([int(gain[np.frombuffer(x, kind)].sum()) // max(1, k) for x, k in zip(b.column(3).to_pylist(), n.tolist())], np.int64)
            score = weight + np.array([gumbel(d, seed) for d in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return drawn.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def bisect(rows: DataFrame, value: str, need: int) -> int:
    """The least v with at least `need` rows of value <= v (1 <= need <= rows), by exact counts at trial values."""
    lo, hi = (int(x) for x in rows.agg(F.min(value), F.max(value)).first())
    below = 0  # rows under lo
    while lo < hi:
        step = max(1, -(-(hi - lo + 1) // TRIALS))
        # only rows in lo..hi are counted, each in the step that holds it: at most TRIALS rows come back
        kind = "BIGINT" if hi - lo < LAST else "DECIMAL(20,0)"
        at = F.expr(f"(CAST({value} AS {kind}) - CAST('{lo}' AS {kind})) div {step}")
        counts = dict(rows.filter(F.col(value).between(lo, hi)).groupBy(at).count().collect())
        for k in sorted(counts):
            if below + counts[k] >= need:
                lo, hi = lo + k * step, min(hi, lo + (k + 1) * step - 1)
                break
            below += counts[k]
    return lo


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, runs: int = 1, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs; rank is null where it is not drawn."""
    drawn = written(arrays(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), buckets, runs), "features")
    wanted = arrays(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), buckets, runs)
    gain = gains(bucket_counts(drawn, buckets), bucket_counts(wanted, buckets))
    # `low` and `tie` ascend from the best row to the worst
    scores = written(scored(drawn, gain, seed).withColumn("low", -F.col("score")).withColumn("tie", F.coalesce("doc_id", F.lit(LAST))), "scores")
    open_ = scores.filter(F.col("n_words") >= least_words)
    need = percent * open_.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if need == 0:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    cut = bisect(open_, "low", need)
    above = open_.filter(F.col("low") < cut).count()
    tie = bisect(open_.filter(F.col("low") == cut), "tie", need - above)
    first = (F.col("n_words") >= least_words) & ((F.col("low") < cut) | ((F.col("low") == cut) & (F.col("tie") <= tie)))
    ranked = dense_position(scores.filter(first).select(*columns, "low", "tie"), [], ["low", "tie", "n_features"])
    # rows of one score and doc_id may go beyond the number: they are not drawn
    rank = F.when(F.col("position") < need, F.col("position") + 1)
    return ranked.select(*columns, rank.alias("rank")).unionByName(scores.filter(~first).select(*columns, F.lit(None).cast("long").alias("rank")))
