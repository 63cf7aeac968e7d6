"""Importance resampling against a row-by-row version, and the awkward inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from urbangrid.llm import resample as R

SCHEMA = "doc_id long, text string, rank string, weight string, low string"  # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA)


def goal(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def plain(rows, target, percent, least, buckets, runs):
    """All of it in dictionaries, from the definitions."""

    def found(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    of = lambda x: zlib.crc32(x.encode()) % buckets
    docs = [(d, *found(t)) for d, t in rows]
    s, t = Counter(of(x) for _, _, f in docs for x in f), Counter(of(x) for text in target for x in found(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, n, f in docs:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], 2**63 if x[0] is None else x[0], x[2]))
    got = [(*(x[k] for k in (0, 2, 3, 4)), i + 1) for i, x in enumerate(order[: percent * len(order) // 100])]
    rest = order[len(got) :] + [x for x in out if x[1] < least]
    return Counter(got + [(*(x[k] for k in (0, 2, 3, 4)), None) for x in rest])


def rows_of(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def texts(seed, n):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{k}x" for k in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(n)]


ODD = [(None, "one two three"), (None, None), (7, ""), (8, None), (9, "é𝄞 ÀB İx 東京 a_b\x00c"), (10, "again " * 30), (10, "again " * 30), (10, "again " * 30), (11, "x" * 200_000), (-5, "w1x " * 9), (2**62, "tie tie"), (2**62, "tie tie tie")]


def test_equals_the_plain_version(spark):
    rows = [*((100 + i, t) for i, t in enumerate(texts(1, 200))), *ODD, *((3, "hot copy of words") for _ in range(60))]
    target = ["w1x w2x W3X", None, "", "again and again é𝄞"]
    for percent, least, buckets, runs in ((10, 3, 10_000, 1), (35, 1, 97, 2), (100, 0, 70_000, 3), (0, 2, 50, 1)):
        got = R.resample(frame(spark, rows), goal(spark, target), percent, least, buckets, runs)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert rows_of(got) == plain(rows, target, percent, least, buckets, runs)


def test_one_id_on_most_rows(spark):
    rows = [(5, f"same words {'x ' * (i % 3)}") for i in range(200)] + [(6, "same words")]
    assert rows_of(R.resample(frame(spark, rows), goal(spark, ["words"]), 50, 2)) == plain(rows, ["words"], 50, 2, 10_000, 1)


def test_empty(spark):
    assert R.resample(frame(spark, []), goal(spark, ["a"])).count() == 0
    got = R.resample(frame(spark, [(1, "a " * 30)]), goal(spark, []), percent=100).first()
    assert (got.n_features, got["rank"]) == (30, 1)


def test_bisection_is_exact(spark):
    for values in ([4], [4] * 9, [*range(-500, 500, 7)] * 3, [-(2**63), 2**63 - 1, 0, 5, 5], [2**62, 2**62 + 1, -3]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        for need in {1, len(values) // 2 or 1, len(values)}:
            assert R.bisect(df, "v", need) == sorted(values)[need - 1]


def test_weights_follow_the_target(spark):
    """Texts with the target's words are drawn far more often."""
    rows = [(i, " ".join(["alpha" if i % 5 == 0 else "beta"] * 30)) for i in range(500)]
    drawn = R.resample(frame(spark, rows), goal(spark, ["alpha " * 200]), percent=20).filter("rank is not null")
    assert drawn.filter(F.col("doc_id") % 5 == 0).count() > 90
