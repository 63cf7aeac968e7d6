"""Shards by a k-d tree against one built in memory, its laws, and the awkward inputs."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from urbangrid.llm import sharding as S

SCHEMA = "doc_id long, text string, n_chars long, lang string, source string, shard string, size string, slot string"  # clashing names
DIMS = ("n_chars", "lang", "source")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def corpus(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = "é" * int(rng.integers(0, 5)) + "x" * int(rng.geometric(0.01)) + str(rng.integers(0, n // 2 + 1))
        rows.append((i, text, len(text), ["en", "de", None][rng.integers(3)], "hot" if rng.random() < 0.5 else f"s{rng.integers(9)}"))
    rows += [(n + i, "copied text " * 8, 96, "en", "hot") for i in range(copies)]
    return rows


def tree(groups, shards, slack, first=0):
    """(group, start, stop, shard) of parts (key of each dimension, coordinates, size, group, start, stop), by sorting."""
    if shards == 1:
        return [(g, a, b, first) for _, _, _, g, a, b in groups]
    dim = max(range(3), key=lambda d: (max((x[1][d] for x in groups), default=0) - min((x[1][d] for x in groups), default=0), -d))
    total = sum(x[2] * (x[5] - x[4]) for x in groups)
    want, below, low, high = total * (shards // 2) / shards, 0, [], []
    ordered = sorted(groups, key=lambda x: x[0][dim])
    for i, x in enumerate(ordered):
        weight = x[2] * (x[5] - x[4])
        if below + weight > want or i == len(ordered) - 1:
            left = below + weight - want < want - below
            if abs(below + weight * left - want) > slack * total / shards:
                m = min(x[5] - x[4], max(0, round((want - below) / x[2])))
                low += [(*x[:5], x[4] + m)] * bool(m)
                high += [(*x[:4], x[4] + m, x[5])] * (x[4] + m < x[5])
            else:
                (low if left else high).append(x)
            high += ordered[i + 1 :]
            break
        below += weight
        low.append(x)
    return tree(low, shards // 2, slack, first) + tree(high, shards - shards // 2, slack, first + shards // 2)


@pytest.mark.parametrize(("seed", "n", "copies", "shards", "slack"), [(1, 300, 0, 7, 0.005), (2, 200, 150, 13, 0.005), (3, 60, 400, 40, 0.0), (4, 150, 9, 40, 0.3)])
def test_equals_a_tree_in_memory(spark, seed, n, copies, shards, slack):
    docs = frame(spark, corpus(seed, n, copies))
    points = S.points(S.sizes(docs, DIMS), 3).collect()
    assert len({tuple(r[f"k{d}"] for d in range(3)) for r in points}) == len(points)
    parts = tree([(tuple(r[f"k{d}"] for d in range(3)), tuple(r[f"c{d}"] for d in range(3)), r["size"], r.text_key, 0, r.n) for r in points], shards, slack)
    of = {}
    for i, text, *_ in sorted(corpus(seed, n, copies)):
        of.setdefault(hashlib.md5(text.encode()).hexdigest(), []).append(i)
    want = {(of[g][k], s) for g, a, b, s in parts for k in range(a, b)}
    got = S.shard(docs, shards, slack=slack).collect()
    assert {(r.doc_id, r.shard) for r in got} == want and len(got) == len(want)


def laws(docs, got, shards, overhead=16):
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    slots, sums = {}, Counter({s: 0 for s in range(shards)})
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
        sums[r.shard] += r.size
    for s in slots.values():
        s.sort()
        assert [k for k, _ in s] == list(range(len(s)))
        ids = [(d is not None, d or 0) for _, d in s]
        assert ids == sorted(ids)
    return rows, sums


def test_near_equal_with_a_hot_text(spark):
    docs = corpus(5, 900, 1500)
    rows, sums = laws(docs, S.shard(frame(spark, docs), 16), 16)
    mean = sum(sums.values()) / 16
    assert max(abs(x - mean) for x in sums.values()) < 0.12 * mean  # texts of up to 900 bytes among 15,000 a shard
    texts = {d: t for d, t, *_ in docs}
    spread = {}
    for r in rows:
        spread.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 15  # a cut divides one group at most


def test_awkward_rows(spark):
    docs = [(None, None, None, None, None), (None, None, None, None, None), (1, "", 0, "en", "a"), (1, "", 0, "en", "a"), (1, "other", 5, None, "a"), (2, "x" * 300_000, 300_000, "de", None), (2**62, "𝄞é", 2, "en", "b"), (-3, None, -5, "en", "b")]
    laws(docs, S.shard(frame(spark, docs), 4), 4)
    laws(docs, S.shard(frame(spark, docs), 40), 40)
    laws(docs, S.shard(frame(spark, docs), 1), 1)
    same = [(7, "t", 1, "en", "a")] * 50
    _, sums = laws(same, S.shard(frame(spark, same), 5), 5)
    assert set(sums.values()) == {170}
    assert S.shard(frame(spark, []), 8).count() == 0


def test_numbers_without_a_value(spark):
    rows = [(i, f"t{i}", v) for i, v in enumerate([float("nan"), float("inf"), -1.5, 0.0, 7.25, None])]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string, score double"), 3, dims=("score",)).collect()
    assert Counter(r.shard for r in got) == {0: 2, 1: 2, 2: 2}
