"""Conversation repair: all edit scripts tried on small conversations, long ones in blocks against short ones, and the awkward inputs."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbangrid.llm import conversations as C

RAW = "conv_id long, turn long, role string, text string, audit string, copy string, gone string, kind string"  # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], RAW)


def damaged(rows):
    """conversation: its rows after damage, in order; every conversation is there."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            here += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def scripts(rows, wrong, most=2):
    """Every edit script with at most `most` insertions at each place: (cost, audit, lines)."""
    places = [c for n in range(most + 1) for c in product(["user", "assistant"], repeat=n)]
    edits = [["D"] if w in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for w in wrong]
    for letters in product(*edits):
        for inserted in product(places, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                for role in inserted[i]:
                    cost, audit = cost + 5, audit + "I"
                    lines.append((role, ""))
                if i < len(rows):
                    _, role, text = rows[i]
                    e = letters[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if wrong[i] == "truncated" and e != "D" else 0)
                    if e != "D":
                        lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[e[1]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "-" for r, _ in lines)):
                yield cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def plain(rows):
    out = {}
    for conv, own in damaged(rows).items():
        wrong = faults(own)
        cost, audit, text = min(scripts(own, wrong))
        turns = [t for t, *_ in own if t is not None]
        pairs = [(a[1][:1], b[1][:1]) for a, b in zip(own, own[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(wrong.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in [("s", "u"), ("u", "a"), ("a", "u")] for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def result(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def small(seed, n):
    """Conversations of up to three rows, whatever their damage makes of them."""
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "again.", "again.", "ends? \t", None]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"]
    return [(c, None if rng.random() < 0.1 else int(rng.integers(0, 6)), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for c in range(n) for _ in range(rng.integers(1, 4))]


def test_equals_all_scripts(spark):
    rows = small(5, 120) + [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho.")]
    rows = [r for r in rows if len(damaged([x for x in rows if x[0] == r[0]])[r[0]]) <= 3]
    got = C.repair(C.damage(frame(spark, rows)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert result(got) == plain(rows)


def test_agenda_pops_in_order():
    rows = [("s", 0), ("u", 0), ("u", C.TRUNCATED), ("a", 0), ("a", C.DUPLICATE), ("t", 0)]
    ends = C.derive(rows, whole=False)
    assert min(ends[q] for q in C.ENDS) == min(C.derive(rows).values()) == (6, "KKDKDD")


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_give_what_whole_conversations_give(spark, block):
    """Every conversation is taken as a long one, cut into blocks; one holds most rows."""
    rng = np.random.default_rng(9)
    rows = [(c, int(t), ["user", "assistant"][t % 2], f"text {rng.integers(0, 300)}{['.', ''][int(rng.random() < 0.1)]}") for c in range(12) for t in rng.permutation(rng.integers(0, 12))]
    rows += [(77, int(t), ["system", "user", "assistant"][rng.integers(3)], f"line {rng.integers(0, 400)}.") for t in range(700) if rng.random() < 0.9]
    rows += [(78, None, "user", "same."), *[(79, k, "user", "same.") for k in range(60)], (80, 5, None, None)]
    given = C.damage(frame(spark, rows))
    whole = result(C.repair(given, long_rows=100_000))
    assert set(whole) == {r[0] for r in rows}
    assert result(C.repair(given, long_rows=0, block=block)) == whole
    assert result(C.repair(given, long_rows=50, block=block)) == whole
    assert result(C.repair(given, long_bytes=600, block=block)) == whole


def test_no_rows_after_damage(spark):
    gone = next((c, t) for c in range(100) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    for options in ({}, {"long_rows": 0}):
        assert result(C.repair(C.damage(frame(spark, [(*gone, "user", "Hi.")])), **options)) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair(C.damage(frame(spark, []))).count() == 0


def test_long_texts(spark):
    rows = [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "y " * 200_000 + "!")]
    got = C.repair(C.damage(frame(spark, rows)), long_bytes=1000)
    assert result(got) == result(C.repair(C.damage(frame(spark, rows)))) == plain(rows)
    assert got.filter(F.length("audit") > 0).count() == 1
