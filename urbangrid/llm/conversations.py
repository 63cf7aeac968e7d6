"""Repair of conversation structure as a lightest derivation (Knuth 1977).

A conversation is well formed where the initials of its roles read (s?(ua)+)?, four states of an automaton: nothing yet, after s, after u, after a.
An item [i, q] says that the first i rows are dealt with and the automaton is in state q; rules derive items from items at a cost:

    [i, q] |- [i+1, q']  K: the row is kept (0), R: it becomes user or assistant (1), D: it goes (2, state unchanged); a truncated row that stays adds 5
    [i, q] |- [i, q']    I: an empty user or assistant row comes in (5)
    [n, q] |- goal       for the states where a conversation may end

An item's value is (cost, audit), the audit being the letters in order.  A rule adds cost and appends a letter, so it is superior (no value falls
below that of an antecedent) and monotone: two audits of one item that cost the same are never prefixes of each other, as they differ in more than
insertions, so appending keeps their order.  The agenda therefore pops items in order of value, and the first value of an item is final; the
search ends when the goal is popped.

Short conversations are dealt whole to tasks.  Long ones (above `long_rows` rows or `long_bytes` bytes of text) are numbered by ranges, so a conversation that holds much
of the table is cut into blocks of `block` rows; tasks derive [first, q] |- [last, q'] for each block, and a block's lightest derivations are antecedents of
one more rule, [k, q] and block(k, q, q') |- [k+1, q'], whose items are final in the order of k.  The chosen letters go back to the blocks, which are repaired
apart; only SHA-256, serial by nature, reads a repaired conversation's lines in one task, as a stream.

Damage, for tests: `damage` takes a row's hash of `conv_id:turn`.

Defined results: a null role or text is one space; rows without turn come first; rows of one turn stand in the order of role and text; rows without conv_id are
one conversation; repeated rows are duplicates; a conversation without rows has zeros, an empty audit and the hash of an empty text; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import dense_position
from .common import written

LONG_ROWS, LONG_BYTES, BLOCK = 1024, 8 << 20, 256
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
TURNS = [("u", USER, "user"), ("a", ASSISTANT, "assistant")]
ENDS = (START, ASSISTANT)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, copy, gone, role, text: rows dropped (gone; they still name their conversation), emptied, robbed of their ends, repeated or made user rows."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kind = F.col("kind")
    return (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
        .select(
            "conv_id", "turn", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (kind == 0).alias("gone"),
            F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        )
    )


def fault(text: str, seen: bool) -> int:
    """The first fault of a row: blank, duplicate, truncated; 0 for none."""
    end = text.rstrip(SPACE)[-1:]
    return BLANK if not end else DUPLICATE if seen else 0 if end in ".!?" else TRUNCATED


def derive(rows: list[tuple[str, int]], start: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """state: (cost, audit) of the lightest derivations from [0, start] over rows of (role initial, fault).

    whole: only the goal is asked for, so the search ends at the first item at which a conversation may end; else all states after the last row.
    """
    last, done, ends = len(rows), set(), {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == last:
            ends[q] = (cost, audit)
            if (whole and q in ENDS) or len(ends) == 4:
                break
        else:
            initial, wrong = rows[i]
            heapq.heappush(agenda, (cost + 2, audit + "D", i + 1, q))
            if wrong not in (BLANK, DUPLICATE):
                stays = cost + 5 * (wrong == TRUNCATED)
                if (to := NEXT.get((q, initial))) is not None:
                    heapq.heappush(agenda, (stays, audit + "K", i + 1, to))
                for letter, to, _ in TURNS:
                    if letter != initial and NEXT.get((q, letter)) == to:
                        heapq.heappush(agenda, (stays + 1, audit + "R", i + 1, to))
        for letter, to, _ in TURNS:
            if NEXT.get((q, letter)) == to:
                heapq.heappush(agenda, (cost + 5, audit + "I", i, to))
    return {q: v for q, v in ends.items() if q in ENDS} if whole else ends


def repaired(rows, audit: str, q: int = START):
    """The lines role:text that an audit makes of (role, text) rows, from state q on; a row is asked for as its letter comes."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if q == USER else "user"
        q = NEXT[q, role[:1]]
        yield f"{role}:{text}"


class Counts:
    """Counts of rows in order: gaps of turns, faults, illegal neighbours; two stretches that follow each other add up."""

    def __init__(self, values=None):
        self.first_turn, self.last_turn, self.turns, self.first, self.last, self.illegal, self.faults = values or (None, None, 0, None, None, 0, [0, 0, 0, 0])

    def values(self) -> tuple:
        return self.first_turn, self.last_turn, self.turns, self.first, self.last, self.illegal, self.faults

    def row(self, turn: int | None, initial: str, wrong: int) -> None:
        self.add(Counts((turn, turn, int(turn is not None), initial, initial, 0, [int(wrong == k) for k in range(4)])))

    def add(self, later: Counts) -> None:
        if later.first is None:
            return
        if later.first_turn is not None:
            self.turns += later.turns - (self.last_turn == later.first_turn)
            self.first_turn, self.last_turn = later.first_turn if self.first_turn is None else self.first_turn, later.last_turn
        self.illegal += later.illegal + (self.first is not None and (self.last, later.first) not in LEGAL)
        self.first, self.last = later.first if self.first is None else self.first, later.last
        self.faults = [a + b for a, b in zip(self.faults, later.faults)]

    def result(self) -> tuple[int, ...]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal


def grouped(batches, keys: int):
    """(key, iterator over its rows) for rows that lie together by their first columns; an iterator must be used up before the next is asked for."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    yield from ((key, (r[keys:] for r in group)) for key, group in groupby(rows, lambda r: r[:keys]))


def in_batches(rows, schema: pa.Schema, n: int = 500, size: int = 4 << 20):
    """Rows as record batches of at most n rows and about `size` characters of text."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= n or held >= size:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


_RESULT = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_ORDER = ["turn", "role", "text", "copy"]


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, each whole in a task."""

    def one(group) -> tuple:
        counts, seen, kept, faults = Counts(), set(), [], []
        for turn, gone, role, text in group:
            if not gone:
                wrong = fault(text, (role, text) in seen)
                seen.add((role, text))
                counts.row(turn, role[:1], wrong)
                kept.append((role, text))
                faults.append((role[:1], wrong))
        cost, audit = min(derive(faults).values())
        return *counts.result(), cost, audit, hashlib.sha256("\n".join(repaired(kept, audit)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        yield from in_batches(((*key, *one(group)) for key, group in grouped(batches, 1)), _RESULT)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "turn", "gone", "role", "text").mapInArrow(run, RESULT)


_BLOCK = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("faults", pa.list_(pa.int64())), ("ways", pa.list_(pa.struct([("q", pa.int64()), ("to", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])))])
_BLOCK_DDL = "conv_id long, block long, first_turn long, last_turn long, turns long, first string, last string, illegal long, faults array<long>, ways array<struct<q:long,to:long,cost:long,audit:string>>"
_PLAN = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("q", pa.int64()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_LINE = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("k", pa.int64()), ("line", pa.string())])


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any size, in blocks."""
    placed = written(dense_position(rows, ["conv_id"], _ORDER).withColumn("block", F.floor(F.col("position") / block)), "long-rows")
    # a row's text was seen before where an earlier row has it: marks of those rows are sorted in front of them
    keys = placed.filter(~F.col("gone")).select("conv_id", "position", "block", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same"))
    first = keys.groupBy("conv_id", "same").agg(F.min("position").alias("at"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "at")
    again = keys.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s"))).filter(F.col("position") > F.col("at"))
    none = F.lit(None)
    marks = again.select("conv_id", "block", "position", F.lit(0).alias("own"), none.cast("long").alias("turn"), F.lit(False).alias("gone"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    own = placed.select("conv_id", "block", "position", F.lit(1).alias("own"), "turn", "gone", "role", "text")

    def ways(group) -> tuple:
        counts, faults, seen = Counts(), [], False
        for _, is_row, turn, gone, role, text in group:
            if not is_row:
                seen = True
            elif not gone:
                wrong, seen = fault(text, seen), False
                counts.row(turn, role[:1], wrong)
                faults.append((role[:1], wrong))
        return *counts.values(), [{"q": q, "to": to, "cost": cost, "audit": audit} for q in range(4) for to, (cost, audit) in derive(faults, q, whole=False).items()]

    def by_block(batches):
        yield from in_batches(((*key, *ways(group)) for key, group in grouped(batches, 2)), _BLOCK)

    derived = own.unionByName(marks).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position", "own").mapInArrow(by_block, _BLOCK_DDL)

    def plan(conv, group):
        """A row for each block, with its state and letters, and one of the whole conversation (block -1)."""
        counts, best, back = Counts(), {START: (0, "")}, []
        for _, *values, options in group:
            counts.add(Counts(values))
            items: dict[int, tuple] = {}
            for w in options:
                if w["q"] in best:
                    cost, audit = best[w["q"]]
                    items[w["to"]] = min(items.get(w["to"], (float("inf"),)), (cost + w["cost"], audit + w["audit"], w["q"], len(w["audit"])))
            best = {q: v[:2] for q, v in items.items()}
            back.append({q: v[2:] for q, v in items.items()})
        (cost, audit), q = min((v, q) for q, v in best.items() if q in ENDS)
        yield conv, -1, None, *counts.result(), cost, audit
        end = len(audit)
        for k in range(len(back) - 1, -1, -1):
            q, n = back[k][q]
            yield conv, k, q, *[None] * 6, audit[end - n : end]
            end -= n

    def by_conversation(batches):
        yield from in_batches((row for (conv,), group in grouped(batches, 1) for row in plan(conv, group)), _PLAN)

    plans = written(derived.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(by_conversation, "conv_id long, block long, q long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "plans")
    letters = plans.filter("block >= 0").select("conv_id", "block", F.lit(-1).cast("long").alias("position"), "q", F.lit("").alias("role"), F.col("audit").alias("text"))
    asked = placed.filter(~F.col("gone")).select("conv_id", "block", "position", F.lit(None).cast("long").alias("q"), "role", "text").unionByName(letters)

    def lines(key, group):
        _, q, _, audit = next(group)  # the block's letters come first
        yield from ((*key, k, line) for k, line in enumerate(repaired(((role, text) for _, _, role, text in group), audit, q)))
        for _ in group:  # deleted rows at the end
            pass

    def repair(batches):
        yield from in_batches((row for key, group in grouped(batches, 2) for row in lines(key, group)), _LINE)

    told = asked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position").mapInArrow(repair, "conv_id long, block long, k long, line string")

    def digest(group) -> str:
        h, start = hashlib.sha256(), b""
        for _, _, line in group:
            h.update(start + line.encode("utf-8", "surrogatepass"))
            start = b"\n"
        return h.hexdigest()

    def hashed(batches):
        yield from in_batches(((*key, digest(group)) for key, group in grouped(batches, 1)), pa.schema([("conv_id", pa.int64()), ("digest", pa.string())]))

    digests = told.repartition("conv_id").sortWithinPartitions("conv_id", "block", "k").mapInArrow(hashed, "conv_id long, digest string").withColumnRenamed("conv_id", "c")
    whole = plans.filter("block < 0").join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation of rows (conv_id, turn, copy, gone, role, text)."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    long = written(sizes.filter((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("long_id")), "long-ids")
    if long.isEmpty():
        return _short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(long, same, "left_anti")).unionByName(_long(rows.join(long, same, "left_semi"), block))
