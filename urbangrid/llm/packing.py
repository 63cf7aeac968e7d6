"""Packing documents into sequences of at most `window` tokens by Karmarkar-Karp multiway differencing.

Every document is cut into full windows and one rest; a rest above `grain` tokens is cut at `grain`, which leaves differencing
enough small parts to balance.  The rests of a batch are dealt to k windows, k = ceil(sum / window): partial partitions are
merged largest with smallest, the pair of widest spread first, until one near-equal partition is left; when its fullest window
exceeds the capacity, k rises by one and the differencing is done anew.

One map stage: a task packs what it reads in bounded batches; nothing is shuffled or gathered.  A sequence id holds the task
and a count within it, so a lost task gives the same ids when it runs again.

Defined results: a null or empty text is one piece with the end id only; repeated ids and rows are packed a row each; an empty
table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import whole_texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers in k windows of near-equal sums (Karmarkar-Karp: merge partial partitions with opposing imbalances)."""
    if k == 1:
        return [[*range(len(sizes))]]
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [i, *[None] * (k - 1)]))
    heapq.heapify(heap)
    mark = len(sizes)
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, other, held_by_other = heapq.heappop(heap)
        # both in falling order: the largest of one meets the smallest of the other
        sums = sums + other[::-1]
        held = [b if a is None else a if b is None else (a, b) for a, b in zip(held, reversed(held_by_other))]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        held = [held[j] for j in order.tolist()]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), mark, sums, held))
        mark += 1
    return [_items(x) for x in heap[0][3]]


def _items(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += [x[1], x[0]]
        elif x is not None:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity: their number rises from the least possible until differencing fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return dealt
        k += 1


def cuts(n: int, window: int, grain: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full windows, and of the parts of its rest."""
    full = n // window * window
    rest, at = [], full
    while at < n:
        size = min(grain, n - at)
        rest.append((at, size))
        at += size
    return [(s, window) for s in range(0, full, window)], rest


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, grain: int = 256, batch_windows: int = 96, cache_words: int = 500_000) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids are the tokenizer's of the whole text without added special tokens, then end_id.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches):
        enc = encoder(path, cache_words, False)
        end = int(end_id).to_bytes(4, "little")
        first, made = TaskContext.get().partitionId() << 33, 0
        rests: list[tuple] = []
        waiting = 0

        def dealt():
            nonlocal made
            for members in windows([r[2] for r in rests], window):
                at = 0
                for i in members:
                    yield (*rests[i], first + made, at)
                    at += rests[i][2]
                made += 1

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

        for b in batches:
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_batch(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                full, rest = cuts(n, window, grain)
                for s, size in full:
                    out.append((doc, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, first + made, 0))
                    made += 1
                for s, size in rest:
                    rests.append((doc, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n))
                    waiting += size
                if waiting >= batch_windows * window:
                    out += dealt()
                    rests, waiting = [], 0
            if out:
                yield rows(out)
        if rests:
            yield rows([*dealt()])

    return whole_texts(docs).mapInArrow(run, PIECES)
