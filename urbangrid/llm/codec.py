"""BPE encoding and decoding, and token counts, of whole texts.

`encode_decode`: speculate-and-verify encoding (see `bpe`) and the decoded text.  `count_tokens`: two-tier lookup on the map side.
Both are one map stage over the table: no shuffle of texts or pre-tokens, no group, memory bounded by one Arrow batch and the worker's cache.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and ids give a row each; an
empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, weight
from .common import whole_texts

CACHE_WORDS = 500_000


def encode_decode(docs: DataFrame, path: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, ids array<int>, decoded string: ids without added special tokens, and the text decoded from those ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        enc = encoder(path, cache_words)
        for b in batches:
            packed = enc.encode_batch(b.column(1).to_pylist())
            ids = [np.frombuffer(x, "<u4") for x in packed]
            offsets = np.concatenate([[0], np.cumsum([*map(len, ids)])]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), "<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([enc.decode(x) for x in ids], pa.string())], schema=schema)

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode_decode` gives, digested in the worker so ids need not leave it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc = encoder(path, cache_words)
        sha = hashlib.sha256
        for b in batches:
            packed = enc.encode_batch(b.column(1).to_pylist())
            decoded = [sha(enc.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([sha(x).hexdigest() for x in packed]), pa.array(decoded)], schema=schema)

    return whole_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class LengthTable:
    """Open-addressing hash table of pre-tokens and their numbers of ids in flat arrays: sent as they are and asked for many words at once.

    A slot holds the number of a word; a word is found where its 64-bit hash and then its bytes agree, so any characters may be in it and no
    two words can be taken for each other.
    """

    WORD_BYTES = 36  # of a word beside its text: start, length, hash, and two to four slots

    def __init__(self, lengths: dict[str, int]):
        coded = [w.encode("utf-8", "surrogatepass") for w in lengths]
        self.text = np.frombuffer(b"".join(coded), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([*map(len, coded)])]).astype(np.int64)
        self.lengths = np.array([*lengths.values()], dtype=np.uint32)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(coded))
        self.slots = np.full(1 << max(1, (2 * len(coded) - 1).bit_length()), -1, np.int32)
        mask = np.uint64(len(self.slots) - 1)
        left, at = np.arange(len(coded)), (self.hashes & mask).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want a slot one gets it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & int(mask)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.text, self.starts, self.lengths, self.hashes, self.slots))

    def find(self, words: list[str]) -> np.ndarray:
        """Number of ids of each word, -1 where it is not in the table."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.lengths) or not words:
            return out
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        text, sizes = np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded))
        starts = np.cumsum(sizes) - sizes
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(coded))
        mask = len(self.slots) - 1
        left, at = np.arange(len(words)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            slot = self.slots[at]
            same = (slot >= 0) & (self.hashes[slot] == hashes[left])
            same[same] = self.starts[slot[same] + 1] - self.starts[slot[same]] == sizes[left[same]]
            hit = np.flatnonzero(same)
            if len(hit):
                n = sizes[left[hit]]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                differs = text[np.repeat(starts[left[hit]], n) + inner] != self.text[np.repeat(self.starts[slot[hit]], n) + inner]
                good = hit[np.bincount(np.repeat(np.arange(len(hit)), n), differs, len(hit)) == 0]
                out[left[good]] = self.lengths[slot[good]]
            on = (slot >= 0) & (out[left] < 0)
            left, at = left[on], (at[on] + 1) & mask
        return out


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 4000, table_words: int = 65_536, max_bytes: int = 4_000_000, word_bytes: int = 256) -> LengthTable:
    """Tier one: lengths of the commonest pre-tokens of about sample_docs texts, drawn at random from all partitions.

    Each task counts the words of its drawn texts, Spark adds the counts up and keeps the top table_words; so only counts of this sample are shuffled,
    never pre-tokens of the corpus.  The table only saves work: a word that is not in it is encoded exactly by tier two, so the sample cannot
    change a count.  Words above word_bytes are left to tier two; the size is bounded by table_words and max_bytes whatever the input.
    """
    n = docs.count()
    drawn = whole_texts(docs).select("text").sample(fraction=min(1.0, sample_docs / max(1, n)), seed=7)

    def run(batches):
        enc, n = encoder(path, CACHE_WORDS), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for words, _ in enc.segments(text):
                    n.update(words or ())
        top = [(w, c) for w, c in n.items() if len(w) <= word_bytes]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    counts = drawn.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    words = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(table_words).collect()]  # table_words short rows
    enc = encoder(path, CACHE_WORDS)
    kept, size = {}, 16
    for w, ids in zip(words, enc.encode_words(words)):
        more = len(w.encode("utf-8", "surrogatepass")) + LengthTable.WORD_BYTES
        if size + more <= max_bytes:
            kept[w] = len(ids) // 4
            size += more
    return LengthTable(kept)


class _Lengths(dict):
    """Tier two: a worker's own cache; a new word is asked of the broadcast table first, and encoded, many at a time, where that has it not.

    room bounds the words, a long one counting as several, so the cache is bounded in bytes too.
    """

    def __init__(self, enc, table: LengthTable, room: int):
        super().__init__()
        self.enc, self.table, self.room, self.used = enc, table, room, 0

    def fill(self, words: set[str]) -> None:
        fresh = [*words.difference(self.keys())]
        if self.used + weight(fresh) > self.room:
            self.clear()
            self.used, fresh = 0, [*words]
        self.used += weight(fresh)
        for k in range(0, len(fresh), 50_000):
            some = fresh[k : k + 50_000]
            known = self.table.find(some).tolist()
            self.update((w, n) for w, n in zip(some, known) if n >= 0)
            missing = [w for w, n in zip(some, known) if n < 0]
            self.update((w, len(ids) // 4) for w, ids in zip(missing, self.enc.encode_words(missing)))


_TABLES: dict[str, object] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, cache_words: int = 800_000, sample_docs: int = 4000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        enc = encoder(path, 1)
        if sent.value is not _TABLES.get("of"):
            _TABLES.clear()
            _TABLES.update(of=sent.value, lengths=_Lengths(enc, sent.value, cache_words))
        lengths = _TABLES["lengths"]
        get = lengths.__getitem__
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = [[*enc.segments(t)] for t in texts]
            wanted: set[str] = set()
            for one in cut:
                for words, _ in one:
                    wanted.update(words or ())
            lengths.fill(wanted)
            n = [sum(1 if words is None else sum(map(get, words)) for words, _ in one) for one in cut]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], schema=schema)

    return whole_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
