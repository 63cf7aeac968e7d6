"""Language-model scores from an Elias-Fano n-gram trie of order 3, sharded over the cluster.

Counting.  Texts become blocks: a block holds some documents' words as local numbers, its vocabulary as 64-bit hashes, and how often each word occurs
in its training documents.  Distinct words (then distinct word triples) of a block, with their counts, go to shards by the hash of the word (of the
triple's middle word v); a shard sums what all blocks sent.  The pairs (v, w) are summed from the triples (u, v, w) in the shard of v, so they are not sent.

Trie.  A shard reads contexts backwards: last words v (sorted hashes), under each the words u before it (and an empty one, for v alone), under each of these
contexts its successors w.  Its levels are byte strings in one memory map, opened without copying: hashes, pointers (monotone) and the marks of u and w
(32 bits, made monotone by the rank of their parent) in Elias-Fano form, the quantised logarithm of each successor's discounted probability and
that of each context's back-off weight.  A query finds v, then u between the two pointers of v, then w between those of (u, v), relative to their ranks.

    p(w | u v) = max(c(u, v, w) - D, 0) / c(u, v) + b(u, v) * p(w | v),   b(u, v) = D * successors(u, v) / c(u, v)
    p(w | v) = max(c(v, w) - D, 0) / c(v) + b(v) * p(w),   b(v) = D * successors(v) / c(v)
    p(w) = max(c(w) - D, 0) / N + D * V / N / (V + 1)      (an unknown word is one more word)

Scoring.  A shard answers every block's distinct triples as codes; answers return to their block, where documents are summed.
So a triple is sent once for each block and never for each document, the model is never whole in one place, and the driver holds only N, V and
the lists of hot words and hot pairs: those with more training tokens than a shard's `shard_entries` and a share of 1 / `hot_share` or more of all, which are
at most `hot_share` each.  The triples of a hot v are dealt by u, and its pairs are then sent as well and dealt by w; those of a hot pair (u, v) are
dealt by w.  A count decides how many shards they are dealt to; totals and successors of such contexts are added up from these.  Whether a pair is hot is
read from blocks where it has a fair share, which decides the dealing and no probability.

Every written table lies in the shared folder; a lost task is run again from there.

Defined results: a null or empty text is its end token alone; repeated ids and rows are scored a row each (and train as often); without
training documents N and V are 0 and the base score is 0 for every token; an empty table gives an empty table.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
import pyarrow as pa
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_texts, written
from .minhash import _HASHES, _mix

DISCOUNT = 0.75
END = np.uint64(0x656E64)  # stands for the end token, which is also the context of a text's first word
HELD_OUT_OF, HELD_OUT = 7, 2
ROW = "block long, kind int, shard int, data binary"


# ---------------------------------------------------------------------------- levels
class EliasFano:
    """A monotone sequence below `universe`: low bits packed, high bits in unary."""

    HEAD = struct.Struct("<QQQ")

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low = max(0, int(universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        lows = b"".join(((values >> np.uint64(8 * k)) & np.uint64((1 << min(8, low - 8 * k)) - 1)).astype(np.uint8).tobytes() for k in range(low // 8))
        rest = low % 8
        if rest:
            lanes = ((values >> np.uint64(low - rest)).astype(np.uint8)[:, None] >> np.arange(rest, dtype=np.uint8)) & 1
            lows += np.packbits(lanes.ravel(), bitorder="little").tobytes()
        upper = np.packbits(bits, bitorder="little").tobytes()
        return EliasFano.HEAD.pack(n, low, len(bits)) + lows + upper

    def __init__(self, data, at: int = 0):
        view = memoryview(data)
        self.n, self.low, n_bits = self.HEAD.unpack_from(view, at)
        at += self.HEAD.size
        self._lows = np.zeros(self.n, np.uint32 if self.low <= 32 else np.uint64)
        wide = self._lows.dtype.type
        for k in range(self.low // 8):
            self._lows |= np.frombuffer(view, np.uint8, self.n, at).astype(wide) << wide(8 * k)
            at += self.n
        rest = self.low % 8
        if rest:
            size = -(-self.n * rest // 8)
            lanes = np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=self.n * rest, bitorder="little").reshape(self.n, rest)
            self._lows |= (lanes @ (np.uint8(1) << np.arange(rest, dtype=np.uint8))).astype(wide) << wide(self.low - rest)
            at += size
        size = -(-n_bits // 8)
        self._ones = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=n_bits, bitorder="little")).astype(np.uint32 if n_bits < 1 << 32 else np.int64)
        self.end = at + size

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i)
        return ((self._ones[i].astype(np.int64) - i).astype(np.uint64) << np.uint64(self.low)) | self._lows[i]

    def successor(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least position in [begin, end) whose value is not below the wanted one; end where there is none."""
        lo, hi = begin.astype(np.int64), end.astype(np.int64)
        out, left = lo.copy(), np.flatnonzero(lo < hi)
        lo, hi, wanted = lo[left], hi[left], values[left]
        while len(left):
            mid = (lo + hi) >> 1
            below = self.get(mid) < wanted
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
            out[left] = lo
            going = lo < hi
            left, lo, hi, wanted = left[going], lo[going], hi[going], wanted[going]
        return out


def quantise(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes 1..255, least and greatest value); code 0 is left for what is not there. Values are rounded down, so no mass is added."""
    if not len(logs):
        return np.empty(0, np.uint8), np.zeros(2)
    ends = np.array([logs.min(), logs.max()])
    codes = np.clip(np.searchsorted(_book(ends)[1:], logs + 1e-12, side="right"), 1, 255)
    return codes.astype(np.uint8), ends


def _book(ends: np.ndarray) -> np.ndarray:
    """The 256 values of codes between two ends."""
    return np.concatenate([[0], np.linspace(*ends, 255)])


class Trie:
    """One shard. Levels lie one after the other in a memory map."""

    @staticmethod
    def encode(keys: np.ndarray, of_key: np.ndarray, befores: np.ndarray, of_node: np.ndarray, marks: np.ndarray, probs: np.ndarray, backs: np.ndarray) -> bytes:
        """keys: sorted hashes; of_key: n + 1 offsets to contexts; befores, backs: by context, sorted in a key; of_node: offsets to successors; marks, probs: by successor, sorted in a context."""
        low = lambda offsets, values: (np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets)) << np.uint64(32)) | values.astype(np.uint64)
        (prob, book), (back, back_book) = quantise(np.log10(probs)), quantise(np.log10(backs))
        levels = [
            EliasFano.encode(keys, 1 << 64),
            EliasFano.encode(of_key.astype(np.uint64), int(of_key[-1]) + 1),
            EliasFano.encode(low(of_key, befores), len(keys) << 32),
            EliasFano.encode(of_node.astype(np.uint64), int(of_node[-1]) + 1),
            EliasFano.encode(low(of_node, marks), len(befores) << 32),
            book.tobytes() + prob.tobytes(),
            back_book.tobytes() + back.tobytes(),
        ]
        return struct.pack("<7Q", *map(len, levels)) + b"".join(levels)

    def __init__(self, data: bytes):
        self.map = mmap.mmap(-1, max(1, len(data)))
        self.map.write(data)
        sizes = struct.unpack_from("<7Q", self.map)
        at = np.concatenate([[56], 56 + np.cumsum(sizes)]).tolist()
        self.keys, self.of_key, self.befores, self.of_node, self.successors = (EliasFano(self.map, a) for a in at[:5])
        self.book, self.prob = np.frombuffer(self.map, np.float64, 2, at[5]), np.frombuffer(self.map, np.uint8, sizes[5] - 16, at[5] + 16)
        self.back_book, self.back = np.frombuffer(self.map, np.float64, 2, at[6]), np.frombuffer(self.map, np.uint8, sizes[6] - 16, at[6] + 16)

    def key(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each last word, -1 where unknown."""
        n = self.keys.n
        at = self.keys.successor(hashes, np.zeros(len(hashes), np.int64), np.full(len(hashes), n))
        known = at < n
        known[known] = self.keys.get(at[known]) == hashes[known]
        return np.where(known, at, -1)

    @staticmethod
    def _child(pointers: EliasFano, level: EliasFano, rank: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Position in `level` of the child with that mark under each parent; -1 where parent or child is unknown."""
        out = np.full(len(rank), -1, np.int64)
        ok = np.flatnonzero(rank >= 0)
        parent = rank[ok]
        end = pointers.get(parent + 1).astype(np.int64)
        wanted = (parent.astype(np.uint64) << np.uint64(32)) | marks[ok].astype(np.uint64)
        at = level.successor(wanted, pointers.get(parent).astype(np.int64), end)
        hit = at < end
        hit[hit] = level.get(at[hit]) == wanted[hit]
        out[ok[hit]] = at[hit]
        return out

    def context(self, key_rank: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self._child(self.of_key, self.befores, key_rank, before)

    def prob_codes(self, context: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Code of each (context, successor mark); 0 where it is unknown."""
        at = self._child(self.of_node, self.successors, context, marks)
        return np.where(at >= 0, self.prob[np.maximum(at, 0)], 0).astype(np.uint8)

    def back_codes(self, context: np.ndarray) -> np.ndarray:
        return np.where(context >= 0, self.back[np.maximum(context, 0)], 0).astype(np.uint8)


# ---------------------------------------------------------------------------- blobs
def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed byte string; integers lie by byte planes, which compress well."""
    parts, head = [], struct.pack("<I", len(arrays))
    for a in arrays:
        code, size = a.dtype.str.encode(), a.dtype.itemsize
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, size).T.tobytes() if size > 1 and a.dtype.kind in "iu" else a.tobytes()
        head += struct.pack("<4sQ", code, len(a))
        parts.append(planes)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _arrays(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (k,) = struct.unpack_from("<I", data)
    at, out = 4 + 12 * k, []
    for i in range(k):
        code, n = struct.unpack_from("<4sQ", data, 4 + 12 * i)
        dtype = np.dtype(code.rstrip(b"\0").decode())
        raw = np.frombuffer(data, np.uint8, n * dtype.itemsize, at)
        at += len(raw)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel() if dtype.itemsize > 1 and dtype.kind in "iu" else raw.view(dtype))
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of an ascending array of unsigned integers: small numbers, which compress better."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    block, kind, shard, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "shard", "data"])


# ---------------------------------------------------------------------------- blocks
class _Local(dict):
    """word -> its number in the block, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out_id(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """block, kind 0, shard 0, data: documents (id, missing id, held out, length), tokens, vocabulary and its training counts; n_tokens, n_words, trained."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        local, ids, tokens, size = _Local({b"": 0}), [], [], 0
        get = local.__getitem__

        def flush():
            nonlocal local, ids, tokens, size, made, get
            flat = np.concatenate(tokens)
            lengths = np.array([*map(len, tokens)])
            held = np.array([held_out_id(d) for d in ids])
            trained = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(local)).astype(np.uint32)
            vocab = np.fromiter(map(_HASHES.__getitem__, local), np.uint64, len(local))
            vocab[0] = END
            order = np.argsort(vocab)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            flat, vocab, trained = back[flat].astype(np.uint32), vocab[order], trained[order]
            docs_of = (np.array([0 if d is None else d for d in ids], np.int64), np.array([d is None for d in ids]), held, lengths.astype(np.int64))
            row = (part << 24 | made, _blob(*docs_of, flat), _blob(_steps(vocab), trained), len(flat), len(vocab), int(trained.sum()))
            made += 1
            local, ids, tokens, size = _Local({b"": 0}), [], [], 0
            get = local.__getitem__
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["block", "docs", "vocab", "n_tokens", "n_words", "trained"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(b"")  # the end token has number 0
                tokens.append(np.fromiter(map(get, words), np.int64, len(words)))
                ids.append(doc)
                size += len(words)
                if size >= block_tokens:
                    yield flush()
        if ids:
            yield flush()
        _HASHES.clear()  # the worker goes on to other stages

    return whole_texts(docs).mapInArrow(run, "block long, docs binary, vocab binary, n_tokens long, n_words long, trained long")


def _by_shard(batches, handle, emit: int = 64):
    """Rows come sorted by shard: calls handle(shard, [(block, arrays)]) once a shard and passes its rows on."""
    shard, held, out = None, [], []
    for b in batches:
        for block, s, data in zip(b.column("block").to_pylist(), b.column("shard").to_pylist(), b.column("data").to_pylist()):
            if s != shard:
                if held:
                    out += handle(shard, held)
                shard, held = s, []
            held.append((block, _arrays(data)))
        while len(out) > emit:
            yield _rows(out[:emit])
            out = out[emit:]
    if held:
        out += handle(shard, held)
    for k in range(0, len(out), emit):
        yield _rows(out[k : k + emit])


# ---------------------------------------------------------------------------- words
def _word_routes(bits: int):
    def run(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                vocab, trained = _arrays(data)
                vocab = _sums(vocab)
                cut = np.searchsorted(vocab, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
                cut = [*cut.tolist(), len(vocab)]
                rows = [(block, 1, s, _blob(_steps(vocab[i:j]), trained[i:j])) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                for k in range(0, len(rows), 256):
                    yield _rows(rows[k : k + 256])

    return run


def _word_shards(hot_least: int):
    """Kind 1: counts of a block's words; kind 2 (block -1): N, V; kind 3 (block -1): hot words and their counts."""

    def handle(shard, held):
        held = [(block, (_sums(a[0]), a[1])) for block, a in held]
        words = np.concatenate([a[0] for _, a in held])
        counts = np.concatenate([a[1] for _, a in held])
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[order], prepend=words[order[0]] ^ np.uint64(1)))
        names, total = words[order[first]], np.add.reduceat(counts[order].astype(np.int64), first)
        rows = [(block, 1, shard, _blob(total[np.searchsorted(names, a[0])])) for block, a in held]
        hot = total >= max(1, hot_least)
        return [*rows, (-1, 2, shard, _blob(np.array([total.sum(), (total > 0).sum()]))), (-1, 3, shard, _blob(names[hot], total[hot]))]

    return lambda batches: _by_shard(batches, handle)


# ---------------------------------------------------------------------------- triples
ASKED = 200_000  # entries looked up together in a shard
SALT = np.uint64(0x9E3779B97F4A7C15)
ALONE = np.uint32(0)  # stands for no word before v
DERIVE, WHOLE = -1, -2  # contexts (u, v) whose pairs (v, w) are summed in the shard, and those of a hot v, whose pairs are sent


def _pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(_mix(u) + v * SALT)


def _ngrams(flat: np.ndarray, lengths: np.ndarray, end: int, n_words: int):
    """A block's distinct pairs (first * n_words + second), its tokens' contexts and pairs as positions there, distinct triples (context * n_words + word), and each token's triple."""
    both = np.empty(len(flat) + 1, np.int64)
    both[0], both[1:-1], both[-1] = end, flat[:-1], end
    both *= n_words
    both[:-1] += flat
    both[-1] += end
    pairs, at = np.unique(both, return_inverse=True)  # the last is (end, end), the context of a first word
    del both
    at = at.astype(np.uint32)  # a block has fewer tokens
    pair = at[:-1]
    context = np.empty_like(pair)
    context[1:] = pair[:-1]
    context[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = at[-1]
    context = context.astype(np.int64)
    context *= n_words
    context += flat
    triples, of = np.unique(context, return_inverse=True)
    return pairs, pair, triples, of.astype(np.uint32)


class Hot:
    """Hot words and hot pairs: sorted hashes, counts, and to how many shards each is dealt."""

    def __init__(self, words, word_counts, pairs, pair_counts, shard_entries: int):
        self.words, self.pairs = words, pairs
        self.counts = np.concatenate([word_counts, pair_counts]).astype(np.int64)
        self.fan = (-(-self.counts // shard_entries)).astype(np.uint32)

    def __len__(self):
        return len(self.counts)

    @staticmethod
    def _place(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return self._place(self.words, hashes)

    def pair(self, hashes: np.ndarray) -> np.ndarray:
        at = self._place(self.pairs, hashes)
        return np.where(at >= 0, at + len(self.words), -1)


class Entries:
    """A block's triples, and the pairs of its hot words, in the order in which they are sent: by key, word before and successor."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray, vocab: np.ndarray, hot: Hot, bits: int):
        n = len(vocab)
        mark = np.maximum((_mix(vocab) >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        hot_word = hot.word(vocab).astype(np.int32)
        first, second = (x.astype(np.uint32) for x in np.divmod(pairs, n))
        context, w = (x.astype(np.uint32) for x in np.divmod(triples, n))
        v = second[context]
        key, before, of_v = vocab[v], mark[first[context]], hot_word[v]
        del v
        which = np.where(of_v >= 0, np.int32(WHOLE), np.int32(DERIVE))
        self.hot_pairs = np.flatnonzero(hot_word[first] >= 0) if len(hot) else np.empty(0, np.int64)  # positions in `pairs`
        if len(hot):
            dealt = lambda base, by, at: _mix(base + (by % hot.fan[at]).astype(np.uint64) * SALT)
            some = np.flatnonzero(of_v >= 0)
            key[some] = dealt(key[some], before[some], of_v[some])
            names = _pair_hash(vocab[first], vocab[second])
            of_pair = hot.pair(names)[context]
            some = np.flatnonzero(of_pair >= 0)
            key[some], which[some] = dealt(names[context[some]], mark[w[some]], of_pair[some]), of_pair[some]
            v2, w2 = first[self.hot_pairs], second[self.hot_pairs]
            key = np.concatenate([key, dealt(~vocab[v2], mark[w2], hot_word[v2])])
            before, w, which = np.append(before, np.full(len(v2), ALONE)), np.append(w, w2), np.append(which, hot_word[v2].astype(np.int32))
        inner = (before.astype(np.uint64) << np.uint64(32)) | mark[w].astype(np.uint64)
        self.order = np.lexsort((inner, key))
        self.key, inner, self.which = key[self.order], inner[self.order], which[self.order]
        self.before, self.mark = (inner >> np.uint64(32)).astype(np.uint32), inner.astype(np.uint32)
        new_key = np.diff(self.key, prepend=~self.key[:1]) != 0
        new = new_key | (np.diff(self.before, prepend=self.before[:1]) != 0)
        self.key_at, self.node_at = np.flatnonzero(new_key), np.flatnonzero(new)
        cut = np.searchsorted(self.key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
        self.cut = [*cut.tolist(), len(self.key)]


def _hot_pairs(hot: Hot, hot_least: int, trained: int):
    """pair, n: pairs of hot words that have at least a fourth of a hot pair's share in a block."""

    def run(batches):
        for b in batches:
            for docs, words in zip(*(c.to_pylist() for c in b.columns)):
                (_, _, held, lengths, flat), (vocab, _) = _arrays(docs), _arrays(words)
                vocab = _sums(vocab)
                is_hot, end = hot.word(vocab) >= 0, int(np.searchsorted(vocab, END))
                flat, train = flat.astype(np.int64), np.repeat(~held.astype(bool), lengths)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                before = np.append(end, flat[:-1])
                ok = train & is_hot[flat] & is_hot[before]
                names, n = np.unique(before[ok] * len(vocab) + flat[ok], return_counts=True)
                begun = int(train[starts].sum())
                names, n = np.append(names, end * len(vocab) + end), np.append(n, begun)  # (end, end) begins every document
                some = n >= max(1, hot_least * int(train.sum()) / max(1, trained) / 4)
                names = _pair_hash(vocab[names[some] // len(vocab)], vocab[names[some] % len(vocab)])
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n[some].astype(np.int64))], names=["pair", "n"])

    return run


def _triple_routes(bits: int, hot: Hot):
    def run(batches):
        for b in batches:
            for block, docs, words in zip(*(c.to_pylist() for c in b.columns)):
                (_, _, held, lengths, flat), (vocab, _) = _arrays(docs), _arrays(words)
                vocab = _sums(vocab)
                pairs, pair, triples, of = _ngrams(flat.astype(np.int64), lengths, int(np.searchsorted(vocab, END)), len(vocab))
                train = np.repeat(~held.astype(bool), lengths)
                e = Entries(pairs, triples, vocab, hot, bits)
                trained = np.bincount(of[train], minlength=len(triples))
                if len(e.hot_pairs):
                    trained = np.append(trained, np.bincount(pair[train], minlength=len(pairs))[e.hot_pairs])
                trained = trained[e.order].astype(np.uint32)
                rows = []
                for s, (i, j) in enumerate(zip(e.cut, e.cut[1:])):
                    if j > i:
                        nodes = e.node_at[slice(*np.searchsorted(e.node_at, (i, j)))]
                        keys = e.key_at[slice(*np.searchsorted(e.key_at, (i, j)))]
                        names, at = np.unique(np.concatenate([e.before[nodes], e.mark[i:j]]), return_inverse=True)
                        at = at.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
                        sizes = np.diff(nodes, append=j).astype(np.uint32), np.diff(np.searchsorted(nodes, keys), append=len(nodes)).astype(np.uint32)
                        rows.append((block, 4, s, _blob(_steps(e.key[keys]), sizes[1], e.which[nodes], sizes[0], _steps(names), at, trained[i:j])))
                for k in range(0, len(rows), 64):
                    yield _rows(rows[k : k + 64])

    return run


def _summed(keys: np.ndarray, inner: np.ndarray, which: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Distinct (key, inner) in ascending order, with the sum of their counts."""
    order = np.lexsort((inner, keys))
    keys, inner = keys[order], inner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (inner[1:] != inner[:-1])
    at = np.flatnonzero(new)
    return [keys[at], inner[at], which[order[at]], np.add.reduceat(counts[order], at, dtype=np.int64)]


def _triple_shards(hot: Hot, discount: float):
    """Kind 4: codes of a block's triples (and of their pairs) and contexts; kind 5 (block -1): counts and successors of hot contexts."""

    def trie_of(asked):
        parts = [[], [], [], []]
        for a in asked:
            seen = np.flatnonzero(a[6])
            node, (before, mark) = np.repeat(np.arange(len(a[3]), dtype=np.uint32), a[3])[seen], _marks(a)
            for to, x in zip(parts, (np.repeat(_sums(a[0]), a[1])[node], (before[node].astype(np.uint64) << np.uint64(32)) | mark[seen], a[2][node], a[6][seen])):
                to.append(x)
        entries = [np.concatenate(x) for x in parts]
        del parts
        if not len(entries[0]):
            return None, []
        triples = _summed(*entries)
        del entries
        pair = np.flatnonzero(triples[2] == DERIVE)
        if len(pair):
            pairs = _summed(triples[0][pair], triples[1][pair] & np.uint64(0xFFFFFFFF), triples[2][pair], triples[3][pair])
            triples = [np.concatenate(x) for x in zip(pairs, triples)]  # both ascend, and pairs come first under a key
            order = np.argsort(triples[0], kind="stable")
            triples = [x[order] for x in triples]
            del pairs, order
        keys, inner, which, counts = triples
        before = (inner >> np.uint64(32)).astype(np.uint32)
        new_key = np.ones(len(keys), bool)
        new_key[1:] = keys[1:] != keys[:-1]
        new = new_key.copy()
        new[1:] |= before[1:] != before[:-1]
        node, key = np.flatnonzero(new), np.flatnonzero(new_key)
        of_node = np.append(node, len(keys))
        total, successors = np.add.reduceat(counts, node), np.diff(of_node)
        is_hot = np.flatnonzero(which[node] >= 0)
        known = which[node[is_hot]].astype(np.int64), successors[is_hot].astype(np.int64), total[is_hot].copy()
        total[is_hot] = hot.counts[known[0]]
        probs = (counts - discount) / np.repeat(total, successors)
        of_key = np.append(np.searchsorted(node, key), len(node))
        return Trie(Trie.encode(keys[key], of_key, before[node], of_node, inner.astype(np.uint32), probs, np.minimum(1, discount * successors / total))), [known]

    def answers(shard, trie, some):
        """Rows of codes for some blocks, which are looked up together."""
        of_keys, nodes_in, which, size = (np.concatenate(x) for x in zip(*((_sums(a[0]), *a[1:4]) for _, a in some)))
        before, mark = (np.concatenate(x) for x in zip(*(_marks(a) for _, a in some)))
        keys, nodes, entries = (np.cumsum([len(a[k]) for _, a in some])[:-1] for k in (0, 3, 6))
        if trie is None:
            found, books = [np.zeros(len(x), np.uint8) for x in (mark, mark, before, of_keys)], [np.zeros(2), np.zeros(2)]
        else:
            rank = trie.key(of_keys)
            context, alone = trie.context(np.repeat(rank, nodes_in), before), trie.context(rank, np.full(len(rank), ALONE))
            lone = np.where(which == DERIVE, np.repeat(alone, nodes_in), -1)
            found = trie.prob_codes(np.repeat(context, size), mark), trie.prob_codes(np.repeat(lone, size), mark), trie.back_codes(context), trie.back_codes(alone)
            books = [trie.book, trie.back_book]
        cut = zip(*(np.split(x, at) for x, at in zip(found, (entries, entries, nodes, keys))))
        return [(block, 4, shard, _blob(*codes, *books)) for (block, _), codes in zip(some, cut)]

    def handle(shard, held):
        trie, known = trie_of([a for _, a in held])
        rows = [(-1, 5, shard, _blob(*k)) for k in known]
        some, n = [], 0
        for block, a in held:
            some.append((block, a))
            n += len(a[6])
            if n >= ASKED:
                rows += answers(shard, trie, some)
                some, n = [], 0
        return rows + (answers(shard, trie, some) if some else [])

    return lambda batches: _by_shard(batches, handle)


def _marks(a: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the words before (by context) and of the successors of a request."""
    names, at = _sums(a[4]), a[5]
    return names[at[: len(a[3])]], names[at[len(a[3]) :]]


# ---------------------------------------------------------------------------- scores
def _block_scores(total: int, types: int, hot: Hot, hot_counts: np.ndarray, hot_back: np.ndarray, bits: int, discount: float):
    """Blocks (kind 0) with their answers (kinds 1 and 4, in order of shard) to scores of documents."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    exact = hot.counts / np.maximum(1, hot_counts)  # hot contexts were divided by the counts that dealt them

    def answers(rows, e: Entries):
        """By entry: probabilities of triples and of their pairs, back-off weights of the contexts (u, v) and v."""
        parts = [_arrays(r[2]) for r in rows if r[0] == 4]
        value = lambda codes, book, none: np.where(codes > 0, (10.0 ** _book(book))[codes], none)
        get = lambda k, book, none: np.concatenate([value(a[k], a[book], none) for a in parts])
        node = np.diff(e.node_at, append=len(e.key))
        key = np.diff(e.key_at, append=len(e.key))
        strong, pair, back, back_pair = get(0, 4, 0.0), get(1, 4, 0.0), np.repeat(get(2, 5, 1.0), node), np.repeat(get(3, 5, 1.0), key)
        is_hot = np.flatnonzero(e.which >= 0)
        strong[is_hot] *= exact[e.which[is_hot]]
        back[is_hot] = hot_back[e.which[is_hot]]
        out = [np.empty(len(e.order)) for _ in range(4)]
        for to, x in zip(out, (strong, pair, back, back_pair)):
            to[e.order] = x
        return out

    def finish(rows):
        own = next(r for r in rows if r[0] == 0)
        doc, missing, held, lengths, flat, vocab = _arrays(own[2])
        vocab = _sums(vocab)
        flat = flat.astype(np.int64)
        count = np.concatenate([_arrays(r[2])[0] for r in rows if r[0] == 1])  # in order of the vocabulary
        base = np.log10((count + 1) / (total + types + 1))
        alone = (np.maximum(count - discount, 0) + discount * types / (types + 1)) / total if total else np.full(len(count), 1.0)
        pairs, pair, triples, of = _ngrams(flat, lengths, int(np.searchsorted(vocab, END)), len(vocab))
        e, n = Entries(pairs, triples, vocab, hot, bits), len(triples)
        strong, strong_pair, back, back_pair = answers(rows, e)
        shorter = strong_pair[:n] + back_pair[:n] * alone[triples % len(vocab)]
        if len(e.hot_pairs):
            of_hot = np.full(len(pairs), np.nan)
            of_hot[e.hot_pairs] = strong[n:] + back[n:] * alone[pairs[e.hot_pairs] % len(vocab)]
            pair_of = np.empty(n, np.int64)
            pair_of[of] = pair
            shorter = np.where(np.isnan(of_hot[pair_of]), shorter, of_hot[pair_of])
        p = strong[:n] + back[:n] * shorter
        logs = np.log10(p)[of] if total else np.zeros(len(flat))
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sums = lambda x: np.add.reduceat(x, begin)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc, mask=missing.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(sums((count > 0)[flat].astype(np.int64))),
                pa.array(np.full(len(doc), total, np.int64)), pa.array(sums(base[flat])), pa.array(sums(logs)),
            ],
            names=names,
        )

    def run(batches):
        block, rows = None, []
        for b in batches:
            for k, kind, shard, data in zip(*(c.to_pylist() for c in b.columns)):
                if k != block:
                    if rows:
                        yield finish(rows)
                    block, rows = k, []
                rows.append((kind, shard, data))
        if rows:
            yield finish(rows)

    return run


def score(docs: DataFrame, block_tokens: int = 500_000, shard_entries: int = 2_000_000, hot_share: int = 65_536, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    block_tokens bounds a block (and a worker's memory), shard_entries the mean number of entries in a shard.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    cut = written(blocks(docs, block_tokens), "lm-blocks")
    tokens, words, trained, n_blocks = (n or 0 for n in cut.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("trained"), F.count("*")).first())
    bits = max(2 * parts, words // shard_entries).bit_length()
    # four shards a task, or fewer: tasks grow in number with the data, and shards are dealt evenly
    routed = lambda rows, bits: rows.repartitionById(max(parts, (1 << bits) // 4), F.col("shard")).sortWithinPartitions("shard", "block")
    hot_least = max(shard_entries, -(-trained // hot_share))

    asked = routed(cut.select("block", "vocab").mapInArrow(_word_routes(bits), ROW), bits)
    answered = written(asked.mapInArrow(_word_shards(hot_least), ROW), "lm-words")
    total = types = 0
    names, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for r in answered.filter("kind in (2, 3)").collect():  # two short rows a shard; hot_share words in all
        a = _arrays(r.data)
        if r.kind == 2:
            total, types = total + int(a[0][0]), types + int(a[0][1])
        else:
            names.append(a[0]), counts.append(a[1])
    names, counts = np.concatenate(names), np.concatenate(counts)
    order, none = np.argsort(names), (np.empty(0, np.uint64), np.empty(0, np.int64))
    hot = Hot(names[order], counts[order], *none, shard_entries)
    if len(hot):
        found = cut.select("docs", "vocab").mapInArrow(_hot_pairs(hot, hot_least, trained), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot_least).toArrow()  # hot_share rows at most
        names, counts_of = found.column("pair").to_numpy().view(np.uint64), found.column("n").to_numpy()
        by = np.argsort(names)
        hot = Hot(hot.words, counts[order], names[by], counts_of[by], shard_entries)

    triple_bits = max(2 * parts, tokens // shard_entries).bit_length()
    asked = routed(cut.select("block", "docs", "vocab").mapInArrow(_triple_routes(triple_bits, hot), ROW), triple_bits)
    found = written(asked.mapInArrow(_triple_shards(hot, discount), ROW), "lm-triples")
    successors, hot_counts = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)

    def added(batches):
        out = np.zeros((2, len(hot)), np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                which, *sums = _arrays(data)
                for to, x in zip(out, sums):
                    np.add.at(to, which, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hot)), pa.int32()), pa.array(out[0]), pa.array(out[1])], names=["which", "n", "c"])

    if len(hot):
        for r in found.filter("kind = 5").select("data").mapInArrow(added, "which int, n long, c long").groupBy("which").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect():  # 2 * hot_share rows at most
            successors[r.which], hot_counts[r.which] = r.n, r.c
    hot_back = np.minimum(1, discount * successors / np.maximum(1, hot_counts))

    def whole(batches):
        for b in batches:
            yield _rows([(k, 0, 0, _blob(*_arrays(d), _arrays(v)[0])) for k, d, v in zip(*(c.to_pylist() for c in b.columns))])

    own = cut.select("block", "docs", "vocab").mapInArrow(whole, ROW)
    rows = own.unionByName(answered.filter("kind = 1")).unionByName(found.filter("kind = 4"))
    together = rows.repartition(max(parts, n_blocks // 2), "block").sortWithinPartitions("block", "kind", "shard")
    return together.mapInArrow(_block_scores(total, types, hot, hot_counts, hot_back, triple_bits, discount), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
