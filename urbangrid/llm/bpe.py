"""Byte-level BPE on whole texts by speculate and verify.

A text is cut into pre-tokens (words); every distinct word is encoded once per worker and remembered in a
bounded cache.  New words are encoded in bulk:

1. greedy longest match proposes tokens for each word (speculation);
2. all adjacent token pairs of all proposals are tested together with NumPy: a pair is compatible when no
   merge across its boundary would have fired before the two tokens were complete (verification);
3. only words with an incompatible pair go through exact merging by rank.

A sequence of valid tokens whose adjacent pairs are all compatible is the BPE encoding, so the result is exact.

Two vocabularies are understood: byte-level with the usual contraction/letter/number/other split, and the lower-cased
one with an end-of-word suffix.  Their files are a parameter (a path); nothing is trained or copied.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import threading

import numpy as np

# Code points below U+0250 that are numbers but no decimal digits.
_OTHER_NUMBERS = "²³¹¼½¾"
_LETTER = rf"[^\W\d_{_OTHER_NUMBERS}]"
_NUMBER = rf"[\d{_OTHER_NUMBERS}]"
_OTHER = rf"(?:[^\w\s]|_)"
_CONTRACTION = r"'s|'t|'re|'ve|'m|'ll|'d"
# Texts of these characters only are split by `re`; other texts by the tokenizer library's own splitter.
_PLAIN = re.compile(r"[\t\n\r -~¡-įı-ɏ–—‘-„…€]*")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NO_PARENT = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BpeEncoder:
    """Exact encoder and decoder for one vocabulary file (`tokenizers` JSON, model BPE).

    cache_words bounds the word cache of this worker; when it is full it is emptied and refilled.
    speculate=False sends every new word to exact merging at once (same ids).
    """

    def __init__(self, path: str, cache_words: int = 400_000, speculate: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.speculate = path, speculate
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = spec.get("normalizer") is not None
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self._alphabet = byte_alphabet()
        self._latin = {b: c for b, c in enumerate(self._alphabet)}
        # contractions start with an apostrophe, so they may stand after the letters and numbers
        kinds = (rf"{_LETTER}+", rf"{_NUMBER}", _CONTRACTION, rf"{_OTHER}+") if self.lower else (rf" ?{_LETTER}+", rf" ?{_NUMBER}+", _CONTRACTION, rf" ?{_OTHER}+", r"\s+(?!\S)", r"\s+")
        self._spaced = re.compile("|".join(kinds))
        self._spaced_ascii = re.compile("|".join(kinds).replace(_LETTER, "[A-Za-z]").replace(_NUMBER, "[0-9]").replace(_OTHER, r"[^A-Za-z0-9\s]"), re.ASCII)
        self._library = None
        self._build_merge_tables()
        self.cache_words = cache_words
        self.cache = _WordCache(self)
        self.verified_words = self.merged_words = 0

    # ------------------------------------------------------------------ merge tables
    def _build_merge_tables(self) -> None:
        n = max(self.vocab.values()) + 1
        left, right = np.full(n, -1), np.full(n, -1)
        birth = np.full(n, -1)  # rank of the merge that makes the token; -1 for single characters
        keys, rank_of = [], []
        for (a, b), rank in self.ranks.items():
            t = self.vocab.get(a + b)
            ia, ib = self.vocab[a], self.vocab[b]
            keys.append(ia * n + ib)
            rank_of.append(rank)
            if t is not None and left[t] < 0:
                left[t], right[t], birth[t] = ia, ib, rank
        order = np.argsort(np.array(keys, dtype=np.int64))
        self._pair_keys, self._pair_ranks = np.array(keys, dtype=np.int64)[order], np.array(rank_of, dtype=np.int64)[order]
        self._left, self._right, self._birth, self._n = left, right, birth, n
        self._merged = np.fromiter((self.vocab[a + b] for a, b in self.ranks), np.int64, len(self.ranks))
        self._byte_id = np.array([self.vocab[c] for c in self._alphabet])
        self._end_id = np.full(n, -1)
        if self.suffix:
            self._end_id[self._byte_id] = [self.vocab[c + self.suffix] for c in self._alphabet]
        made = np.flatnonzero(left >= 0)
        sound = self._compatible(left[made], right[made], inner=True)
        reachable = np.ones(n, dtype=bool)
        for t, ok in sorted(zip(made.tolist(), sound.tolist()), key=lambda x: birth[x[0]]):
            reachable[t] = ok and reachable[left[t]] and reachable[right[t]]
        self._tokens = {s: i for s, i in self.vocab.items() if (reachable[i] and left[i] >= 0) or len(s.removesuffix(self.suffix) or s) == 1}
        self._longest = max(map(len, self._tokens))
        self._pairs_seen, self._pairs_ok = np.empty(0, np.int64), np.empty(0, bool)
        size = max(n, max(self.special.values(), default=0) + 1)
        self.token_bytes = [b""] * size
        of_char = {c: b for b, c in enumerate(self._alphabet)}
        for s, i in self.vocab.items():
            word = s[: -len(self.suffix)] if self.suffix and s.endswith(self.suffix) else s
            self.token_bytes[i] = bytes(of_char[c] for c in word) + (b" " if word != s else b"")
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._n + b
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == key, self._pair_ranks[at], _NO_PARENT)

    def _compatible(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """True where BPE leaves the adjacent tokens a, b as they are.

        Walks the right edge of a's merge tree and the left edge of b's: a merge of two pieces that meet at the boundary
        fires if it ranks before the merge that swallows the left piece, and not after the one that swallows the right piece
        (equal ranks fire from the left).  inner: the pair's own merge is wanted and no fault.
        """
        ok = np.ones(len(a), dtype=bool)
        x, x_end = a.copy(), np.full(len(a), _NO_PARENT)
        first = True
        live = np.arange(len(a))
        while len(live):
            y, y_end, here = b[live].copy(), np.full(len(live), _NO_PARENT), np.arange(len(live))
            outer = True
            while len(here):
                at = live[here]
                m = self._rank(x[at], y[here])
                bad = (m < x_end[at]) & (m <= y_end[here]) & (m < _NO_PARENT)
                if not (inner and first and outer):
                    ok[at[bad]] = False
                outer = False
                down = self._left[y[here]] >= 0
                y_end[here], y[here] = self._birth[y[here]], self._left[y[here]]
                here = here[down & ok[at]]
            first = False
            down = (self._right[x[live]] >= 0) & ok[live]
            x_end[live], x[live] = self._birth[x[live]], self._right[x[live]]
            live = live[down]
        return ok

    def _pairs_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, back = np.unique(a * self._n + b, return_inverse=True)
        if len(self._pairs_seen):
            at = np.minimum(np.searchsorted(self._pairs_seen, keys), len(self._pairs_seen) - 1)
            known = self._pairs_seen[at] == keys
        else:
            at, known = np.zeros(len(keys), int), np.zeros(len(keys), bool)
        ok = np.empty(len(keys), bool)
        ok[known] = self._pairs_ok[at[known]] if known.any() else False
        fresh = keys[~known]
        ok[~known] = self._compatible(fresh // self._n, fresh % self._n)
        if len(self._pairs_seen) + len(fresh) > 1_000_000:
            self._pairs_seen, self._pairs_ok = keys, ok
        elif len(fresh):
            seen = np.concatenate([self._pairs_seen, fresh])
            order = np.argsort(seen, kind="stable")
            self._pairs_seen, self._pairs_ok = seen[order], np.concatenate([self._pairs_ok, ok[~known]])[order]
        return ok[back]

    # ------------------------------------------------------------------ words
    def _symbols(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._latin)

    def _propose(self, symbols: str) -> list[int]:
        out, i, n, tokens, suffix = [], 0, len(symbols), self._tokens, self.suffix
        while i < n:
            if suffix and (t := tokens.get(symbols[i:] + suffix)) is not None:
                out.append(t)
                return out
            for j in range(min(n - bool(suffix), i + self._longest), i, -1):
                if (t := tokens.get(symbols[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no token for {symbols[i]!r}")
        return out

    def merge_exactly(self, word: str) -> list[int]:
        """Reference procedure: merge the pair of lowest rank, leftmost first, until none is left."""
        symbols = self._symbols(word)
        parts = [*symbols[:-1], symbols[-1] + self.suffix] if symbols else []
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), _NO_PARENT))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.vocab[p] for p in parts]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed token ids of each word; proposals of all words are verified in one vectorised pass."""
        packed = [b""] * len(words)
        if not self.speculate:
            self._merge_all(words, np.arange(len(words)), packed)
            return packed
        out = [*map(self._propose, map(self._symbols, words))]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(itertools.chain.from_iterable(out), np.int64, int(sizes.sum()))
        whole, at = flat.astype("<u4").tobytes(), 0
        for i, m in enumerate(sizes.tolist()):
            packed[i] = whole[at : (at := at + 4 * m)]
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(out)), sizes)
            same = owner[1:] == owner[:-1]
            a, b = flat[:-1][same], flat[1:][same]
            failing = np.unique(owner[1:][same][~self._pairs_compatible(a, b)]) if len(a) else np.empty(0, np.int64)
            self._merge_all(words, failing, packed)
            self.merged_words += len(failing)
        self.verified_words += len(words)
        return packed

    def _merge_all(self, words: list[str], chosen: np.ndarray, out: list[bytes]) -> None:
        """Exact merging of the chosen words, words of like length side by side: one step merges, in every word, its lowest-ranked pair."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))[chosen]
        for lo, hi in ((0, 4), (4, 7), (7, 10), (10, 14), (14, 20), (20, 32), (32, 64)):
            some = chosen[(lengths > lo) & (lengths <= hi)]
            for k in range(0, len(some), 10_000):
                block = some[k : k + 10_000].tolist()
                for i, ids in zip(block, self._merge_block([raw[i] for i in block])):
                    out[i] = ids
        for i in chosen[lengths > 64].tolist():
            out[i] = np.array(self._merge_long(self._symbols(words[i])), dtype="<u4").tobytes()

    def _merge_block(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of words, given as their bytes."""
        w, size = len(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        ids = np.full((w, int(size.max()) + 1), -1, dtype=np.int64)
        inside = np.arange(ids.shape[1]) < size[:, None]
        ids[inside] = self._byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        if self.suffix:
            end = np.arange(w), size - 1
            ids[end] = self._end_id[ids[end]]
        rank = np.full(ids.shape, _NO_PARENT, dtype=np.int64)
        at = inside[:, 1:]
        rank[:, :-1][at] = self._rank(ids[:, :-1][at], ids[:, 1:][at])
        rows, done = np.arange(w), [b""] * w
        while len(rows):
            n = np.arange(len(rows))
            best = rank.argmin(axis=1)
            low = rank[n, best]
            ended = low == _NO_PARENT
            if ended.any():
                packed, line = ids[ended].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (r, m) in enumerate(zip(rows[ended].tolist(), size[ended].tolist())):
                    done[r] = packed[k * line : k * line + 4 * m]
                keep = ~ended
                rows, ids, rank, size, best, low, n = rows[keep], ids[keep], rank[keep], size[keep], best[keep], low[keep], n[: int(keep.sum())]
                if not len(rows):
                    break
            ids[n, best] = self._merged[low]
            after = np.arange(ids.shape[1] - 1)[None, :] > best[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            rank = np.where(after, rank[:, 1:], rank[:, :-1])
            size = size - 1
            # the two pairs that the merged token is part of get new ranks
            right = best + 1 < size
            rank[n, np.minimum(best, rank.shape[1] - 1)] = _NO_PARENT
            x, y = n[right], best[right]
            rank[x, y] = self._rank(ids[x, y], ids[x, y + 1])
            left = best > 0
            x, y = n[left], best[left]
            rank[x, y - 1] = self._rank(ids[x, y - 1], ids[x, y])
        return done

    def _merge_long(self, s: str) -> list[int]:
        """Exact merging with a heap and links, for words that are too long for the block form."""
        part = [*s[:-1], s[-1] + self.suffix]
        n = len(part)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j < 0 or part[j] != y:
                continue
            part[i], part[j] = x + y, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := self.ranks.get((part[p], part[q]))) is not None:
                    heapq.heappush(heap, (r, p, part[p], part[q]))
        return [self.vocab[p] for p in part if p is not None]

    # ------------------------------------------------------------------ texts
    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii() and not _SEPARATORS.search(text):
            return self._spaced_ascii.findall(text.lower() if self.lower else text)
        if _PLAIN.fullmatch(text):
            return self._spaced.findall(text.lower() if self.lower else text)
        return self._library_words(text)

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._of_char = {ord(c): b for b, c in enumerate(self._alphabet)}
        if self.lower:
            text = self._library.normalizer.normalize_str(text)
        return [bytes(self._of_char[ord(c)] for c in piece).decode("utf-8", "surrogatepass") for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str | None):
        """(words, None) and (None, special id) in text order."""
        if not text:
            return
        if self.special_split is None or "<|" not in text:
            yield self.words(text), None
            return
        for part in self.special_split.split(text):
            if part in self.special:
                yield None, self.special[part]
            elif part:
                yield self.words(part), None

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text is empty."""
        out = [(_le(s) if words is None else self.cache.join(words)) for words, s in self.segments(text)]
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """encode_bytes of many texts; the words of all of them are verified together."""
        cut = [[*self.segments(t)] for t in texts]
        self.cache.fill(itertools.chain.from_iterable(words for one in cut for words, _ in one if words))
        get = self.cache.__getitem__
        return [b"".join([_le(s) if words is None else b"".join(map(get, words)) for words, s in one]) for one in cut]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4

    def decode(self, ids) -> str:
        """Text of ids; special tokens are kept as their strings."""
        table = self.token_bytes
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


def _le(i: int) -> bytes:
    return int(i).to_bytes(4, "little")


def weight(words: list[str]) -> int:
    """What words take of a cache: one each, and one more for every 32 characters."""
    return len(words) + sum(map(len, words)) // 32


class _WordCache(dict):
    """word -> packed ids, filled in bulk; bounded in words, long ones counting as several."""

    def __init__(self, encoder: BpeEncoder):
        super().__init__()
        self.encoder, self.used = encoder, 0

    def fill(self, words) -> None:
        wanted = set(words)
        fresh = [*wanted.difference(self.keys())]
        if self.used + weight(fresh) > self.encoder.cache_words:
            self.clear()
            self.used, fresh = 0, [*wanted]
        self.used += weight(fresh)
        for k in range(0, len(fresh), 50_000):
            some = fresh[k : k + 50_000]
            self.update(zip(some, self.encoder.encode_words(some)))

    def __missing__(self, word: str) -> bytes:
        self.fill([word])
        return self[word]

    def join(self, words: list[str]) -> bytes:
        self.fill(words)
        return b"".join(map(self.__getitem__, words))


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


_ENCODERS: dict[tuple, BpeEncoder] = {}
_LOCK = threading.Lock()


def encoder(path: str, cache_words: int = 400_000, speculate: bool = True) -> BpeEncoder:
    """The encoder of this Python worker: loaded once, kept across batches and tasks."""
    key = (path, cache_words, speculate)
    with _LOCK:
        if key not in _ENCODERS:
            _ENCODERS[key] = BpeEncoder(*key)
        return _ENCODERS[key]
