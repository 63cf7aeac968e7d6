"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts become a short vector of plain features (byte mix, words, repetition).  Features are cut into quantile bins; cyclic
boosting visits them in turn and adds a shallow tree (a few cuts over the bins, fitted to the log-loss residual) to the feature's
lookup table.  Pairs with the strongest remaining signal get two-way tables, boosted alike by four-cell trees.  A score is the sigmoid of the sum of
table entries: one `searchsorted` and one addition for each feature and pair.

The model is fitted on at most `sample_rows` labelled rows (a documented bound; rows are chosen by the order of a hash, so the choice does
not depend on the table's order).  Only their feature vectors reach the driver.  Scoring is one map stage over all documents.

Labels, language, source and ids are no inputs of a score.  Defined results: null and empty texts have a feature vector of zeros
and a score like any other; repeated rows are scored alike; null labels are left out; without labels of both kinds the score is
the smoothed share of label 1 (0.5 without any); an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "same_as_before", "distinct_lines", "top_line", "mean_line",
    "upper", "lower", "digit", "space", "newline", "stops", "exclaim", "pipe", "symbols", "quotes", "brackets", "high_bytes", "controls", "entropy", "plain_ends",
)
HELD_OUT_OF, HELD_OUT = 4, 2


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _LOWER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz")
_SHARES = np.stack([_UPPER, _LOWER, _mask("0123456789"), _mask(" \t"), _mask("\n\r"), _mask(".,;:?"), _mask("!"), _mask("|"), _mask("#$%&*+=<>@^_~\\/"), _mask("\"'`"), _mask("()[]{}"), np.arange(256) >= 128, (np.arange(256) < 32) & ~np.isin(np.arange(256), [9, 10, 13])], axis=1).astype(float)


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    share = hist / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    count, line_count = Counter(words), Counter(lines)
    n, m = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    some = share[share > 0]
    out[:10] = (
        np.log1p(len(raw)), np.log1p(len(words)), sizes.sum() / n, (sizes > 14).sum() / n, len(count) / n, max(count.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(line_count) / m, max(line_count.values(), default=0) / m, np.log1p(len(words) / m),
    )
    out[10:23] = share @ _SHARES
    out[23] = -(some * np.log2(some)).sum()
    out[24] = sum(map(str.isalnum, [w[-1] for w in words])) / n
    return out


@dataclass
class Additive:
    """Lookup tables of a fitted model."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), (ea, eb), t in zip(self.pairs, self.pair_edges, self.pair_tables):
            total += t[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins: the value of each bin; g, h are the sums of gradient and curvature by bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]

    def gain(lo, hi):
        if hi - lo < 2:
            return 0.0, None
        at = np.arange(lo + 1, hi)
        gl, hl = cg[at] - cg[lo], ch[at] - ch[lo]
        gr, hr = cg[hi] - cg[at], ch[hi] - ch[at]
        v = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
        k = int(v.argmax())
        return v[k] - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge), int(at[k])

    for _ in range(leaves - 1):
        best = max((gain(lo, hi) for lo, hi in zip(cuts, cuts[1:])), key=lambda x: x[0])
        if best[1] is None or best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _four_cells(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best cut in both directions of a two-way table: gain and values."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    if not len(a) or not len(b):
        return 0.0, np.zeros_like(g)

    def cells(c):
        ll = c[np.ix_(a, b)]
        top, side = c[a, -1][:, None], c[-1, b][None, :]
        return ll, top - ll, side - ll, c[-1, -1] - top - side + ll

    values = [(x, y) for x, y in zip(cells(cg), cells(ch))]
    v = sum(x**2 / (y + ridge) for x, y in values)
    i, j = np.unravel_index(v.argmax(), v.shape)
    out = np.empty_like(g)
    for (x, y), rows, cols in zip(values, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return float(v[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, leaves: int = 4, n_pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 60, ridge: float = 1.0) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return Additive([np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], float(np.log(share / (1 - share))))
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))))
    total = np.full(len(y), model.base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(binned, model.tables):
            if len(t) < 2:
                continue
            g, h = residual()
            step = rate * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), leaves, ridge)
            t += step
            total += step[b]
    small = [_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(small)]

    def two_way(a, b, w):
        return np.bincount(coarse[a] * (len(small[b]) + 1) + coarse[b], w, (len(small[a]) + 1) * (len(small[b]) + 1)).reshape(len(small[a]) + 1, -1)

    g, h = residual()
    gains = sorted(((_four_cells(two_way(a, b, g), two_way(a, b, h), ridge)[0], a, b) for a in range(x.shape[1]) for b in range(a) if len(small[a]) and len(small[b])), reverse=True)
    for _, a, b in gains[:n_pairs]:
        model.pairs.append((a, b))
        model.pair_edges.append((small[a], small[b]))
        model.pair_tables.append(np.zeros((len(small[a]) + 1, len(small[b]) + 1)))
    for _ in range(pair_rounds):
        for (a, b), t in zip(model.pairs, model.pair_tables):
            g, h = residual()
            step = rate * _four_cells(two_way(a, b, g), two_way(a, b, h), ridge)[1]
            t += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id):
    """True for the rows that never train: crc32 of the id as text leaves the fixed remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label_col: str = "quality") -> Additive:
    """Fit on at most sample_rows labelled rows that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample_rows)
    )
    joined = whole_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")  # sample_rows short rows at most are sent

    def vectors(batches):
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # of texts that share an id and a label the one with the least vector, so no more rows than were chosen, whatever the table's order
    rows = joined.mapInArrow(vectors, "doc_id long, y double, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()
    y = rows.column(0).to_numpy()
    x = np.array(rows.column(1).to_pylist()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T[::-1], y))  # the same model whatever order the rows came in
    return fit(x[order], y[order])



def _scores(model: Additive, texts: list) -> np.ndarray:
    return model.scores(np.stack([features(t) for t in texts])) if texts else np.empty(0)


def score(docs: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(sent.value, b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = whole_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Additive, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            good = _scores(sent.value, b.column(at).to_pylist()) >= threshold
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
