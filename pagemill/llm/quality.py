"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned at the training quantiles. Cyclic boosting goes round the features and fits one shallow
tree on one feature's bins at a time, at a small rate, so no feature hides another; the trees of a feature add up to one
lookup table. The pairs of features whose joint bins explain most of what is left get tables in the same way. A score is
a sum of table entries: bin, look up and add, for all rows of a batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.learning import labelled_texts, remainder, training_ids

#: Rows that train at most; bins of a feature and of a feature within a pair; rounds, rate, leaves of a tree; pairs kept.
TRAIN_ROWS, BINS, PAIR_BINS, ROUNDS, RATE, LEAVES, PAIRS = 20_000, 32, 6, 150, 0.15, 4, 8
FOLDS, HELD, CUT = 4, 2, 0.7
FEATURES = (
    "bytes", "words", "word_length", "distinct_share", "top_share", "repeat_share", "lines", "line_length", "repeated_lines", "upper",
    "digits", "marks", "symbols", "full_stops", "commas", "wide", "spaces", "longest_word", "compressed", "ends",
)


def text_features(text: str | None) -> list[float]:
    """Of a whole text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda a, b: float(h[a:b].sum()) / n
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), n / m, len(counts) / m, max(counts.values(), default=0) / m, again / m,
        float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), share(65, 91),
        share(48, 58), float(h[33] + h[63]) / n, (share(35, 39) + share(42, 44) + share(60, 63) + share(64, 65) + share(91, 97) + share(123, 127)),
        float(h[46]) / m, float(h[44]) / m, share(128, 256), (float(h[32] + h[9] + h[10])) / n, float(np.log1p(max(map(len, words), default=0))),
        len(zlib.compress(raw, 1)) / n, sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
    ]


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A regression tree on ordered bins: the best cuts one after the other, a Newton step in each leaf."""
    g, w = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                more = gain(a, c) + gain(c, b) - gain(a, b)
                best = max(best, (float(more.max()), int(c[more.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


@dataclass
class AdditiveModel:
    bias: float
    edges: list[np.ndarray]
    tables: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: np.ndarray  # pair x joint bin

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, edges in enumerate(self.edges):
            z += self.tables[f][np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            joint = np.searchsorted(self.pair_edges[a], x[:, a], side="right") * PAIR_BINS + np.searchsorted(self.pair_edges[b], x[:, b], side="right")
            z += t[joint]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the single tables, then of the best pairs. Without both labels it is the base rate."""
    n, features = x.shape if len(x) else (0, len(FEATURES))
    base = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(float(np.log(base / (1 - base))), [np.zeros(0)] * features, np.zeros((features, BINS)), [], [np.zeros(0)] * features, np.zeros((0, PAIR_BINS**2)))
    if not 0 < y.sum() < n:
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(features)]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    z = np.full(n, model.bias)
    for _ in range(ROUNDS):
        for f in range(features):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = RATE * _tree(np.bincount(binned[f], y - p, BINS), np.bincount(binned[f], p * (1 - p), BINS), LEAVES)
            model.tables[f] += step
            z += step[binned[f]]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(features)]
    small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gains = []
    for a in range(features):
        for b in range(a + 1, features):
            j = small[a] * PAIR_BINS + small[b]
            g, w = np.bincount(j, y - p, PAIR_BINS**2), np.bincount(j, p * (1 - p), PAIR_BINS**2)
            gains.append((float((g**2 / (w + 5.0)).sum()), a, b))
    model.pairs = sorted((a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS])
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS**2))
    for _ in range(ROUNDS // 5):
        for k, (a, b) in enumerate(model.pairs):
            j = small[a] * PAIR_BINS + small[b]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g, w = np.bincount(j, y - p, PAIR_BINS**2), np.bincount(j, p * (1 - p), PAIR_BINS**2)
            step = RATE * g / (w + 5.0)
            model.pair_tables[k] += step
            z += step[j]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [text_features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])


def learn(train: DataFrame) -> AdditiveModel:
    rows = train.select("text", "label").mapInArrow(_features, "x array<double>, label int").collect()
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; null and empty texts get the score of all-zero features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.scores(np.array([text_features(t.as_py()) for t in batch.column(1)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the labels outside the held-out fold, then score all documents."""
    return score_documents(docs, learn(labelled_texts(docs, training_ids(labels, "quality", FOLDS, HELD, train_rows))))
