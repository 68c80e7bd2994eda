"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Features of a text are binned by quantiles. Training visits the features in turn and fits a shallow tree of one feature to the
gradient, whose leaves are added to that feature's lookup table at a small rate; the best pairs of features then get tables of
their own in the same way. Scoring looks the bins up and adds: one vectorised addition per table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_bytes, with_arrow
from .quality_rules import base_stats, class_counts

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "other_ascii", "non_ascii", "exclamations", "stops", "duplicate_lines", "repeated_windows", "same_as_previous", "distinct_words", "line_length")


def features(raw: bytes) -> list[float]:
    """The inputs of the model; an empty text gives zeros."""
    n, chars, symbols, dup, repeated = base_stats(raw)
    if not n:
        return [0.0] * len(FEATURES)
    c = class_counts(raw)
    letters = max(1, int(c[0] + c[1] + c[7]))
    words = raw.split()
    lines = raw.count(b"\n") + 1
    same = sum(map(bytes.__eq__, words[1:], words))
    return [np.log1p(n), chars / n, symbols / n, c[1] / letters, c[2] / n, c[9] / n, c[7] / letters, c[10] / n, c[5] / n, dup / lines, repeated / n, same / n, len(set(words)) / np.sqrt(n), np.log1p(n / lines)]


@dataclass
class GamModel:
    """Cut points per feature, a table per feature and per chosen pair, and the intercept."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _split(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, int]:
    """Best cut of a histogram of gradients and hessians: its gain and the first bin of the right side."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + damp) + gr**2 / (hr + damp) - g.sum() ** 2 / (h.sum() + damp), -1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, damp: float) -> np.ndarray:
    """Leaf value for each bin of a tree of at most ``depth`` levels over one feature's bins."""
    gain, at = _split(g, h, damp) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + damp))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, damp), _tree(g[at:], h[at:], depth - 1, damp)])


def _pair_tree(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[np.ndarray, float]:
    """Leaves of a tree over two features: one cut of either feature, then a cut of the other on each side; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _split(a.sum(1), b.sum(1), damp)
        for cut in {at or 1, max(1, len(a) // 4), max(1, len(a) // 2), max(1, 3 * len(a) // 4)}:
            out, gain = np.zeros_like(a), -a.sum() ** 2 / (b.sum() + damp)
            for rows in (slice(0, cut), slice(cut, None)):
                ga, hb = a[rows].sum(0), b[rows].sum(0)
                out[rows] = _tree(ga, hb, 1, damp)
                gain += float(-(out[rows] * a[rows]).sum())
            if gain > best[1]:
                best = (out.T if turned else out, gain)
    return best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 4, bins: int = 32, rate: float = 0.1, depth: int = 2, damp: float = 1.0) -> GamModel:
    """Fits the model to the rows of ``x`` (features) and ``y`` (0 or 1); without both classes it is the intercept alone."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = GamModel(cuts, [np.zeros(len(c) + 1) for c in cuts])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    raw = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            if len(t) > 1:
                g, h = slope()
                step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), depth, damp)
                t += step
                raw += step[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        at = b[:, i] * shape[1] + b[:, j]
        g, h = slope()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = {(i, j): _pair_tree(*grid(i, j), damp)[1] for i, j in combinations(range(len(FEATURES)), 2)}
    model.pairs = sorted(sorted(gains, key=gains.get, reverse=True)[:n_pairs])
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _pair_tree(*grid(i, j), damp)[0]
            t += step
            raw += step[b[:, i], b[:, j]]
    return model


def _feature_rows(part: pa.RecordBatch, column: int) -> np.ndarray:
    data, off = text_bytes(part.column(column))
    raw = data.tobytes()
    return np.array([features(raw[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> GamModel:
    """Trains on at most ``most_rows`` labelled rows (those with the smallest hash of their id; ties by id and label); only they
    reach the driver. Of several documents under one id the one with the smallest hash of its text counts."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("label_id"), "label_id", "y").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = texts.join(F.broadcast(chosen.select("label_id").distinct()), F.col("id") == F.col("label_id"))
    one = wanted.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("y", "text")
    got = with_arrow(rows, lambda b: [pa.FixedSizeListArray.from_arrays(pa.array(_feature_rows(b, 1).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], "x array<double>", drop=("text",)).toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort(np.column_stack([x, got["y"]]).T)  # the result doesn't hang on the order in which rows arrive
    return train(x[order], got["y"].to_numpy()[order], **options)


def score(docs: DataFrame, model: GamModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts score like any text without words.

    Very long texts are taken whole. Repeated rows get equal scores; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    scored = with_arrow(rows, lambda b: [pa.array(model.score(_feature_rows(b, 2)))], "score double", drop=("text",))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 20_000) -> DataFrame:
    """Trains on the labels outside fold 0 of the id and scores every row of ``docs``."""
    return score(docs, fit(docs, labels.where(fold("doc_id", folds) != 0), most_rows), folds=folds)
