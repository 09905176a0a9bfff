"""Document quality by co-training of a text view and a metadata view.

Each view has its own logistic model over binned features.  In every round
both models label an unlabelled pool, and the rows one view is sure of become
training rows of the other.  At the end each view is calibrated on labelled
rows it was not trained on, and a last logistic model combines the two
calibrated views.  Fitting sees a bounded sample only (``TRAIN_ROWS`` labelled
and ``POOL_ROWS`` unlabelled rows, in hash order); every document is scored.

Null text counts as empty, null metadata has bins of its own.  Without labels of
both classes every document gets the score 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from somagrid.llm.common import WORD, hash_spans, spans, text_chunks

TRAIN_ROWS = 10000
POOL_ROWS = 10000
ROUNDS = 4
SURE = 0.97
KEEP = 0.3
BINS = 12
SOURCE_BUCKETS = 32
TEXT = ["words", "word_length", "upper", "digits", "symbols", "bars", "shouts", "stops", "lines", "distinct", "repeats", "non_ascii"]
META = ["chars", "lang", "source"]
_CLASS = np.zeros((256, 6), bool)
_CLASS[65:91, 0] = True
_CLASS[48:58, 1] = True
_CLASS[[35, 36, 37, 38, 42, 64, 94, 126, 60, 62, 123, 125, 92, 61], 2] = True
_CLASS[124, 3] = True
_CLASS[33, 4] = True
_CLASS[[46, 44], 5] = True


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``TEXT`` figures for every whole text."""
    n = len(off) - 1
    out = np.zeros((n, len(TEXT)))
    size = np.maximum(off[1:] - off[:-1], 1)
    per = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][off])
    s, e, doc = spans(data, off, WORD[data])
    edge = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(edge)
    some = np.maximum(count, 1)
    h = hash_spans(data, s, e)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(doc, e - s, n) / some
    for k, col in enumerate((2, 3, 4, 5, 6, 7)):
        out[:, col] = per(_CLASS[:, k][data]) / size
    out[:, 8] = per(data == 10) / some
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 10] = np.bincount(doc, same, n) / some
    out[:, 11] = per((data >= 0xC0)) / size
    for i in range(n):
        if count[i]:
            own = h[edge[i]:edge[i + 1]]
            out[i, 9] = len(np.unique(own)) / len(own) * (1 + 0.05 * np.log(len(own)))
    return out


def _meta(b: pa.RecordBatch) -> np.ndarray:
    """Metadata figures: log size, hashed language, hashed source; -1 for null."""
    chars = np.array([-1.0 if v is None else np.log1p(max(v, 0)) for v in b.column(2).to_pylist()])
    return np.stack([chars, b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)], axis=1).astype(float)


def _codes(id_col: str, text_col: str) -> list:
    code = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.pmod(F.xxhash64(c), F.lit(SOURCE_BUCKETS))).cast("int")
    return [F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("n_chars").cast("long").alias("n_chars"),
            code("lang").alias("lang"), code("source").alias("source")]


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_codes(id_col, text_col))


class View:
    """Logistic model over one-hot bins of a view's figures."""

    def __init__(self, x: np.ndarray, whole: list[int]):
        self.cuts = [np.arange(-1, SOURCE_BUCKETS) + 0.5 if k in whole else np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
                     for k in range(x.shape[1])]
        self.beta = None

    def code(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for k, c in enumerate(self.cuts):
            z = np.zeros((len(x), len(c) + 1))
            z[np.arange(len(x)), np.searchsorted(c, x[:, k])] = 1
            parts.append(z)
        return np.concatenate(parts, axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray):
        self.beta = logistic(self.code(x), y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.code(x) @ self.beta, -12, 12)


def logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * w[:, None]).T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _figures(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            meta = _meta(b)
            for i, data, off in text_chunks(b, "text"):
                n = len(off) - 1
                x = np.concatenate([text_features(data, off), meta[i:i + n]], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Co-train both views; None without labels of both classes."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    order = [F.xxhash64("id"), F.col("id")]
    known = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(*order).limit(TRAIN_ROWS)
    pool = docs.select(F.col(id_col).alias("id")).dropna().join(rows.select("id"), "id", "left_anti").orderBy(*order).limit(POOL_ROWS).withColumn("y", F.lit(-1.0))
    sample = known.union(pool)
    got = _figures(_inputs(docs, id_col, text_col).join(F.broadcast(sample.select("id")), "id")).join(sample, "id").orderBy(*order).limit(
        2 * (TRAIN_ROWS + POOL_ROWS)).toPandas()  # a bounded sample
    if not len(got):
        return None
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy()
    is_known, fold = y >= 0, np.arange(len(y)) % 4
    train, hold = is_known & (fold != 0), is_known & (fold == 0)
    if len(set(y[train])) < 2 or len(set(y[hold])) < 2:
        return None
    xs = [x[:, :len(TEXT)], x[:, len(TEXT):]]
    views = [View(xs[0][train], []), View(xs[1][train], [1, 2])]
    free = ~is_known
    extra = [(np.zeros(0, np.int64), np.zeros(0))] * 2
    for _ in range(ROUNDS):
        for v, own, (more, label) in zip(views, xs, extra):
            at = np.r_[np.flatnonzero(train), more]
            v.fit(own[at], np.r_[y[train], label])
        if not free.any():
            break
        sure = []
        for v, own in zip(views, xs):
            p = 1 / (1 + np.exp(-v.logit(own[free])))
            pick = (p > SURE) | (p < 1 - SURE)
            sure.append((np.flatnonzero(free)[pick], (p[pick] > 0.5).astype(float)))
        extra = [sure[1], sure[0]]
    # Platt calibration of each view and the combination, on labelled rows outside the training rows
    z = [v.logit(own[hold]) for v, own in zip(views, xs)]
    scale = [logistic(np.stack([np.ones(len(k)), k], axis=1), y[hold], 0.1) for k in z]
    both = np.stack([np.ones(int(hold.sum())), *[a[0] + a[1] * k for a, k in zip(scale, z)]], axis=1)
    return views, scale, logistic(both, y[hold], 0.1)


def _rate(model, data: np.ndarray, off: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    """Text, metadata and combined scores."""
    if model is None:
        return [np.full(len(off) - 1, 0.5)] * 3
    views, scale, last = model
    z = [a[0] + a[1] * v.logit(own) for v, a, own in zip(views, scale, (text_features(data, off), meta))]
    z.append(last[0] + last[1] * z[0] + last[2] * z[1])
    return [1 / (1 + np.exp(-np.clip(k, -30, 30))) for k in z]


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_score, meta_score, score) of every document."""

    def run(batches):
        for b in batches:
            meta = _meta(b)
            for i, data, off in text_chunks(b, "text"):
                n = len(off) - 1
                p = _rate(model, data, off, meta[i:i + n])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), *map(pa.array, p)], ["id", "text_score", "meta_score", "score"])

    source = _inputs(docs, id_col, text_col)
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text_score double, meta_score double, score double")


def keep(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """Rows of ``docs`` that score at least the threshold, with all their columns; nothing is shuffled."""
    coded = docs.select(F.struct(*docs.columns).alias("row"), *_codes(id_col, text_col))

    def run(batches):
        for b in batches:
            meta = _meta(b.select(["id", "text", "n_chars", "lang", "source"]))
            for i, data, off in text_chunks(b, "text"):
                n = len(off) - 1
                good = pa.array(_rate(model, data, off, meta[i:i + n])[2] >= threshold)
                yield pa.RecordBatch.from_struct_array(b.column(0).slice(i, n).filter(good))

    return coded.mapInArrow(run, docs.schema)
