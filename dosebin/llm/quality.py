"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A document's features are n-grams of two views of its words: the lower-cased words, and
their shapes (runs of capitals, small letters, digits, other letters; marks as they are).
A feature's value is its share of the document's n-grams, so a score is the mean of the
weights its n-grams hit.  A word that repeats the one before makes one and the same pair,
whatever the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ngrams, text_slices, token_hashes
from .samples import per_label, remainder

BITS = 18
WORD_RUN, SHAPE_RUN = 2, 3
SAMPLE_ROWS = 3000
_REPEATED = np.uint64(0xA0761D6478BD642F)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\r\v\f" else b for b in range(256)], np.uint8)
_SHAPE = np.array(
    [65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else 32 if b in b"\t\r\v\f" else b for b in range(256)],
    np.uint8,
)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    prior: float


def feature_indices(text: str | None) -> np.ndarray:
    """Indices of all n-grams of a whole text, repeats included."""
    found, shift = [], np.uint64(64 - BITS)
    word_tail = shape_tail = np.zeros(0, np.uint64)
    for piece in text_slices(text):
        data = np.frombuffer(piece, np.uint8)
        words = np.r_[word_tail, token_hashes(_LOWER[data])]
        shape = _SHAPE[np.frombuffer(piece.replace(b"\n", b" \x0b "), np.uint8)] if b"\n" in piece else _SHAPE[data]
        keep = np.r_[True, (shape[1:] != shape[:-1]) | (shape[1:] < 48)] if len(shape) else np.zeros(0, bool)
        shapes = np.r_[shape_tail, token_hashes(shape[keep])]
        for view, (h, most, tail) in enumerate(((words, WORD_RUN, len(word_tail)), (shapes, SHAPE_RUN, len(shape_tail)))):
            for k, grams in enumerate(ngrams(h, most)):
                if view == 0 and k == 1:
                    grams = np.where(h[1:] == h[:-1], _REPEATED, grams)
                grams = grams[max(0, tail - k) :]  # those within the tail were counted before
                found.append((((grams + np.uint64(2 * k + view)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint32))
        word_tail, shape_tail = words[-(WORD_RUN - 1) :], shapes[-(SHAPE_RUN - 1) :]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def fit(
    rows: list[tuple[np.ndarray, int]],
    prior: float,
    epochs: int = 5,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-4,
    l2: float = 1e-4,
    scale: float = 30.0,
    seed: int = 7,
) -> Model:
    """Weights by follow-the-regularised-leader updates over ``rows`` in a seeded order.

    Both labels weigh the same in the updates; ``prior`` (the share of label 1) is kept for the score.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    w = np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    ones = sum(y for _, y in rows)
    weight = {1: 0.5 * len(rows) / max(1, ones), 0: 0.5 * len(rows) / max(1, len(rows) - ones)}
    order = np.random.default_rng(seed)
    sparse = []
    for x, y in rows:
        i, c = np.unique(x, return_counts=True)
        sparse.append((i, scale * c / max(1, len(x)), y))
    for _ in range(epochs):
        for r in order.permutation(len(sparse)).tolist():
            i, v, y = sparse[r]
            p = 1 / (1 + np.exp(-np.clip(v @ w[i] + bias, -35, 35)))
            g = weight[y] * (p - y)
            step = (np.sqrt(n[i] + (g * v) ** 2) - np.sqrt(n[i])) / alpha
            z[i] += g * v - step * w[i]
            n[i] += (g * v) ** 2
            w[i] = np.where(np.abs(z[i]) <= l1, 0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    return Model((scale * w).astype(np.float32), float(bias), prior)


def score(model: Model, text: str | None) -> float:
    """Probability of label 1; a text without words gets that of the bias alone."""
    x = feature_indices(text)
    m = float(model.weights[x].mean(dtype=np.float64)) if len(x) else 0.0
    prior = min(max(model.prior, 1e-6), 1 - 1e-6)
    return float(1 / (1 + np.exp(-np.clip(m + model.bias + np.log(prior / (1 - prior)), -35, 35))))


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64)
            found = [feature_indices(t.as_py()).tobytes() for t in some.column("text")]
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), pa.array(found, pa.binary())], ["id", "label", "found"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    folds: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fit on about ``sample_rows`` labelled documents, as many of each label.

    Rows whose crc32(id) modulo ``folds`` is 0 are left out, as are null labels and labels of
    missing documents.  A document labelled twice counts with its smaller label, repeated documents
    once.  The sample's bound holds at every size of the input.  Without labels all scores are 1/2.
    """
    known = labels.where(remainder(id_col, folds) != 0).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    sample, counts = per_label(known, "id", "label", sample_rows)
    if not counts:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.5)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # bounded by the sample
    rows = rows.select(F.col("id").cast("string").alias("id"), "label", "text")
    got = sorted(rows.mapInArrow(_indices, "id string, label int, found binary").collect())
    return fit([(np.frombuffer(r["found"], np.uint32), int(r["label"] > 0)) for r in got], sum(n for k, n in counts.items() if k > 0) / sum(counts.values()))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row and the score of its whole text.

    Null and empty texts are scored by the bias.  A column named ``score_col`` is replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    sent = spark.sparkContext.broadcast(model)  # 2^18 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(sent.value, t.as_py()) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, score_col])

    return rows.mapInArrow(run, rows.drop("__text").withColumn(score_col, F.lit(0.0)).schema)
