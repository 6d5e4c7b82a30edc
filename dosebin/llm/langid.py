"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit, over hashed character n-grams,
predicts the bit.  The language whose codeword loses least is chosen, each bit's loss weighted by
how well its classifier did on that language's training rows.  Where the second
language loses hardly more, the answer is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import text_slices
from .samples import per_label, remainder

BITS = 12
RUN = 3
SAMPLE_ROWS = 2000
AMBIGUOUS = 0.1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")  # and some signs, such as fractions and Roman numerals
# Bytes below 128 that are no letters are word ends, and so are their runs.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    trust: np.ndarray  # languages x bits, rows sum to 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of ``n`` classes: all divisions of up to 5 classes, else the best of random codes."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        rest = [c for c in product((-1, 1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in rest], np.int8).T
    bits, random, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(n, dtype=int)
        if apart.min() > best[0] and (np.abs(code.sum(0)) < n).all():
            best = (int(apart.min()), code)
    return best[1]


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed n-grams (1 to RUN bytes) of a whole text; zeros if it has none."""
    counts = np.zeros(1 << BITS, np.int64)
    tail = b" "
    for piece in text_slices((text or "").lower()):
        data = _LETTERS[np.frombuffer(tail + piece + b" ", np.uint8)]
        data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]].astype(np.uint32)
        h = np.zeros(len(data), np.uint32)
        for k in range(RUN):
            h = (h[: len(data) - k] * np.uint32(0x01000193) ^ data[k:]) * np.uint32(0x9E3779B1)
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    total = counts.sum()
    return np.sqrt(counts / max(1, total)).astype(np.float32)


def fit(x: np.ndarray, labels: list[str], rounds: int = 300, penalty: float = 1e-4) -> Model:
    """One logistic classifier per bit by accelerated gradient descent over ``x`` (rows of ``shares``)."""
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    y = np.array([languages.index(v) for v in labels])
    goal = codes[y].astype(np.float32)
    row = (1 / np.bincount(y)[y] / len(languages)).astype(np.float32)[:, None]  # languages weigh the same
    w = v = np.zeros((x.shape[1] + 1, codes.shape[1]), np.float32)
    x1 = np.c_[x, np.ones(len(x), np.float32)]
    for t in range(rounds):
        pull = row * goal / (1 + np.exp(goal * (x1 @ v)))
        new = v + 2.0 * (x1.T @ pull - penalty * v)
        v, w = new + t / (t + 3) * (new - w), new
    right = (np.sign(x1 @ w) == goal).astype(float)
    trust = np.array([right[y == c].mean(0) for c in range(len(languages))]) + 1e-3
    return Model(languages, codes, trust / trust.sum(1, keepdims=True), w[:-1], w[-1])


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of rows of ``shares``."""
    out = x @ model.weights + model.bias
    loss = (model.trust[None] * np.logaddexp(0, -model.codes[None] * out[:, None, :])).sum(2)
    best = loss.argmin(1)
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * model.codes.shape[1])
    score = 1 / odds.sum(1)
    if loss.shape[1] < 2:
        return best, score, np.zeros(len(x), bool)
    second = np.partition(loss, 1, axis=1)[:, 1]
    return best, score, second - loss.min(1) < AMBIGUOUS


def train(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> Model | None:
    """Fit on about ``sample_rows`` documents with a label, as many of each language.

    Rows whose crc32(id) modulo ``folds`` is 0 and rows without a label are left out; texts
    without a letter teach nothing.  The bound holds at every size of the input.  None if no row is left.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where((remainder("id", folds) != 0) & F.col("label").isNotNull())
    sample, counts = per_label(rows, "id", "label", sample_rows)
    if not counts:
        return None
    # Rows that share an id are chosen together: one of each id and label counts.
    sample = sample.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.col("id").cast("string").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            for k, text in enumerate(batch.column("text")):
                if has_letter(text.as_py()):
                    kept.append(k)
                    found.append(shares(text.as_py()).astype(np.float16).tobytes())
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), pa.array(found, pa.binary())], ["id", "label", "x"])

    got = sorted(sample.mapInArrow(run, "id string, label string, x binary").collect())
    if not got:
        return None
    return fit(np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32), [r["label"] for r in got])


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row, ``lang_pred, score, ambiguous``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a model.
    Columns with the new names are replaced.
    """
    spark = docs.sparkSession
    new = ["lang_pred", "score", "ambiguous"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    sent = spark.sparkContext.broadcast(model)  # 2^12 rows of a float per bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            name, score, doubt = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            for i in range(0, n if m else 0, 256):
                texts = batch.column("__text").slice(i, 256).to_pylist()
                has = np.array([has_letter(t) for t in texts])
                if has.any():
                    best, s, d = decode(m, np.array([shares(t) for t, h in zip(texts, has) if h]))
                    at = i + np.flatnonzero(has)
                    name[at], score[at], doubt[at] = np.array(m.languages, object)[best], s, d
            columns = [pa.array(name, pa.string()), pa.array(score), pa.array(doubt)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *new])

    schema = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(True)}).schema
    return rows.mapInArrow(run, schema)
