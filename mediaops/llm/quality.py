"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import fold, stored
from mediaops.llm.words import Words, grams, pieces

#: Byte classes: lower, upper, digit, blank, newline, stop or comma, other mark, non-ASCII lead, continuation, control.
_CLASS = np.full(256, 9, np.uint8)
for _k, _span in enumerate([(0x61, 0x7B), (0x41, 0x5B), (0x30, 0x3A)]):
    _CLASS[range(*_span)] = _k
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 6
_CLASS[[0x20, 0x09]] = 3
_CLASS[0x0A] = 4
_CLASS[[ord("."), ord(",")]] = 5
_CLASS[0x80:0xC0] = 8
_CLASS[0xC0:] = 7

STATISTICS = (
    "log_words", "mean_word", "word_spread", "longest_word", "upper", "digits", "stops", "marks", "non_ascii", "newlines",
    "line_length", "word_variety", "pair_variety", "short_words", "marked_words", "upper_words", "stutter",
)
D = len(STATISTICS)
#: Characters and words added to the counts that shares are taken of.
PAD = (20, 5)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, D) transformed statistics of whole texts: logarithms of counts and lengths,
    square roots of shares. Shares are taken of PAD more characters or words than there are, so a
    few words say little. An empty text has zeros but for the varieties, which are 1."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10).astype(float)
    chars = kinds.sum(1) - kinds[:, 8]
    seen = np.maximum(chars - kinds[:, 3] - kinds[:, 4], 1)
    w = Words(data, offsets)
    words = np.diff(w.first).astype(float)
    some = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    mean = _per_doc(length, w.first) / some
    spread = np.sqrt(np.maximum(_per_doc(length**2, w.first) / some - mean**2, 0))
    longest = np.zeros(n)
    if len(length):
        has = words > 0
        longest[has] = np.maximum.reduceat(length, w.first[:-1][has])
    kind = _CLASS[data]
    marks = np.concatenate([[0], np.cumsum(kind == 6)])
    uppers = np.concatenate([[0], np.cumsum(kind == 1)])
    marked = (marks[w.end] - marks[w.start] > 0) if len(length) else length
    upper = ((uppers[w.end] - uppers[w.start]) * 2 > length) & (length > 1) if len(length) else length
    h = w.hashes(lower=True)
    pair = grams(h, 2)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[w.first[:-1][words > 0]] = False
    variety, pairs = np.ones(n), np.ones(n)
    for i in range(n):
        a, b = w.first[i], w.first[i + 1]
        if b - a > 1:
            variety[i] = np.log1p(len(np.unique(h[a:b]))) / np.log1p(b - a)
            pairs[i] = np.log1p(len(np.unique(pair[a : b - 1]))) / np.log1p(b - a - 1)
    share = lambda x, of, pad=PAD[0]: np.sqrt(x / (of + pad))
    return np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), np.log1p(longest), share(kinds[:, 1], seen), share(kinds[:, 2], seen), share(kinds[:, 5], seen), share(kinds[:, 6], seen), share(kinds[:, 7], seen), share(kinds[:, 4], chars),
        np.log1p(words / (kinds[:, 4] + 1)), variety, pairs, *[share(_per_doc(x, w.first), words, PAD[1]) for x in (length < 3, marked, upper, again)],
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                x = document_statistics(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """A Gaussian for each class, kept as its mean, the Cholesky factor of its covariance and
    log prior - half log determinant, so that scoring is one triangular product per class."""

    mean: np.ndarray  # (2, D)
    whiten: np.ndarray  # (2, D, D): inverse Cholesky factors
    constant: np.ndarray  # (2,)
    temper: float
    only: int | None = None

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, ridge: float, temper: float) -> Discriminant:
        """From each class's row count, sum and sum of outer products. The class covariance is
        shrunk to the pooled one, by ``shrink`` or by more for few rows, and by ``ridge`` to the
        pooled variances."""
        if (n == 0).any():  # one class, or none, was seen
            return cls(np.zeros((2, D)), np.zeros((2, D, D)), np.zeros(2), temper, int(np.argmax(n)))
        mean = sums / n[:, None]
        scatter = squares - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / max(n.sum() - 2, 1)
        variances = np.diag(np.maximum(np.diag(pooled), 1e-6))
        whiten, constant = [], []
        for c in range(2):
            w = max(shrink, D / (n[c] + D))  # few rows say little about D x D covariances
            own = w * pooled + (1 - w) * scatter[c] / max(n[c] - 1, 1)
            root = np.linalg.cholesky((1 - ridge) * own + ridge * variances)
            whiten.append(np.linalg.inv(root))
            constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(root)).sum())
        return cls(mean, np.array(whiten), np.array(constant), temper)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.only is not None:
            return np.full(len(x), float(self.only))
        z = [self.constant[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(1) for c in range(2)]
        return 1 / (1 + np.exp(-np.clip((z[1] - z[0]) * self.temper, -50, 50)))


def class_moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of outer products of x by label (0 or 1) over all rows: summed in each
    partition, then by Spark; 2 (1 + D + D D) numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in range(2):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], ["k", "v"])

    got = rows.select("x", F.col("label").cast("long").alias("label")).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + D + D * D))
    for k, v in got:
        total[k] = v
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1 : 1 + D], total[:, 1 + D :].reshape(2, D, D)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.05, ridge: float = 0.2, temper: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (score >= threshold) of every document.

    ``labels`` (doc_id, ``label``) is learned from whole: moments of all its rows, no sample. The
    statistics are made in one pass over the texts and stored; learning and scoring read them.

    Nulls: null or empty texts are scored by the statistics of an empty text; rows of ``labels``
    with a null id or a label other than 0 and 1 teach nothing; where only one class is left to
    learn from, every score is that class. Repeated rows are scored each. Other columns are not
    read. An empty table gives no rows.
    """
    x = stored(with_statistics(docs), "quality-x")
    known = labels.select(F.col("doc_id"), F.col(label).alias("label")).filter("doc_id is not null and label in (0, 1)")
    model = Discriminant.fit(*class_moments(x.join(known, "doc_id")), shrink, ridge, temper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op7_quality_scores(spark, sf_dir: str) -> DataFrame:
    """quality_scores (nulls, ties and empty tables: see there) of all documents, learned from the labels
    outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)
    return quality_scores(docs, labels).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
