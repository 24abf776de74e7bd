"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import fold
from mediaops.llm.sampling import bounded_sample
from mediaops.llm.words import LOWER, NON_LETTER, mix, pieces

BUCKETS = 1 << 13
UND = "und"
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def subword_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, BUCKETS) counts of the hashed byte 2-, 3- and 4-grams of whole texts, in lower
    case and with every run of non-letters as one word bound."""
    n = len(offsets) - 1
    letters = LOWER[data]
    gap = NON_LETTER[data]
    letters[gap] = 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    b, doc = letters[keep].astype(np.uint64) + np.uint64(1), doc[keep]
    counts = np.zeros(n * BUCKETS, np.int64)
    h = b.copy()
    for k in range(1, 4):
        if len(b) <= k:
            break
        h = h[: len(b) - k] * _MULT[0] + b[k:]
        same = doc[: len(b) - k] == doc[k:]
        at = doc[k:][same] * BUCKETS + (mix(h[same] * _MULT[k]) >> np.uint64(51)).astype(np.int64)
        counts += np.bincount(at, minlength=n * BUCKETS)
    return counts.reshape(n, BUCKETS)


def _small_pieces(batch: pa.RecordBatch):
    """Pieces of at most 256 documents, so that the dense counts stay small."""
    for part, data, offsets in pieces(batch):
        for at in range(0, part.num_rows, 256):
            to = min(at + 256, part.num_rows)
            yield part.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


@dataclass
class LanguageModel:
    """``table`` = embeddings x softmax weights: the score of an averaged embedding is the average
    of its rows, so prediction needs no embedding vectors."""

    labels: list[str]
    table: np.ndarray  # (BUCKETS, labels)
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


class SparseCounts:
    """Counts of documents as places and values; rows become dense by the batch."""

    def __init__(self, idx: list, val: list):
        self.bounds = np.concatenate([[0], np.cumsum([len(i) for i in idx])]).astype(np.int64)
        self.idx = np.concatenate([np.asarray(i, np.int32) for i in idx]) if idx else np.zeros(0, np.int32)
        self.val = np.concatenate([np.asarray(v, np.float32) for v in val]) if val else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            a, b = self.bounds[r], self.bounds[r + 1]
            out[k, self.idx[a:b]] = self.val[a:b]
        return out


def train(counts: SparseCounts, y: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 12, rate: float = 1.0, seed: int = 7, false_reject: float = 0.01) -> LanguageModel:
    """Stochastic gradient descent on four fifths of the rows. On the last fifth the temperature is
    set (least log loss) and then the rejection bound: the probability that ``false_reject`` of
    the correctly named rows stay under. Rows are made dense 32 or 256 at a time."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    if len(held) < 20:
        held = learn = order
    learn = learn.copy()
    scale = np.sqrt(BUCKETS) / 8  # averages of thousands of rows are small
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(learn), 32):
            rows = rng.choice(learn, min(32, len(learn))) if at else learn[:32]
            x = counts.dense(rows)
            a = x / np.maximum(x.sum(1, keepdims=True), 1) * scale
            e = a @ emb
            z = e @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad_emb = a.T @ (p @ out.T)
            out -= step * (e.T @ p)
            bias -= step * p.sum(0)
            emb -= step * grad_emb
        rng.shuffle(learn)
    model = LanguageModel(labels, (emb @ out * scale).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    z = np.concatenate([model.logits(counts.dense(held[at : at + 256])) for at in range(0, len(held), 256)])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 25)), key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(held)), y[held]], 1e-12)).mean())
    p = probabilities(model.temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    model.reject_below = float(np.quantile(right, false_reject)) if len(right) else 0.0
    return model


def fit_language(labelled: DataFrame, per_label: int = 800) -> LanguageModel | None:
    """Learn from a bounded sample of (doc_id, text, lang): about ``per_label`` texts for each language.
    The sample's counts (sparse) reach the driver, which trains the model. None if no row has a
    language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _small_pieces(batch):
                counts = subword_counts(data, offsets)
                rows = [np.flatnonzero(c) for c in counts]
                idx = pa.array([r.astype(np.int16) for r in rows], pa.list_(pa.int16()))
                val = pa.array([c[r] for c, r in zip(counts, rows, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), idx, val], ["doc_id", "lang", "idx", "val"])

    rows = labelled.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = bounded_sample(rows, "lang", per_label).mapInArrow(run, f"doc_id {kind}, lang string, idx array<smallint>, val array<long>").toArrow()
    got = got.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    langs, idx, val = got["lang"].to_pylist(), got["idx"].combine_chunks(), got["val"].combine_chunks()
    filled = [i for i in range(len(idx)) if len(idx[i])]
    if not filled:
        return None
    labels = sorted({langs[i] for i in filled})
    counts = SparseCounts([idx[i].values.to_numpy() for i in filled], [val[i].values.to_numpy() for i in filled])
    return train(counts, np.array([labels.index(langs[i]) for i in filled]), labels)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score (its calibrated probability) and rejected of every document.

    ``rejected`` is true where the probability is under the calibrated bound or there is nothing
    to read; a caller that prefers silence to a guess takes 'und' there. lang_pred is 'und', with
    score 0, if the text is null, empty or without a letter, or nothing could be learned. Repeated
    rows are each answered alike; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _small_pieces(batch):
                texts = part.column(1)
                named, score, rejected = [UND] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                letters = np.concatenate([[0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):  # letters of other scripts only
                    has[i] = any(c.isalpha() for c in texts[i].as_py())
                if model is not None and has.any():
                    p = model.probabilities(subword_counts(data, offsets))
                    best = p.argmax(1)
                    score = np.where(has, p[np.arange(len(p)), best], 0.0)
                    rejected = ~has | (score < model.reject_below)
                    named = [model.labels[b] if ok else UND for b, ok in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """predict_language (nulls and ties: see there) of all documents, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language(docs.filter(fold("doc_id", 3) != 1))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
