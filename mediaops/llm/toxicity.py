"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import fold, release, stored
from mediaops.llm.words import NON_LETTER, Words, mix, pieces

#: Bounds of the sample of examples, for each label: about so many documents and bytes of text.
EXAMPLES_PER_LABEL, BYTES_PER_LABEL = 3000, 32 << 20
#: A word's TF-IDF weight is scaled by the square of G / (G + SURE) x L / (L + LARGE): G is the
#: likelihood ratio by which its shares in the two labels differ, L the squared logarithm of the
#: ratio of its odds. All words count, telling ones most.
SURE, LARGE = 24.0, float(np.log(30.0) ** 2)
#: Examples in a block of the index, and blocks read at first.
BLOCK, FIRST_BLOCKS = 32, 4


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word of letters, ASCII letters in lower case."""
    w = Words(data, offsets, NON_LETTER)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(w.first)), w.hashes(lower=True).view(np.int64)


def sampled(known: DataFrame, docs: DataFrame, per_label: int = EXAMPLES_PER_LABEL, max_bytes: int = BYTES_PER_LABEL, seed: str = "toxic-1") -> DataFrame:
    """(doc_id, label, text) of a sample of the labelled documents, drawn by the hash of the id: of each
    label about ``per_label`` documents and ``max_bytes`` bytes, all where there are fewer. It is drawn
    on ids and lengths, so no text is shuffled: the drawn ids go to the texts."""
    sizes = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("_size"))
    ids = stored(known.join(sizes, "doc_id"), "toxic-ids")
    sums = ids.groupBy("label").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / 2.0**52
    rate = F.least(F.lit(float(per_label)) / F.col("_n"), F.lit(float(max_bytes)) / F.greatest("_bytes", F.lit(1)))
    drawn = stored(ids.join(F.broadcast(sums), "label").filter(u < rate).select("doc_id", "label").distinct(), "toxic-drawn")  # sums: two rows
    rows = F.broadcast(drawn).join(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id")  # drawn: about per_label a label
    out = stored(rows.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")), "toxic-examples")
    release(ids, drawn)
    return out


def term_labels(examples: DataFrame) -> DataFrame:
    """term, n and n1 over (text, label): in how many surroundings (words before and after) the term
    stands, and in how many of examples with label 1. Copies of a passage repeat its surroundings,
    so a group of copied examples counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                doc, h = letter_words(data, offsets)
                around = np.zeros(len(h) + 2, np.int64)
                around[1:-1] = h
                ctx = mix((around[:-2].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ around[2:].view(np.uint64)).view(np.int64)
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), pa.array(y[doc])], ["term", "ctx", "y"])

    rows = examples.select("text", F.col("label").cast("long").alias("label"))
    places = rows.mapInArrow(run, "term long, ctx long, y long").groupBy("term", "ctx").agg(F.max("y").alias("y"))
    return places.groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("n1"))


def evidence(n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Between 0 and 1 for each term: how surely it is more frequent in one of the labels."""
    if not len(n):
        return np.zeros(0)
    n0, all1, all0 = n - n1, max(n1.sum(), 1), max((n - n1).sum(), 1)
    share = n / (all1 + all0)
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0)
    g = np.maximum(2 * (part(n1, share * all1) + part(n0, share * all0)), 0)
    odds = np.log(((n1 + 0.5) * (all0 - n0 + 0.5)) / ((n0 + 0.5) * (all1 - n1 + 0.5))) ** 2
    return (g / (g + SURE) * odds / (odds + LARGE)) ** 2 + 1e-9


def term_counts(docs: DataFrame, terms: np.ndarray, *others: str) -> DataFrame:
    """doc_id, ``others``, terms (places in ``terms``) and tf of the whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample's bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            for part, data, offsets in pieces(batch):
                key, tf = np.zeros(0, np.int64), np.zeros(0, np.int64)
                size = max(len(terms), 1)
                if len(terms):
                    doc, h = letter_words(data, offsets)
                    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    hit = terms[at] == h
                    key, tf = np.unique(doc[hit] * size + at[hit], return_counts=True)
                bounds = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key % size, tf)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], ["doc_id", *others, "terms", "tf"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *others))
    return docs.select("doc_id", *others, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, terms array<int>, tf array<int>")


def document_frequencies(counts: DataFrame, n_terms: int) -> np.ndarray:
    """In how many rows each term stands: summed in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    df = np.zeros(n_terms)
    if n_terms:
        t = counts.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        df[t["term"]] = t["n"]
    return df


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and for each place the range that it is of."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[of], of


@dataclass
class BlockMaxIndex:
    """Inverted lists of labelled unit vectors, cut into blocks of BLOCK examples.

    ``term`` bounds each term's entries in ``block`` and ``highest``: the blocks that hold it and its
    greatest weight there; ``entry`` bounds each entry's postings in ``example`` and ``weight``. The
    sum of query weights x block maxima is never under a cosine in the block, so blocks whose sum
    is under the k-th best cosine are not read: the nearest are exact.
    """

    n: int
    term: np.ndarray
    block: np.ndarray
    highest: np.ndarray
    entry: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        """From the terms and weights of each example, in the order of the examples."""
        term = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
        weight = (np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)).astype(np.float32)  # summed up as doubles
        example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
        order = np.lexsort((example, term))
        term, weight, example = term[order].astype(np.int64), weight[order], example[order]
        key = term * (len(rows) // BLOCK + 1) + example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        highest = np.maximum.reduceat(weight, first) if len(key) else np.zeros(0)
        return cls(len(rows), np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32), example[first] // BLOCK, highest, np.append(first, len(key)).astype(np.int32), example, weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples nearest to a unit vector, but for those at ``without``;
        cosine 0 never counts. Ties go to the smaller place."""
        at, of = ranges(self.term[terms], self.term[terms + 1])
        block, w = self.block[at], weights[of]
        bound = np.bincount(block, w * self.highest[at], minlength=self.n // BLOCK + 1) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        place, cosine, done = np.zeros(0, np.int64), np.zeros(0), 0
        while done < len(order) and bound[order[done]] > 0 and (len(cosine) < k or bound[order[done]] >= cosine[-1]):
            least = cosine[-1] if len(cosine) == k else 0.0
            take = order[done : done + (FIRST_BLOCKS if not done else 4 * done)]
            take = take[(bound[take] >= least) & (bound[take] > 0)]
            done += FIRST_BLOCKS if not done else 4 * done
            wanted = np.zeros(len(bound), bool)
            wanted[take] = True
            use = np.flatnonzero(wanted[block])
            post, of_entry = ranges(self.entry[at[use]], self.entry[at[use] + 1])
            score = np.bincount(self.example[post], w[use][of_entry] * self.weight[post], minlength=self.n)
            if without is not None:
                score[without] = 0
            some = np.flatnonzero(score > 0)
            place, cosine = np.concatenate([place, some]), np.concatenate([cosine, score[some]])
            best = np.lexsort((place, -cosine))[:k]
            place, cosine = place[best], cosine[best]
        return place, cosine


def tf_idf(terms: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit weights (1 + log tf) x weight."""
    x = (1 + np.log(tf)) * weight[terms]
    return terms, x / max(np.sqrt((x**2).sum()), 1e-300)


@dataclass
class Examples:
    """The index with the ids and labels of its examples, the weights of the terms, how many labelled
    documents an example of each label stands for, and the calibration of votes."""

    index: BlockMaxIndex
    ids: pa.Array
    y: np.ndarray
    weight: np.ndarray
    stands: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, terms: np.ndarray, tf: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Log odds of label 1 in the votes of the k nearest, each weighted by its squared cosine and
        drawn to the base rate with the weight of a vote at cosine 0.3; and their places."""
        place, cosine = self.index.nearest(*tf_idf(terms, tf, self.weight), k, without)
        w = cosine**2 * self.stands[self.y[place]]
        s = ((w * self.y[place]).sum() + 0.09 * self.base) / (w.sum() + 0.09)
        s = min(max(s, 1e-6), 1 - 1e-6)
        return float(np.log(s / (1 - s))), place


def calibrated(vote: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic law of y given the vote, by Newton steps on smoothed targets."""
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, b = np.column_stack([vote, np.ones(len(vote))]), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (b - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        b = b - step / max(1.0, np.abs(step).max())
    return max(float(b[0]), 1e-3), float(b[1])


def same_id(a: pa.Array, b: pa.Array) -> dict:
    """id -> its places in ``b``, for the ids in ``a`` too."""
    out: dict = {}
    ours = set(a.to_pylist())
    for i, v in enumerate(b.to_pylist()):
        if v in ours:
            out.setdefault(v, []).append(i)
    return out


def fit_examples(docs: DataFrame, labels: DataFrame, label: str, k: int) -> tuple[Examples, Broadcast, DataFrame]:
    """The examples, the same as a broadcast, and the stored term counts of ``docs``."""
    sets = labels.filter(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most"))
    known = sets.filter("label = most").select("doc_id", "label")
    examples = sampled(known, docs)
    t = term_labels(examples).toPandas().sort_values("term")  # words of the sample: bounded by its bytes
    terms = t["term"].to_numpy()
    counts = stored(term_counts(docs, terms), "toxic-counts")
    df, n = document_frequencies(counts, len(terms)), counts.count()
    weight = (np.log((1 + n) / (1 + df)) + 1) * evidence(t["n"].to_numpy(float), t["n1"].to_numpy(float))
    got = term_counts(examples, terms, "label").toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending")])
    of = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    vectors = [tf_idf(np.array(i, np.int64), np.array(f, float), weight) for i, f in zip(got["terms"].to_pylist(), got["tf"].to_pylist(), strict=True)]
    y = got["label"].to_numpy().astype(np.int64)
    # like with like: examples of a label that have the same heaviest word stand in one block
    heavy = np.array([i[np.argmax(w)] if len(i) else -1 for i, w in vectors], np.int64)
    order = np.lexsort((heavy, y))
    stands = np.array([of.get(c, 0) / max((y == c).sum(), 1) for c in (0, 1)])
    ids = got["doc_id"].combine_chunks().take(pa.array(order))
    fit = Examples(BlockMaxIndex.build([vectors[i] for i in order], len(terms)), ids, y[order], weight, stands, of.get(1, 0) / max(sum(of.values()), 1))
    # calibration: each example is voted on by all others
    shared = docs.sparkSession.sparkContext.broadcast(fit)  # bounded by the sample's bytes; votes need no calibration
    votes = voted(term_counts(examples, terms, "label"), shared, k, extra="label").select("vote", "label").toPandas()
    fit.slope, fit.shift = calibrated(votes["vote"].to_numpy(), votes["label"].to_numpy(), stands[votes["label"].to_numpy(int)] if len(votes) else np.zeros(0))
    release(examples)
    return fit, shared, counts


def voted(counts: DataFrame, shared: Broadcast, k: int, extra: str | None = None) -> DataFrame:
    """doc_id, vote, evidence (ids of the three nearest examples) and evidence_label (of the nearest) of
    each row of term counts. An example is no neighbour of its own document."""
    kind = counts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *([extra] if extra else []), "terms", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for batch in batches:
            terms, tf = batch.column("terms"), batch.column("tf")
            bounds, flat, f = terms.offsets.to_numpy(), terms.values.to_numpy(), tf.values.to_numpy()
            own, ids = same_id(batch.column(0), fit.ids), batch.column(0).to_pylist()
            vote, near = np.zeros(batch.num_rows), []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                without = own.get(ids[i])
                vote[i], place = fit.vote(flat[a:b].astype(np.int64), f[a:b], k, None if without is None else np.array(without))
                near.append(place[:3])
            flat_near = pa.array(np.concatenate(near).astype(np.int64)) if near else pa.array([], pa.int64())
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in near])]), pa.int32()), fit.ids.take(flat_near))
            first = pa.array([int(fit.y[p[0]]) if len(p) else None for p in near], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(vote), evidence, first], [*names[:-2], "vote", "evidence", "evidence_label"])

    head = f"doc_id {kind}, " + (f"{extra} {counts.schema[extra].dataType.simpleString()}, " if extra else "")
    return counts.select(*names).mapInArrow(run, f"{head}vote double, evidence array<{kind}>, evidence_label int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", k: int = 15, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (score >= threshold), evidence (ids of the three nearest examples) and
    evidence_label (of the nearest) of every document.

    The examples are a sample of the labelled documents, bounded in rows and bytes (``sampled``). All
    words of theirs are terms: tf from the whole text, idf from all of ``docs``, scaled by how
    surely a word tells the labels apart (``evidence``). Words that no example has weigh nothing.
    The k nearest examples by exact cosine vote with their squared cosines; votes on the examples
    themselves, each without its own, calibrate the score. A document never votes on itself.

    Nulls: null or empty texts have no words, no evidence and the score of the base rate; ``labels``
    rows with a null id or a label other than 0 and 1, and ids with both labels, teach nothing;
    without labels every score is near 0. Repeated rows are scored alike. Other columns are not
    read. An empty table gives no rows.
    """
    fit, shared, counts = fit_examples(docs, labels, label, k)
    slope, shift = F.lit(fit.slope), F.lit(fit.shift)
    score: Column = F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(slope * F.col("vote") + shift, F.lit(50.0)), F.lit(-50.0))))
    out = voted(counts, shared, k).withColumn("score", score)
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "evidence_label")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """toxicity_scores (nulls and ties: see there) of all documents, learned from the labels outside the
    held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 4) != 2)
    found = toxicity_scores(docs, labels)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence", "evidence_label")
