"""Near-duplicate documents with SetSketch registers: band, estimate jointly, verify on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import components, release, stored
from mediaops.llm.grouped import blocks_of, link_within_groups
from mediaops.llm.words import Words, grams, mix, pieces, utf8

#: SetSketch: M registers floor(1 - log_B of the least of exponential draws of rate A), cut to 0..255.
M, B, A = 256, 1.2, 20.0
_rng = np.random.default_rng(85)
_MUL = _rng.integers(1, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, M, dtype=np.uint64)
#: Sketches and texts compared at once, and the bytes of these texts.
BLOCK, TEXT_BLOCK, TEXT_BYTES = 1024, 512, 16 << 20


def shingle_prints(data: np.ndarray, offsets: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two lanes of the 128-bit prints of each document's distinct k-word shingles, sorted; a
    document of fewer words has its whole sequence as one, a document without words has none."""
    w = Words(data, offsets)
    h = w.prints(lower=True)
    g = [grams(x, k) for x in h]
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            one, at = np.unique(g[0][a : b - k + 1], return_index=True)
            out.append((one, g[1][a : b - k + 1][at]))
        elif b > a:
            out.append(tuple(mix(grams(x[a:b], b - a) + np.uint64(b - a)) for x in h))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def shingle_sets(texts: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """The same sets, exact: sorted numbers that stand for equal shingles and for no others among
    these texts. Words and shingles are compared as they are, nothing is hashed away."""
    data, offsets = utf8(texts)
    w = Words(data, offsets)
    word = w.numbers(lower=True)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(w.first))
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
    base = int(word.max()) + 1 if len(word) else 1
    x = word[at]
    for j in range(1, k):
        x = np.unique(x * base + word[at + j], return_inverse=True)[1]
    short: dict[tuple, int] = {}
    few = [i for i, m in enumerate(np.diff(w.first).tolist()) if 0 < m < k]
    extra = [len(at) + short.setdefault(tuple(word[w.first[i] : w.first[i + 1]].tolist()), len(short)) for i in few]
    doc, x = np.concatenate([doc[at], np.array(few, np.int64)]), np.concatenate([x, np.array(extra, np.int64)])
    span = len(at) + len(short) + 1
    both = np.unique(doc * span + x)
    return np.split(both % span, np.searchsorted(both, np.arange(1, n) * span))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The M registers of a set: minima of exponential draws, which merge by maximum of registers,
    on a scale of powers of B and cut to a byte."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _MUL + _ADD).min(0), out=least)
    u = ((least >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / A) / np.log(B)), 0, 255).astype(np.uint8)


def bands(threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """(bands, registers each): the longest bands with which a pair at the threshold shares none
    with a chance of at most ``miss``."""
    for rows in range(8, 0, -1):
        if (1 - threshold**rows) ** (M // rows) <= miss:
            return M // rows, rows
    return M, 1


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, fp1, fp2 (a 128-bit print of the set) and sketch (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                sets = shingle_prints(data, offsets, k)
                one, two = ([int(mix(s[lane]).sum(dtype=np.uint64)) for s in sets] for lane in range(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s[0]) for s in sets], pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array([registers(s[0]).tobytes() if len(s[0]) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary")


def band_keys(sketches: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """(grp, id): a row for each band of each sketch; equal registers in a band give equal grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, M)
            part = np.zeros((len(s), n_bands, 8), np.uint8)
            part[:, :, :rows] = s[:, : n_bands * rows].reshape(-1, n_bands, rows)
            key = mix(part.reshape(-1, 8).view(np.uint64).ravel() ^ np.tile(mix(np.arange(1, n_bands + 1, dtype=np.uint64)), len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n_bands))], ["grp", "id"])

    return sketches.select("id", "sketch").mapInArrow(run, "grp long, id long")


def likely_similar(sketch: np.ndarray, n: np.ndarray, wanted: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Pairs whose maximum-likelihood Jaccard is at least ``least``, from both sketches and sizes.

    With U, V the sizes' shares, registers are greater, less or equal with chances p(U - V J),
    p(V - U J) and the rest, p(x) = -log_B(1 - x (B - 1) / B). The log-likelihood is concave in J,
    so its maximum lies at ``least`` or above just if its slope there is not negative.
    """
    out = np.zeros_like(wanted)
    c = (B - 1) / B
    for i in range(len(n)):
        js = np.flatnonzero(wanted[i])
        js = js[np.minimum(n[i], n[js]) >= threshold * np.maximum(n[i], n[js]) - 1e-9] if len(js) else js
        if not len(js):
            continue
        more, less = (sketch[i] > sketch[js]).sum(1), (sketch[i] < sketch[js]).sum(1)
        u = n[i] / (n[i] + n[js])
        v = 1 - u
        x, y = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
        p, q = -np.log1p(-x * c) / np.log(B), -np.log1p(-y * c) / np.log(B)
        dp, dq = c / np.log(B) / (1 - x * c), c / np.log(B) / (1 - y * c)
        slope = (M - more - less) * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-9) - more * v * dp / p - less * u * dq / q
        out[i, js[slope >= 0]] = True
    return out


def exactly_similar(sets: list[np.ndarray], wanted: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Pairs with denominator x intersection >= numerator x union of the full sets."""
    n = np.array([len(s) for s in sets])
    need = wanted & (np.minimum(n[:, None], n[None, :]) * denominator >= np.maximum(n[:, None], n[None, :]) * numerator)
    out = np.zeros_like(wanted)
    if need.sum() <= 64:
        for i, j in zip(*np.nonzero(need), strict=True):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            out[i, j] = denominator * both >= numerator * (n[i] + n[j] - both)
        return out
    rows = np.flatnonzero(need.any(0) | need.any(1))
    doc = np.repeat(np.arange(len(rows)), n[rows])
    _, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one document meets nothing
    renumber = np.cumsum(times > 1) - 1
    doc, column = doc[shared], renumber[column[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    width = 8192
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(rows), min(width, total - at)), np.float32)
        dense[doc[lo:hi], column[lo:hi] - at] = 1
        both += dense @ dense.T
    size = n[rows]
    ok = denominator * both.astype(np.int64) >= numerator * (size[:, None] + size[None, :] - both.astype(np.int64))
    out[np.ix_(rows, rows)] = ok
    return out & need


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents are linked if the Jaccard similarity of their sets of k-word shingles (ASCII letters
    in lower case, words between white space) is at least ``percent`` / 100; component_id is the
    least doc_id reachable by links and kept tells whether it is the document's own.

    Equal sets are met first, by a print of 128 bits, so a group of copies goes on as one document.
    Sketches are cut into bands; documents alike in a band and by joint likelihood (four standard
    errors under the threshold) form clusters, inside which full sets are compared block by block,
    word by word; blocks exchange the texts of those documents whose sketches may be alike. A pair at the threshold shares no band with a chance under 10^-4, is estimated
    too low with a chance of about 3 x 10^-5, and is linked by nothing but its full sets.

    Nulls: a null, empty or blank text has no shingles and links with nothing; a null doc_id
    links with nothing, has a null component and is kept. Repeated rows are answered each; rows
    that share a doc_id are one document, linked by any of its texts. Other columns are not read.
    An empty table gives no rows. No cap is set on groups, bands or partners.
    """
    threshold = percent / 100
    n_bands, rows = bands(threshold)
    least = threshold - 4 * float(np.sqrt(threshold * (1 - threshold) / M))
    base = stored(signatures(docs, k), "signatures")
    real = base.filter("n_shingles > 0 and doc_id is not null")
    reps = stored(real.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "set-reps")
    mine = real.join(reps.select("fp1", "fp2", F.col("rep").alias("doc_id")), ["fp1", "fp2", "doc_id"]).dropDuplicates(["fp1", "fp2"])
    sketches = stored(mine.select(F.col("doc_id").alias("id"), "n_shingles", "sketch"), "sketches")

    keys = stored(band_keys(sketches, n_bands, rows), "band-keys")
    met = keys.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("pivot"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print")).filter("n > 1")
    met = stored(met.groupBy("n", "pivot", "print").agg(F.min("grp").alias("grp")), "bands-met")  # bands with the same documents count once
    dealt = met.select("grp", "pivot", blocks_of(F.col("n"), F.lit(0), BLOCK, 1).alias("blocks"))
    members = stored(keys.join(dealt, "grp").join(sketches, "id"), "band-members")
    release(keys, met)

    def alike(rows: pa.Table):
        s = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, M).astype(np.int16)
        n = rows["n_shingles"].to_numpy().astype(float)
        return lambda wanted: likely_similar(s, n, np.triu(wanted | wanted.T, 1), least, threshold)

    clusters = stored(components(link_within_groups(members, ["n_shingles", "sketch"], alike)), "clusters")
    release(members)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(clusters, "id")
    texts = stored(texts.withColumnRenamed("component", "grp"), "cluster-texts")
    sizes = stored(texts.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")), "cluster-sizes")
    dealt = sizes.select("grp", F.col("grp").alias("pivot"), blocks_of(F.col("n"), F.col("size"), TEXT_BLOCK, TEXT_BYTES).alias("blocks"))

    def same(rows: pa.Table):
        sets = shingle_sets(rows["text"], k)
        return lambda wanted: exactly_similar(sets, np.triu(wanted | wanted.T, 1), percent, 100)

    links = link_within_groups(texts.join(dealt, "grp"), ["text"], same, (sketches, alike))
    twice = stored(real.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "shared-ids")
    if twice.limit(1).count():  # rows that share a doc_id are linked through it
        theirs = stored(real.join(twice, "doc_id").join(reps, ["fp1", "fp2"]).select("doc_id", "rep").distinct(), "shared-sets")
        first = theirs.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links = links.union(theirs.join(first, "doc_id").select("a", F.col("rep").alias("b")))
    found = stored(components(links), "set-links")
    release(texts, sizes, clusters, sketches)
    of_set = stored(reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component")), "set-components")
    none = base.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = real.join(of_set, ["fp1", "fp2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(none)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """near_duplicates (nulls and ties: see there) over all documents, 3-word shingles at 85 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) END AS g FROM w
), reps AS (
  SELECT g, min(doc_id) AS rep, len(g) AS n FROM sets WHERE len(g) > 0 GROUP BY g
), s AS (SELECT rep, n, unnest(g) AS x FROM reps
), pairs AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n + m - common) UNION ALL SELECT b, a FROM pairs WHERE 100 * common >= 85 * (n + m - common)
), reach AS (
  SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets s LEFT JOIN reps r ON s.g = r.g LEFT JOIN least_of l ON r.rep = l.rep
"""
