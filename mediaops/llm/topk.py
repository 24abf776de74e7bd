"""Exact top-k search by inner product, pruned with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import release, stored
from mediaops.llm.grouped import stream_groups

#: Resolutions, coarse to fine: into so many segments a vector is cut.
LEVELS = (1, 4, 16, 32)
#: Segments of the boxes of blocks.
BOX = 16
#: A level that has removed less than this share of so many pairs is left out from then on: it costs more than it spares.
USEFUL, SEEN = 0.1, 1 << 16
BOX_LEVEL = LEVELS.index(BOX)
#: Vectors are dealt into blocks of at least so many rows, and into at most so many blocks, so that
#: the statistics of all blocks (about 400 bytes each) are small whatever the table's size.
BLOCK_ROWS, MAX_BLOCKS = 2048, 16384
#: Queries that meet one copy of a block, and vectors compared at once.
QUERY_GROUP, CHUNK = 8192, 512


def clean(vectors: Column) -> Column:
    """True for a vector without null and non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vectors.isNotNull() & ~F.exists(vectors, bad), F.lit(False))


def segment_statistics(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum / sqrt(length) and deviation norm of each of ``parts`` segments of each row."""
    bounds = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    length = np.diff(bounds)
    total = np.add.reduceat(x, bounds[:-1], axis=1)
    square = np.add.reduceat(x * x, bounds[:-1], axis=1)
    return total / np.sqrt(length), np.sqrt(np.maximum(square - total**2 / length, 0))


def sign_code(x: np.ndarray) -> np.ndarray:
    """The signs of the segment sums as one number, coarse levels first: like vectors have near ones."""
    signs = np.concatenate([segment_statistics(x.astype(float), p)[0] > 0 for p in LEVELS[: BOX_LEVEL + 1]], axis=1)
    return (signs << np.arange(signs.shape[1])[::-1]).sum(1)


def loosened(bound: np.ndarray) -> np.ndarray:
    """Bounds a little higher: rounding never rules a tie out."""
    return bound + 1e-6 * np.abs(bound) + 1e-3


def box_bounds(q: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """(queries, boxes): above the inner product with any vector whose sums stand between ``low`` and
    ``high`` and whose deviation norms are at most ``deviation`` in each segment."""
    up, down = np.maximum(q[0], 0), np.minimum(q[0], 0)
    return loosened(up @ high.T + down @ low.T + q[1] @ deviation.T)


class Searcher:
    """Top ``k`` of integer vectors for a group of queries.

    Split into means and deviations, squared distance is at least, in each segment, length x
    (difference of means)^2 + (difference of deviation norms)^2. With the norms known, that lower
    bound on distance is an upper bound on the inner product: sums x sums + norms x norms. A
    query's ``floor`` (its k-th best score so far) rules out whole chunks of vectors first, then
    single ones, coarse statistics before fine; each level looks at the pairs that the level
    before has left, and exact scores are computed for the survivors. A level that rules out hardly
    any pair is left out later, which changes no result. Ties are kept.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, queries, k
        self.levels = [segment_statistics(queries.astype(float), p) for p in LEVELS]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(float).copy()
        self.found = (np.zeros(0, np.int64),) * 3  # place of the query, id, score
        self.compared, self.removed = [0] * (len(LEVELS) + 1), [0] * len(LEVELS)  # pairs looked at, by level and exactly; those ruled out

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Offer vectors; like ones should follow one another."""
        if not len(ids) or not len(self.ids):
            return
        top = int(max(np.abs(x).max(), 1)) * int(max(np.abs(self.q).max(), 1)) * x.shape[1]
        if top >= 2**63:
            raise OverflowError("scores of these vectors do not fit 64 bits")
        xf = x.astype(float)
        stats = [segment_statistics(xf, p) for p in LEVELS]
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            fine = [s[part] for s in stats[BOX_LEVEL]]
            box = box_bounds(self.levels[BOX_LEVEL], fine[0].min(0)[None], fine[0].max(0)[None], fine[1].max(0)[None])[:, 0]
            rows, c = np.flatnonzero(box >= self.floor), np.arange(at, min(at + CHUNK, len(ids)))
            if not len(rows):
                continue
            pairs = None  # all of rows x c
            for level, ((qs, qd), (xs, xd)) in enumerate(zip(self.levels, stats, strict=True)):
                if not np.isfinite(self.floor[rows]).any():
                    break
                if self.compared[level] >= SEEN and self.removed[level] < USEFUL * self.compared[level]:
                    continue
                if pairs is None:
                    stay = loosened(qs[rows] @ xs[c].T + qd[rows] @ xd[c].T) >= self.floor[rows][:, None]
                    i, j = np.nonzero(stay)
                    looked, pairs = stay.size, (rows[i], c[j])
                else:
                    r, p = pairs
                    stay = loosened(np.einsum("ij,ij->i", qs[r], xs[p]) + np.einsum("ij,ij->i", qd[r], xd[p])) >= self.floor[r]
                    looked, pairs = len(r), (r[stay], p[stay])
                self.compared[level] += looked
                self.removed[level] += looked - len(pairs[0])
            r, c = pairs if pairs is not None else (np.repeat(rows, len(c)), np.tile(c, len(rows)))
            other = self.ids[r] != ids[c]
            r, c = r[other], c[other]
            self.compared[-1] += len(r)
            exact = np.einsum("ij,ij->i", self.q[r].astype(float), xf[c]).astype(np.int64) if top < 2**53 else np.einsum("ij,ij->i", self.q[r], x[c])
            self.merge(r, ids[c], exact)

    def merge(self, r: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        stay = score >= self.floor[r]
        r, ids, score = (np.concatenate([old, new[stay]]) for old, new in zip(self.found, (r, ids, score), strict=True))
        order = np.lexsort((ids, -score, r))
        r, ids, score = r[order], ids[order], score[order]
        first = np.searchsorted(r, np.arange(len(self.ids)))
        keep = np.arange(len(r)) - first[r] < self.k
        self.found = r[keep], ids[keep], score[keep]
        full = np.bincount(self.found[0], minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.found[0], np.flatnonzero(full), side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.found[2][last])

    def rows(self) -> pa.RecordBatch:
        r, ids, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def by_length(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the lists of each length above 0."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    length = np.diff(v.offsets.to_numpy())
    for d in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == d)
        yield d, own, v.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)


def in_blocks(vectors: DataFrame, n: int) -> DataFrame:
    """(block, vec_id, v): like vectors stand together. They are sorted by the signs of their segment
    sums, coarse before fine, and dealt into even ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for _, own, x in by_length(batch.column(1)):
                code[own] = sign_code(x)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], ["code", "vec_id", "v"])

    blocks = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    coded = vectors.select("vec_id", "v").mapInArrow(run, "code long, vec_id long, v array<long>")
    dealt = coded.repartitionByRange(blocks, F.size("v"), "code", "vec_id").sortWithinPartitions(F.size("v"), "code", "vec_id")
    return stored(dealt.select(F.spark_partition_id().alias("block"), "vec_id", "v"), "search-blocks")


def block_boxes(blocks: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the blocks that hold such vectors and, in each of BOX segments,
    the least and the greatest sum and the greatest deviation norm: at most MAX_BLOCKS rows and
    one more for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            for d, own, x in by_length(batch.column(1)):
                s, dev = segment_statistics(x.astype(float), BOX)
                first = np.flatnonzero(np.concatenate([[True], block[own][1:] != block[own][:-1]]))
                low, high, most = (f.reduceat(a, first, axis=0) for f, a in ((np.minimum, s), (np.maximum, s), (np.maximum, dev)))
                m = s.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(low.size, d)), pa.array(np.repeat(block[own][first], m).astype(np.int32)), pa.array(np.tile(np.arange(m), len(first))), *map(pa.array, (low.ravel(), high.ravel(), most.ravel()))], ["d", "block", "s", "low", "high", "most"])

    rows = blocks.select("block", "v").mapInArrow(run, "d long, block int, s long, low double, high double, most double")
    t = rows.groupBy("d", "block", "s").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most")).toPandas().sort_values(["d", "block", "s"])
    return {int(d): (g["block"].to_numpy().reshape(-1, min(BOX, d))[:, 0], *[g[c].to_numpy().reshape(-1, min(BOX, d)) for c in ("low", "high", "most")]) for d, g in t.groupby("d")}


def searched(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each (block, query_id, q, floor) in that block. A block
    meets its queries in one task, in copies where more than QUERY_GROUP ask for it."""
    parts = stored(asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERY_GROUP)).cast("int").alias("copies")), "block-copies")
    none = F.lit(None)
    left = blocks.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", none.cast("double").alias("floor"))
    right = asked.join(parts, "block").select("block", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int").alias("copy"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("v"), "floor")

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        kind, ids = rows["kind"].to_numpy(), rows["id"].to_numpy()
        found = []
        sides = [{d: (ids[at][own], x, own) for d, own, x in by_length(rows["v"].combine_chunks().take(pa.array(at)))} for at in (np.flatnonzero(kind == 0), np.flatnonzero(kind == 1))]
        floor = rows["floor"].to_numpy()[kind == 0]
        for d in sides[0].keys() & sides[1].keys():
            (q_ids, q, own), (v_ids, v, _) = sides[0][d], sides[1][d]
            s, order = Searcher(q_ids, q, k, floor[own]), np.argsort(sign_code(v), kind="stable")
            s.add(v_ids[order], v[order])
            found.append(s.rows())
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found and sum(map(len, found)) else None

    return stream_groups(left.unionByName(right), ["block", "copy"], work, "query_id long, vec_id long, score long")


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query the k rows of ``vectors`` with the
    greatest inner product, ties to the smaller vec_id, never the row with the query's own id.

    Both tables have vec_id and v, a clean array<long>. Vectors are dealt into blocks of like ones,
    whose statistics, bounded in size, are sent to all tasks. A query first searches the block
    with the highest bound; its k-th best score there rules out most blocks, and it is sent to
    those that are left. Queries never pass through the driver.

    Vectors of another length than the query's, and rows with a null vec_id, take no part; the
    callers leave out null, short and non-finite vectors with ``clean``. Empty vectors take no part.
    Repeated ids are all offered, and each query of an id is answered. No queries, or no vectors,
    give no rows. Scores that may not fit 64 bits raise OverflowError.
    """
    ok = "vec_id is not null and v is not null and size(v) > 0"
    vectors = stored(vectors.filter(ok).select("vec_id", "v"), "search-vectors")
    queries = stored(queries.filter(ok).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id", "q"]), "search-queries")
    blocks = in_blocks(vectors, vectors.count())
    release(vectors)
    boxes = vectors.sparkSession.sparkContext.broadcast(block_boxes(blocks))

    def choose(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, own, q in by_length(batch.column(1)):
                    if d not in boxes.value:
                        continue
                    names, low, high, most = boxes.value[d]
                    for at in range(0, len(own), CHUNK):
                        some = own[at : at + CHUNK]
                        bound = box_bounds(segment_statistics(q[at : at + CHUNK].astype(float), BOX), low, high, most)
                        best = bound.argmax(1)
                        floor = np.full(len(some), -np.inf) if first else batch.column(2).to_numpy()[some]
                        wanted = np.zeros(bound.shape, bool) if first else bound >= floor[:, None]
                        wanted[np.arange(len(some)), best] = first
                        r, c = np.nonzero(wanted)
                        part = batch.take(pa.array(some[r]))
                        yield pa.RecordBatch.from_arrays([pa.array(names[c].astype(np.int32)), part.column(0), part.column(1), pa.array(floor[r])], ["block", "query_id", "q", "floor"])

        return run

    schema = "block int, query_id long, q array<long>, floor double"
    near = stored(searched(stored(queries.mapInArrow(choose(True), schema), "first-asked"), blocks, k), "first-found")
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).cast("double").alias("floor"))
    known = queries.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    asked = stored(known.mapInArrow(choose(False), schema), "then-asked")
    found = near.unionByName(searched(asked, blocks, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """exact_top_k (nulls and ties: see there) of every hundredth vector against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(clean(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))
    return exact_top_k(rows.filter("vec_id % 100 = 0"), rows, 10)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
