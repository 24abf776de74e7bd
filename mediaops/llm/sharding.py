"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import stored
from mediaops.llm.words import mix

#: Shard s stands in region s % REGIONS, there in rack (s // REGIONS) % RACKS, and there at place
#: s // (REGIONS * RACKS): the newest shard is always the last of its rack.
REGIONS, RACKS = 4, 5
#: Rows of a shard are numbered bucket by bucket, so no task holds a whole shard.
SLOT_BUCKETS = 256


def rack_draws(key: np.ndarray, rack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a key has drawn for a rack before any weight is known: a pace, a phase and a length."""
    u = [((mix(mix(key) + np.uint64(rack * 8 + i)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53 for i in range(5)]
    return -np.log(u[0] * u[1]), u[2], -np.log(u[3] * u[4])


def descend(key: np.ndarray, trees: list[np.ndarray]) -> list[np.ndarray]:
    """For each tree (the weights of its shards) the shard of each hashed key.

    The draw of a node of weight w is an arrival time, exponential with rate w: of a rack by
    consistent weighted sampling (Ioffe, 2010), of a region as the earliest of its racks. A key
    descends into the region that arrives first, there into the rack that arrives first, so each
    level is drawn in proportion to the weights of its nodes. With a rack's time comes a mark, even
    over (0, w]: the shards of the rack lie along this span in the order of their places, each as
    long as its weight, and the mark names the shard.

    A rack that gains weight arrives earlier or at the same time, then with the same mark; new marks
    lie in what was added. So a change of weights moves keys only into racks that gained, out of
    racks that lost, and between the shards of the racks that changed; one more shard, the last of
    its rack, takes keys only into itself. The work is one draw a rack for each key, whatever the
    weights and however many shards there are.
    """
    racks = range(REGIONS * RACKS)
    spans = [[np.cumsum(w[r :: len(racks)]) for r in racks] for w in trees]
    first = [np.full((REGIONS, len(key)), np.inf) for _ in trees]
    found = [np.full((REGIONS, len(key)), -1, np.int64) for _ in trees]
    for r in racks:
        pace, phase, length = rack_draws(key, r)
        for span, times, shards in zip(spans, first, found, strict=True):
            span, region = span[r], r % REGIONS
            if not len(span) or not span[-1] > 0:
                continue
            mark = np.exp(pace * (np.floor(np.log(span[-1]) / pace + phase) - phase))
            time = length / (mark * np.exp(pace))
            place = np.searchsorted(span, np.minimum(mark, span[-1]))
            early = time < times[region]
            times[region][early], shards[region][early] = time[early], r + len(racks) * place[early]
    return [shards[times.argmin(0), np.arange(len(key))] for times, shards in zip(first, found, strict=True)]


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: dict[int, float] | None = None, seed: str = "shard-1") -> DataFrame:
    """Every document's shard and its slot there, and the shard it would take if there was one more.

    Returns the columns of ``docs`` without the text, and size (UTF-8 bytes of text plus 16),
    text_crc32 (unsigned), law ('key': doc_id and the tree alone decide), shard, slot (gapless
    from 0 in each shard) and grown_shard (the shard in the tree with one more leaf of weight 1;
    only the new shard gains rows). Input columns of these names are replaced. A weight is 1
    unless given; a rack or region weighs what its shards weigh together.

    Slots number the rows of a shard by (bucket of the hashed id, doc_id): counts per (shard,
    bucket) are cumulated, then rows are numbered inside each bucket, so a task sorts one bucket
    of one shard, never a shard. Texts are hashed where they are read and never shuffled.

    Nulls: a null text has size 16 and crc32 0, a null doc_id hashes as the empty id. Rows with
    equal doc_id share a shard and get slots of their own, in no fixed order among identical
    rows. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard")
    weight = np.array([float((weights or {}).get(s, 1.0)) for s in range(n_shards + 1)])
    weight[n_shards] = 1.0
    if not ((weight >= 0) & np.isfinite(weight)).all() or not (weight[:n_shards] > 0).any():
        raise ValueError("weights must be finite and not below 0, and one above 0")
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = [c for c in docs.columns if c != "text"]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit("")).cast("binary")
    facts = docs.select(
        *names, (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), F.xxhash64(F.lit(seed), key).alias("_key"),
        # rows without an id, which may be many, are dealt by where they are read
        F.pmod(F.xxhash64(F.lit("slot"), key, F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(SLOT_BUCKETS)).cast("int").alias("_bucket"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("_key").to_numpy().view(np.uint64)
            found = [pa.array(s.astype(np.int32)) for s in descend(key, [weight[:n_shards], weight])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "shard", "grown_shard"])

    placed = facts.mapInArrow(run, facts.withColumn("shard", F.lit(0)).withColumn("grown_shard", F.lit(0)).schema)
    placed = stored(placed.drop("_key"), "shards")
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")))
    slot = (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot")
    return ranked.join(offsets, ["shard", "_bucket"]).select(*names, "size", "text_crc32", "law", "shard", slot, "grown_shard")


def op8_shard_documents(spark, sf_dir: str) -> DataFrame:
    """shard_documents (nulls and ties: see there) of all documents into 40 shards of one weight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs)
