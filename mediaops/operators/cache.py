"""Cache aggregates and maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.config import EngineConfig
from mediaops.functions import formats as M
from mediaops.functions import geometry as G
from mediaops.functions import keys as K
from mediaops.plans.routing import seconds, stale_index


def cache_usage(inventory: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """size_kib: bytes rounded up to KiB per file, summed over all rows or by columns."""
    size = F.coalesce(F.sum(F.ceil(F.col("length") / 1024)), F.lit(0)).cast("long").alias("size_kib")
    return inventory.groupBy(*by).agg(size) if by else inventory.agg(size)


def over_capacity(inventory: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row: is the cache larger than its capacity?"""
    return cache_usage(inventory).select((F.col("size_kib") > F.lit(float(cfg.cache_capacity_gb * 1024 * 1024))).alias("over"))


def evict(inventory: DataFrame, stale: DataFrame, by: str = "stem") -> DataFrame:
    """Adds ``removed``. By ``stem`` all entries of that name go; by ``key`` (column cache_key) only
    the entry itself, which is safe against equal names."""
    column = {"stem": "stem", "key": "cache_key"}[by]
    gone = stale.select(column).distinct().withColumn("removed", F.lit(True))
    return inventory.join(gone, column, "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def document_work(requests: DataFrame, documents: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct convertible sources asked for whose converted file is absent or older than them;
    ``reason`` tells which."""
    wanted = requests.select("path").distinct().filter(M.classify(F.col("path"))["convertible"])
    done = documents.groupBy("path").agg(F.max("cached_at").alias("cached_at"))
    joined = wanted.join(assets.select("path", "modified_at"), "path").join(done, "path", "left")
    reason = F.when(F.col("cached_at").isNull(), "absent").when(seconds(F.col("cached_at")) < seconds(F.col("modified_at")), "stale")
    return joined.select("path", K.document_key(F.col("path")).alias("document_key"), reason.alias("reason")).filter("reason is not null")


def render_plan(routed: DataFrame) -> DataFrame:
    """Distinct renditions still to be made, one row per cache key with all step parameters."""
    spec = F.col("spec")
    turned = routed.filter("outcome = 'render'")
    resize = F.when(spec["width"].isNotNull() | spec["height"].isNotNull(), F.col("box"))
    page = F.when(F.col("kind.paged"), G.clamp_page(spec["page"], F.col("n_pages"))).otherwise(F.lit(0).cast("long"))
    steps = turned.select(
        "cache_key", "path", "output_format", page.alias("page"), F.when(F.col("kind.svg") | F.col("kind.paged"), F.col("loaded")).alias("load"), resize.alias("resize"), spec["rotate"].alias("rotate"),
        F.when(F.col("kind.transparent") & (F.col("output_format") != "jpg"), spec["background"]).alias("composite"), F.col("out").alias("out"), M.encode_options(spec["quality"], spec["background"], F.col("output_format"), F.col("out.w"), F.col("out.h")).alias("encode"),
    )
    return steps.dropDuplicates(["cache_key"])


def bust_cache(inventory: DataFrame, index: DataFrame, assets: DataFrame, cfg: EngineConfig, by: str = "stem") -> DataFrame:
    """evict() of the stale entries if the cache is over its capacity, else nothing is removed. The
    gate is one row of the plan; no decision is taken on the driver."""
    marked = evict(inventory, stale_index(index, assets), by)
    gate = F.broadcast(over_capacity(inventory, cfg))  # exactly one row
    return marked.join(gate, how="cross").withColumn("removed", F.col("removed") & F.col("over")).drop("over")


def key_collisions(params_table: DataFrame, digits: int = 6) -> DataFrame:
    """Files on which different specs of one path and format would land if keys kept only the first
    ``digits`` digits of the spec's hash: path_hash, prefix, output_format, n_specs."""
    short = params_table.select("path_hash", F.substring("params_hash", 1, digits).alias("prefix"), "output_format", "params_hash").distinct()
    return short.groupBy("path_hash", "prefix", "output_format").agg(F.count("*").alias("n_specs")).filter("n_specs > 1")
