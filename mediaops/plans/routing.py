"""Planning and routing of requests: joins with asset and cache tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.config import EngineConfig
from mediaops.functions import formats as M
from mediaops.functions import geometry as G
from mediaops.functions import keys as K
from mediaops.operators.requests import typed_requests
from mediaops.operators.signing import verify_tokens
from mediaops.session import bound, per_distinct
from mediaops.sources.inventory import OUTPUTS, cache_inventory, stem_of


def seconds(ts: Column) -> Column:
    """Times are compared as whole seconds."""
    return F.date_trunc("second", ts.cast("timestamp_ntz"))


def missing_assets(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Requests whose source does not exist."""
    return requests.join(assets.select("path"), "path", "left_anti")


def attach_assets(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Requests with the source's width, height, has_alpha, n_pages, modified_at and EXIF orientation (1
    where the table has no such column, or null there), and ``exists``.

    Spark broadcasts the narrow asset side where its size allows; beyond that both sides are
    dealt by path, and adaptive execution splits a path with very many requests."""
    orientation = F.coalesce(F.col("orientation").cast("int"), F.lit(1)) if "orientation" in assets.columns else F.lit(1)
    meta = assets.select("path", "width", "height", "has_alpha", "n_pages", "modified_at", orientation.alias("orientation"), F.lit(True).alias("exists"))
    return requests.join(meta, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def upright(orientation: Column, width: Column, height: Column) -> Column:
    """The size after the EXIF orientation is undone: 5 to 8 swap the sides."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).cast("int").alias("w"), F.when(turned, width).otherwise(height).cast("int").alias("h"))


def plan_requests(attached: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Adds what is decided without the cache: flags of the path, negotiated and limited format,
    keys and final size. Rows need spec, accept and the columns of attach_assets.

    Vector and page sources are loaded at the size that the request needs (``loaded``), all others
    at their own, made upright; limits, box and final size follow from that size."""
    spec, kind = F.col("spec"), M.classify_extension(F.col("_ext"))
    sides = (spec["width"], spec["height"])
    df = bound(attached, _ext=M.file_extension(F.col("path")), source=upright(F.col("orientation"), F.col("width"), F.col("height")))
    df = df.withColumn("negotiated", M.negotiate_format(spec["format"], F.col("accept"), cfg.avif_enable))
    own = F.col("source")
    shrunk = kind["svg"] | kind["paged"]
    df = bound(df, _target=G.target_dims(*sides, own["w"], own["h"]))
    df = bound(df, loaded=F.when(shrunk, G.rasterize_dims(F.col("_target"), spec["rotate"], own["w"], own["h"])).otherwise(own)).drop("_target", "source")
    size = F.col("loaded")
    limited = M.enforce_limits(F.col("negotiated"), spec["format"] != "auto", size["w"], size["h"], F.col("has_alpha"))
    df = bound(df, box=G.pipeline_dims(*sides, spec["rotate"], size["w"], size["h"]), limited=limited, params_hash=K.params_hash(spec))
    key = lambda fmt: K.cache_key(F.col("params_hash"), F.col("path"), fmt)
    df = df.withColumn("first_key", key(F.col("negotiated"))).withColumn("cache_key", key(F.coalesce("limited.output_format", "negotiated")))
    resize = spec["width"].isNotNull() | spec["height"].isNotNull()
    df = bound(df, out=G.output_dims(F.col("box"), resize, spec["rotate"], size["w"], size["h"]))
    # last: Spark loses single fields of a struct that passes several generators
    return df.withColumn("kind", kind).drop("_ext").withColumn("output_format", F.col("limited.output_format"))


def _state(cached_at: Column) -> Column:
    return F.when(cached_at.isNull(), "absent").when(seconds(cached_at) < seconds(F.col("modified_at")), "stale").otherwise("hit")


def cache_lookup(planned: DataFrame, variants: DataFrame, key: str = "cache_key") -> DataFrame:
    """Adds ``cache_state``: hit, stale or absent. An entry is stale if its source changed in a
    later second; one whose source is gone still hits."""
    entries = variants.groupBy(F.col("cache_key").alias(key)).agg(F.max("cached_at").alias("cached_at"))
    joined = planned.join(entries, key, "left")
    return joined.withColumn("cache_state", _state(F.col("cached_at"))).drop("cached_at")


def lookup_both(planned: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``first_state`` and ``cache_state``, those of first_key and cache_key, by one join with an
    inventory (``sources.inventory``): both keys differ in their format alone. A bucketed inventory
    is read as it lies, without an exchange."""
    joined = planned.withColumn("stem", stem_of(F.col("cache_key"))).join(inventory.select("stem", "cached"), "stem", "left")

    def at(key: str) -> Column:
        fmt, out = F.substring_index(key, ".", -1), F.lit(None).cast("timestamp_ntz")
        for f in OUTPUTS:
            out = F.when(fmt == f, F.col(f"cached.{f}").cast("timestamp_ntz")).otherwise(out)
        return out

    return joined.withColumns({"first_state": _state(at("first_key")), "cache_state": _state(at("cache_key"))}).drop("stem", "cached")


def _stale_documents(planned: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Adds ``converting``: the source is a document without a fresh converted file."""
    if documents is None:
        return planned.withColumn("converting", F.col("kind.convertible"))
    done = documents.groupBy("path").agg(F.max("cached_at").alias("converted_at"))
    joined = planned.join(done, "path", "left")
    fresh = F.col("converted_at").isNotNull() & ~F.coalesce(seconds(F.col("converted_at")) < seconds(F.col("modified_at")), F.lit(False))
    return joined.withColumn("converting", F.col("kind.convertible") & ~fresh).drop("converted_at")


def plan_error(cfg: EngineConfig) -> Column:
    """Why a request cannot be rendered; null if it can."""
    spec = F.col("spec")
    return (
        F.when((F.col("negotiated") == "pdf") & ~F.col("kind.convertible"), "pdf_not_available")
        .when((spec["width"] == 0) | (spec["height"] == 0), "invalid_dimension")
        .otherwise(F.col("limited.error"))
    )


def plan_routes(requests: DataFrame, assets: DataFrame, cfg: EngineConfig, documents: DataFrame | None = None) -> DataFrame:
    """Requests with all that is decided without the cache."""
    typed = verify_tokens(typed_requests(requests), cfg.key)
    planned = _stale_documents(plan_requests(attach_assets(typed, assets), cfg), documents)
    return planned.withColumn("error", plan_error(cfg))


def decide(planned: DataFrame, inventory: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Adds outcome and status to planned requests, by what the cache's inventory has."""
    looked, error = lookup_both(planned, inventory), F.col("error")
    use_cache = F.lit(cfg.cache_enable) & ~F.col("converting")
    hit = use_cache & ((F.col("first_state") == "hit") | (error.isNull() & (F.col("cache_state") == "hit")))
    outcome = (
        F.when(F.col("raw.bad"), "bad_request")
        .when(F.col("auth") != "ok", "forbidden")
        .when(~F.col("exists"), "not_found")
        .when(F.col("spec.original") | ~F.col("kind.supported"), "original")
        .when(hit, "cached")
        .when(error.isNotNull(), "error")
        .otherwise("render")
    )
    looked = looked.withColumn("outcome", outcome)
    status = F.when(F.col("outcome") == "bad_request", 400).when(F.col("outcome") == "forbidden", 403).when(F.col("outcome") == "not_found", 404).when(F.col("outcome") == "error", 500).otherwise(200)
    return looked.withColumn("error", F.when(F.col("outcome") == "error", F.col("error"))).withColumn("status", status)


def route_requests(requests: DataFrame, assets: DataFrame, variants: DataFrame, cfg: EngineConfig, documents: DataFrame | None = None) -> DataFrame:
    """One ``outcome`` and http ``status`` per request, with ``error`` where there is one.

    In this order: bad_request (a parameter of the wrong type), forbidden (token), not_found (no
    source), original (asked for, or no supported extension), cached (a fresh entry under the
    negotiated format's key, else under the limited one's), error, render. ``variants`` has
    cache_key and cached_at, or is an inventory of ``sources.inventory``. ``documents`` lists
    converted documents (path, cached_at); while one is absent or older than its source the
    cache is not asked. Rows are never dropped; null queries are empty. Requests of one path, query
    and accept go one way, so each distinct one is routed once.
    """
    inventory = variants if "cached" in variants.columns else cache_inventory(variants)
    return per_distinct(requests, ["path", "query", "accept"], lambda d: decide(plan_routes(d, assets, cfg, documents), inventory, cfg))


def stale_index(index: DataFrame, assets: DataFrame) -> DataFrame:
    """Index entries whose source is newer (in whole seconds); those of vanished sources stay out."""
    joined = index.join(assets.select("path", "modified_at"), "path")
    return joined.filter(seconds(F.col("modified_at")) > seconds(F.col("written_at"))).drop("modified_at")
