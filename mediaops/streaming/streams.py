"""The request operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediaops.config import EngineConfig
from mediaops.functions.formats import file_stem
from mediaops.operators.pixels import render_variants
from mediaops.plans.routing import plan_routes, route_requests, seconds
from mediaops.session import with_workers
from mediaops.sources.files import relative_path
from mediaops.sources.inventory import asked_of, stem_of


def stream_route(requests: DataFrame, assets: DataFrame, variants: Callable[[], DataFrame] | DataFrame, cfg: EngineConfig, out: str, checkpoint: str, documents: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Route every micro-batch of a request stream and write it under ``out``/batch=N: a batch that is
    run again replaces its own rows. ``variants`` may be a function that gives the cache as it
    stands at each batch.

    With an inventory (``sources.inventory.write_inventory``) a batch reads only the buckets that its
    keys lie in, so its cost does not grow with the cache."""

    def route(batch: DataFrame, n: int) -> None:
        now = variants() if callable(variants) else variants
        if "cached" in now.columns:
            keys = ["path", "query", "accept"]
            planned = plan_routes(batch.select(*keys).distinct(), assets, cfg, documents).select(stem_of(F.col("cache_key")).alias("stem"))
            now = asked_of(now, planned)
        route_requests(batch, assets, now, cfg, documents).select("req_id", "path", "cache_key", "output_format", "outcome", "status", "error").write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = requests.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_first_requests(planned: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Each cache_key once per retention time: at its first request, then at the first one that comes
    ``retention`` or more after the one given last (cache_key, ts).

    The answer does not depend on how the rows are cut into batches, as long as batches follow in
    time; a row that comes in a later batch than later rows of its key is taken up as it comes.
    State is grouped by path where there is one, else by key, and holds the time each key was given
    last; keys that no row within the watermark can still repeat are dropped, and so is a path
    without keys. Rows without a key or a time are left out.
    """
    with_workers(planned.sparkSession)
    keep = int(pd.Timedelta(cfg.retention).total_seconds() * 10**6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last = dict(zip(*held.get, strict=True)) if held.exists else {}
        rows, given = pd.concat(list(frames), ignore_index=True).sort_values("at"), []
        for k, at in rows.groupby("cache_key")["at"]:
            at = at.to_numpy()
            n = at.searchsorted(last[k] + keep) if k in last else 0
            while n < len(at):  # one step for each time the key is given, not for each row
                last[k] = int(at[n])
                given.append((k, last[k]))
                n = at.searchsorted(last[k] + keep)
        floor = held.getCurrentWatermarkMs() * 1000
        last = {k: t for k, t in last.items() if t + keep > floor}
        held.update((list(last), list(last.values())))
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, *((t + keep) // 1000 + 1 for t in last.values())))
        if given:
            yield pd.DataFrame(given, columns=["cache_key", "at"])

    group = "path" if "path" in planned.columns else "cache_key"
    timed = planned.select(F.col(group).alias("_group"), "cache_key", F.col("ts").cast("timestamp").alias("ts")).filter("cache_key is not null and ts is not null")
    timed = timed.withColumn("at", F.unix_micros("ts")).withWatermark("ts", cfg.retention)
    found = timed.groupBy("_group").applyInPandasWithState(step, "cache_key string, at long", "keys array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("cache_key", F.timestamp_micros("at").alias("ts"))


def stream_request_gaps(events: DataFrame, retention: str = "7 days") -> DataFrame:
    """Of each request of a stream the whole seconds since its key's previous one, if that was at most
    ``retention`` before it (else null), and whether its path has changed in a later second than that
    (null without one): req_id, cache_key, since_request, changed.

    ``events``: path, ts and either req_id and cache_key of a request, or nulls there for a change
    of the path. Rows of one batch are taken by time, changes first, then req_id, whatever files
    they came in. The state of a path is its last change and the last request of each key; keys that
    the watermark has left behind by ``retention`` are dropped, and a path without keys is forgotten.
    Rows later than the watermark are dropped by it; earlier rows that come in a later batch are
    answered by the state as it stands.
    """
    with_workers(events.sparkSession)
    out, state = "req_id long, cache_key string, since_request long, changed boolean", "changed long, keys array<string>, times array<long>"
    keep = int(pd.Timedelta(retention).total_seconds())

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        changed, keys, times = held.get if held.exists else (None, [], [])
        rows = pd.concat(list(frames), ignore_index=True)
        rows["at"] = [int(t.timestamp()) for t in rows["ts"]]
        rows["is_change"] = rows["req_id"].isna()
        rows = rows.sort_values(["ts", "is_change", "req_id"], ascending=[True, False, True])
        changes = rows["at"].where(rows["is_change"]).cummax().ffill()
        rows["changed"] = changes if changed is None else changes.fillna(changed).clip(lower=changed)
        asked = rows[~rows["is_change"]]
        before = asked.groupby("cache_key", dropna=False)["at"].shift()
        last = dict(zip(keys, times, strict=True))
        before = before.fillna(asked["cache_key"].map(last).astype("float64"))
        gap = asked["at"] - before
        gap = gap.where(gap <= keep)
        ends, floor = rows["changed"].iloc[-1], held.getCurrentWatermarkMs() // 1000 - keep
        last |= {k: int(t) for k, t in asked.groupby("cache_key")["at"].last().items()}
        last = {k: t for k, t in last.items() if t >= floor}
        held.update((None if pd.isna(ends) else int(ends), list(last), list(last.values())))
        latest = max([int(rows["at"].max()), *last.values()])
        held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, (latest + 1 + keep) * 1000))
        changed_since = (before < asked["changed"]).astype("boolean").where(gap.notna())
        yield pd.DataFrame({"req_id": asked["req_id"].astype("int64"), "cache_key": asked["cache_key"], "since_request": gap.astype("Int64"), "changed": changed_since})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", retention)
    return timed.groupBy("path").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def asset_stream(spark: SparkSession, root: str) -> DataFrame:
    """Files as they arrive: path (below the root, as scan_assets has it), modified_at, length. Spark
    remembers the paths it has seen: files that are overwritten or deleted are seen by
    ``sources.listing.asset_changes`` only."""
    df = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return df.select(relative_path(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified_at"), "length")


def stream_invalidate(assets: DataFrame, variants: DataFrame) -> DataFrame:
    """The renditions that a changed source makes stale, as the change arrives; both sides have paths
    below the data root. With a ``change`` column (``asset_changes``), which stays, a deleted source
    makes all its renditions stale, whenever they were made."""
    columns = ["path", "modified_at", *(["change"] if "change" in assets.columns else [])]
    stale = seconds(F.col("cached_at")) < seconds(F.col("modified_at"))
    if "change" in columns:
        stale = stale | (F.col("change") == "deleted")
    return assets.select(*columns).join(variants, "path").filter(stale).withColumn("stem", file_stem(F.col("cache_key")))


def stream_render(plans: DataFrame, images: DataFrame, out: str, index: str, checkpoint: str, once: bool = False, retention: str = "7 days") -> StreamingQuery:
    """Render new plans per micro-batch into ``out``/batch=N, with an index row in ``index``/batch=N for
    each rendition that was made; rows with an error stay among the renditions.

    State holds each key that was met for ``retention`` of event time (``ts`` of the plans; where there
    is none, the time of the batch), so a batch never reads what earlier ones have written. A key
    whose source is missing is reported once in that time, and rendered when its source is there.
    A batch that is run again replaces its own rows of both tables, so a crash between the two writes
    loses and repeats nothing. Images may be added while the stream runs if ``images`` is a table
    that lists its files anew."""
    timed = plans.withColumn("ts", F.col("ts").cast("timestamp") if "ts" in plans.columns else F.current_timestamp()).withWatermark("ts", retention)
    there = images.select("path").distinct().withColumn("_there", F.lit(True))
    fresh = timed.join(there, "path", "left").withColumn("_there", F.coalesce("_there", F.lit(False))).dropDuplicatesWithinWatermark(["cache_key", "_there"])

    def render(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        plan = batch.drop("_there", *([] if "ts" in plans.columns else ["ts"]))
        made = render_variants(plan, images).withColumns({"cached_at": F.current_timestamp(), "stem": file_stem(F.col("cache_key"))})
        made.write.mode("overwrite").parquet(f"{out}/batch={n}")
        again = spark.read.schema(made.schema).parquet(f"{out}/batch={n}").filter("error is null")
        again.select("stem", "cache_key", "path", F.col("cached_at").alias("written_at")).write.mode("overwrite").parquet(f"{index}/batch={n}")

    writer = fresh.writeStream.foreachBatch(render).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
