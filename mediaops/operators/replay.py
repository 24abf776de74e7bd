"""Request logs as of a time: the last change of a path, and requests that repeat an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.plans.routing import seconds

#: Length of a time slice: the rows of a busy path are dealt by (path, slice), not by path alone.
SLICE_SECONDS = 3600


def _slice(at: str, length: int) -> Column:
    return F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / length)


def _carried(rows: DataFrame, by: str) -> DataFrame:
    """``by``, _slice and _last: the latest _last of all earlier slices, for each slice there is that
    has one. Slices are aggregated first, so one key has a row a slice in one task, not all its rows."""
    slices = rows.groupBy(by, "_slice").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("_last", F.max("_last").over(earlier)).filter("_last is not null")


def last_modification(requests: DataFrame, changes: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``changed_at``, the latest change of the path at or before the request's ts. Changes of
    the same instant count as before; a request without ts has none. Both sides are dealt by path
    and time slice; what was last in earlier slices comes along as one more change."""
    left = requests.withColumns({"_at": F.col("ts").cast("timestamp_ntz"), "_last": F.lit(None).cast("timestamp_ntz"), "_kind": F.lit(1)}).withColumn("_slice", _slice("_at", slice_seconds))
    at = F.col("changed_at").cast("timestamp_ntz")
    right = changes.filter("changed_at is not null").select("path", at.alias("_at"), at.alias("_last"), F.lit(0).alias("_kind")).withColumn("_slice", _slice("_at", slice_seconds))
    before = _carried(left.select("path", "_slice", "_last").union(right.select("path", "_slice", "_last")), "path")
    right = right.unionByName(before.select("path", F.col("_last").alias("_at"), "_last", F.lit(0).alias("_kind"), "_slice"))
    both = left.unionByName(right, allowMissingColumns=True)
    upto = Window.partitionBy("path", "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("changed_at", F.last("_last", ignorenulls=True).over(upto)).filter("_kind = 1").drop("_at", "_last", "_kind", "_slice")


def previous_request(requests: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``previous``, the ts of the key's request before this one (by ts, then req_id; null for the
    first). Dealt by cache_key and time slice, so that a popular key is many tasks' work."""
    left = requests.withColumns({"_kind": F.lit(1), "_slice": _slice("ts", slice_seconds), "_last": F.col("ts")})
    before = _carried(left, "cache_key").select("cache_key", "_slice", F.col("_last").alias("ts"), F.lit(0).alias("_kind"))
    both = left.drop("_last").unionByName(before, allowMissingColumns=True)
    order = Window.partitionBy("cache_key", "_slice").orderBy("_kind", "ts", "req_id")
    return both.withColumn("previous", F.lag("ts").over(order)).filter("_kind = 1").drop("_kind", "_slice")


def request_gaps(requests: DataFrame, changes: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Of each request of a log (req_id, ts, path, cache_key) the whole seconds since its key's previous
    request (``since_request``) and since its path's last change (``since_change``), null where there
    was none, and ``changed``: the path changed in a later second than the previous request (null
    without one). Ties go by req_id, changes first. Reuse over any retention follows by a filter."""
    seen = last_modification(previous_request(requests, slice_seconds), changes, slice_seconds)
    whole = lambda c: F.unix_seconds(seconds(F.col(c)).cast("timestamp"))
    later = F.coalesce(seconds(F.col("previous")) < seconds(F.col("changed_at")), F.lit(False))
    gaps = {"since_request": whole("ts") - whole("previous"), "since_change": whole("ts") - whole("changed_at"), "changed": F.when(F.col("previous").isNotNull(), later)}
    return seen.withColumns(gaps).drop("previous")
