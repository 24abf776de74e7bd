"""The bucketed inventory: one lookup for both keys, plans without an exchange on it, pruned batches."""

import re
import uuid

from pyspark.sql import functions as F

from mediaops import fixtures as X
from mediaops import queries as Q
from mediaops.config import EngineConfig
from mediaops.plans import routing as J
from mediaops.session import per_distinct
from mediaops.sources import inventory as V


def entries(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, at string").select("cache_key", F.col("at").cast("timestamp_ntz").alias("cached_at"))


def test_stems_tell_keys_apart(spark):
    keys = ["a/b.webp", "a/b.jpg", "a.b/c", "c", ".c", "a..png", "", None]
    got = {r.k: (r.s, r.f) for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", V.stem_of(F.col("k")).alias("s"), F.substring_index("k", ".", -1).alias("f")).collect()}
    assert all(k is None or s + f == k for k, (s, f) in got.items()) and len(set(got.values())) == len(keys)


def test_both_lookups_in_one(spark):
    """Equal to a lookup of each key, with entries that are repeated, of other formats, or null."""
    cached = entries(spark, [("p/a.webp", "2024-01-01"), ("p/a.webp", "2024-03-01"), ("p/a.jpg", "2024-01-01"), ("p/b.png", "2024-05-01"), ("p/b.tiff", "2024-05-01"), ("c", "2024-01-01"), (None, "2024-01-01")])
    rows = [(i, f"p/{s}.{f}", f"p/{s}.{g}", "2024-02-01" if i % 2 else None) for i, (s, f, g) in enumerate((s, f, g) for s in "abz" for f in ("webp", "jpg", "png") for g in ("jpg", "webp"))]
    planned = spark.createDataFrame(rows, "n int, first_key string, cache_key string, m string").withColumn("modified_at", F.col("m").cast("timestamp_ntz"))
    got = {r.n: (r.first_state, r.cache_state) for r in J.lookup_both(planned, V.cache_inventory(cached)).collect()}
    one = lambda k: {r.n: r.cache_state for r in J.cache_lookup(planned, cached, k).collect()}
    first, last = one("first_key"), one("cache_key")
    assert got == {n: (first[n], last[n]) for n in first} and len(set(got.values())) > 3


def bucketed(spark, n, buckets, tmp_path):
    rows = spark.range(n).select(F.concat(F.lit("k/"), F.col("id").cast("string"), F.lit(".webp")).alias("cache_key"), F.lit("2024-01-01").cast("timestamp_ntz").alias("cached_at"))
    return V.write_inventory(rows, f"inventory_{uuid.uuid4().hex}", buckets, f"file://{tmp_path}/{n}")


def test_no_exchange_stands_on_the_inventory(spark, sf, tmp_path):
    found = Q.join4_route_bucketed(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \S*inventory_", plan)) == 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        kept = spark.createDataFrame([(1, "k/1.webp", "k/1.jpg", None)], "n int, first_key string, cache_key string, modified_at timestamp_ntz")
        lines = J.lookup_both(kept, bucketed(spark, 500, 4, tmp_path))._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    scan = next(i for i, line in enumerate(lines) if "inventory_" in line and "Bucketed: true" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, low = [], depth(lines[scan])
    for line in lines[scan - 1 : join : -1]:
        if depth(line) < low:
            above.append(line)
            low = depth(line)
    assert not any("Exchange" in line for line in above) and any("Exchange" in line for line in lines)


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    table = bucketed(spark, 5000, 64, tmp_path)
    keys = spark.createDataFrame([("k/1.",), ("k/4999.",), ("none",), (None,), ("k/1.",)], "stem string")
    few = V.asked_of(table, keys)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not print the buckets
    try:
        plan = V.asked_of(table, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    chosen = int(re.search(r"SelectedBucketsCount: (\d+) out of 64", plan)[1])
    assert chosen <= 3 and {r.stem for r in few.collect()} == {"k/1.", "k/4999."}
    assert V.asked_of(table, keys, most=2).count() == 5000


def test_inventory_of_another_session(spark, tmp_path):
    table = bucketed(spark, 50, 4, tmp_path)
    again = V.open_inventory(spark, f"again_{uuid.uuid4().hex}", f"file://{tmp_path}/50", 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))


def test_distinct_work_equals_row_work(spark, sf):
    """Null keys, repeated rows and columns that look like keys keep their rows."""
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "a", "x"), (4, None, None), (4, None, None)], "n int, k string, own string")
    got = sorted(map(tuple, per_distinct(rows, ["k", "own"], lambda d: d.withColumn("up", F.upper("k")).withColumn("own", F.concat("own", F.lit("!")))).select("n", "k", "own", "up").collect()), key=str)
    assert got == sorted([(1, "a", "x!", "A"), (2, None, "x!", None), (3, "a", "x!", "A"), (4, None, None, None), (4, None, None, None)], key=str)
    requests, assets, cfg = X.requests(spark, sf), X.assets(spark, sf), EngineConfig(avif_enable=True)
    cached = V.cache_inventory(Q.variants(spark, sf))
    by_row = J.decide(J.plan_routes(requests, assets, cfg), cached, cfg).select("req_id", "path", "outcome", "status", "cache_key")
    assert sorted(map(str, by_row.collect())) == sorted(map(str, J.route_requests(requests, assets, cached, cfg).select("req_id", "path", "outcome", "status", "cache_key").collect()))
