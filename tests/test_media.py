"""Formats, geometry, keys, routing, cache and request logs on small tables."""

import hashlib
import hmac
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mediaops import fixtures as X
from mediaops import queries as Q
from mediaops.config import EngineConfig
from mediaops.functions import formats as M
from mediaops.functions import geometry as G
from mediaops.functions import keys as K
from mediaops.operators import cache as C
from mediaops.operators import replay as R
from mediaops.operators.requests import typed_requests
from mediaops.plans import routing as J
from mediaops.streaming import streams as T

NOON = datetime(2024, 5, 1, 12)


def test_extensions(spark):
    rows = spark.createDataFrame([("a/b.tar.PNG",), (".hidden",), ("a.b/c",), ("x.",), ("ü.jpg",), (None,)], "p string")
    got = [tuple(r) for r in rows.select(M.file_extension(F.col("p")), M.file_stem(F.col("p"))).collect()]
    assert got == [("png", "b.tar"), (None, ".hidden"), (None, "c"), (None, "x"), ("jpg", "ü"), (None, None)]


def test_negotiation(spark):
    rows = spark.createDataFrame([("auto", "image/avif,image/webp"), ("auto", "image/webp"), ("auto", "IMAGE/WEBP"), ("auto", None), ("auto", "é"), ("png", None)], "f string, a string")
    on = [r[0] for r in rows.select(M.negotiate_format(F.col("f"), F.col("a"), True)).collect()]
    off = [r[0] for r in rows.select(M.negotiate_format(F.col("f"), F.col("a"), False)).collect()]
    assert on == ["avif", "webp", "jpg", "webp", "webp", "png"] and off == ["webp", "webp", "jpg", "webp", "webp", "png"]


def test_limits(spark):
    rows = spark.createDataFrame([("webp", False, 16384, 10, True), ("webp", False, 20000, 10, True), ("webp", True, 20000, 10, True), ("webp", False, 16000, 16000, False), ("avif", False, 16385, 1, True), ("png", True, 1, 16385, False), ("jpg", False, 99999, 1, False), ("webp", False, None, None, None)], "f string, e boolean, w int, h int, a boolean")
    got = [tuple(r[0]) for r in rows.select(M.enforce_limits(*map(F.col, "fewha"))).collect()]
    assert got == [("png", None), ("jpg", None), (None, "too_large"), ("jpg", None), ("jpg", None), (None, "too_large"), ("jpg", None), ("webp", None)]


def test_quality(spark):
    rows = spark.createDataFrame([("avif", 500, 500), ("webp", 500, 500), ("jpg", 500, 500), ("avif", 4000, 4000), ("webp", 4000, 4000), ("jpg", 4000, 4000), ("png", 1, 1)], "f string, w int, h int")
    assert [r[0] for r in rows.select(M.default_quality(*map(F.col, "fwh"))).collect()] == [59, 78, 75, 40, 16, 40, 78]


def test_geometry(spark):
    rows = spark.createDataFrame([(100, None, 0), (None, 50, 0), (None, None, 0), (100, None, 90), (100, 100, 90), (9000, 9000, 0)], "w int, h int, r int").select("*", F.lit(400).alias("sw"), F.lit(200).alias("sh"))
    boxed = rows.select("*", G.pipeline_dims(*map(F.col, ("w", "h", "r", "sw", "sh"))).alias("box"))
    out = boxed.select("box", G.output_dims(F.col("box"), F.col("w").isNotNull() | F.col("h").isNotNull(), F.col("r"), F.col("sw"), F.col("sh")).alias("o")).collect()
    assert [tuple(r.box) for r in out] == [(100, 50), (100, 50), (400, 200), (200, 100), (100, 100), (9000, 9000)]
    assert [tuple(r.o) for r in out] == [(100, 50), (100, 50), (400, 200), (100, 200), (100, 100), (400, 200)]


def test_hmac_matches_python(spark):
    for key in ("short", "k" * 100):
        got = spark.range(1).select(K.hmac_sha256(F.lit("data/a.jpg?h=1&w=2"), key)).first()[0]
        assert got == hmac.new(key.encode(), b"data/a.jpg?h=1&w=2", hashlib.sha256).hexdigest()


def test_specs_and_keys(spark):
    req = spark.createDataFrame([(1, "a.jpg", "w=100&dpr=2"), (2, "a.jpg", "w=200"), (3, "a.jpg", "w=200&rot=left"), (4, "b.jpg", "w=200")], "req_id long, path string, query string")
    keys = [r[0] for r in typed_requests(req).orderBy("req_id").select(K.cache_key(K.params_hash(F.col("spec")), F.col("path"), F.lit("webp"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def requests(spark, rows):
    return spark.createDataFrame([(i, NOON + timedelta(minutes=i), p, q, None) for i, (p, q) in enumerate(rows)], "req_id long, ts timestamp_ntz, path string, query string, accept string")


def assets(spark, rows):
    return spark.createDataFrame([(p, w, h, True, 3, 10, NOON) for p, w, h in rows], "path string, width int, height int, has_alpha boolean, n_pages int, length long, modified_at timestamp_ntz")


def test_routing_order(spark):
    req = requests(spark, [("a.png", "w=x"), ("gone.png", ""), ("a.png", "original=true"), ("a.txt", ""), ("a.png", "w=10"), ("a.png", "w=20"), ("big.png", "f=webp"), ("a.png", "f=pdf"), ("a.png", "w=0"), ("a.docx", "w=10")])
    have = assets(spark, [("a.png", 100, 50), ("a.txt", None, None), ("big.png", 20000, 10), ("a.docx", 100, 100)])
    first = J.route_requests(req, have, spark.createDataFrame([], "cache_key string, cached_at timestamp_ntz"), EngineConfig())
    key = {r.req_id: r.cache_key for r in first.collect()}
    cached = spark.createDataFrame([(key[4], NOON), (key[5], NOON - timedelta(seconds=1)), (key[9], NOON)], "cache_key string, cached_at timestamp_ntz")
    out = {r.req_id: (r.outcome, r.status, r.error) for r in J.route_requests(req, have, cached, EngineConfig()).collect()}
    assert out == {
        0: ("bad_request", 400, None), 1: ("not_found", 404, None), 2: ("original", 200, None), 3: ("original", 200, None), 4: ("cached", 200, None), 5: ("render", 200, None), 6: ("error", 500, "too_large"), 7: ("error", 500, "pdf_not_available"), 8: ("error", 500, "invalid_dimension"), 9: ("render", 200, None),
    }
    locked = J.route_requests(req, have, cached, EngineConfig(key="k"))
    assert {r.outcome for r in locked.collect()} == {"bad_request", "forbidden"}


def test_pages_are_limited_as_loaded(spark):
    """A page of 20,000 pixels is loaded at the size asked for, so webp takes it; a PNG of that size not."""
    req = requests(spark, [("a.pdf", "w=300"), ("a.docx", "w=300&rot=left"), ("a.png", "w=300"), ("a.pdf", "")])
    have = assets(spark, [("a.pdf", 20000, 10000), ("a.docx", 20000, 10000), ("a.png", 20000, 10000)])
    none = spark.createDataFrame([], "cache_key string, cached_at timestamp_ntz")
    plan = {r.path + str(r.req_id): r for r in J.route_requests(req, have, none, EngineConfig()).collect()}
    assert [(k, r.output_format, tuple(r.loaded), tuple(r.out)) for k, r in sorted(plan.items())] == [
        ("a.docx1", "webp", (152, 300), (300, 152)), ("a.pdf0", "webp", (300, 150), (300, 150)), ("a.pdf3", "jpg", (20000, 10000), (20000, 10000)), ("a.png2", "jpg", (20000, 10000), (300, 150)),
    ]
    assert {r.path: r.load for r in C.render_plan(J.route_requests(req.filter("req_id < 3"), have, none, EngineConfig())).collect()}["a.pdf"] is not None


def test_photos_are_planned_upright(spark):
    have = assets(spark, [("a.jpg", 400, 200)]).withColumn("orientation", F.lit(6))
    r = J.plan_requests(J.attach_assets(typed_requests(requests(spark, [("a.jpg", "w=100")])), have), EngineConfig()).first()
    assert tuple(r.loaded) == (200, 400) and tuple(r.box) == (100, 200) and tuple(r.out) == (100, 200)


def test_bust_is_gated(spark):
    inventory = spark.createDataFrame([("k1", "s1", 2048), ("k2", "s2", 1)], "cache_key string, stem string, length long")
    index = spark.createDataFrame([("s1", "a.png", NOON - timedelta(hours=1)), ("s2", "b.png", NOON)], "stem string, path string, written_at timestamp_ntz")
    have = assets(spark, [("a.png", 1, 1), ("b.png", 1, 1)])
    gone = lambda gb: {r.cache_key for r in C.bust_cache(inventory, index, have, EngineConfig(cache_capacity_gb=gb)).filter("removed").collect()}
    assert C.cache_usage(inventory).first().size_kib == 3
    assert gone(0.000001) == {"k1"} and gone(1.0) == set()


def test_gaps_equal_row_by_row(spark, sf):
    rows = Q.keyed_requests(spark, sf).orderBy("ts", "req_id").collect()
    changes = sorted((r.changed_at, r.path) for r in X.changes(spark, sf).collect())
    second = lambda t: None if t is None else t.replace(microsecond=0)
    gap = lambda a, b: None if b is None else int((second(a) - second(b)).total_seconds())
    expect, seen, at, changed = {}, {}, 0, {}
    for r in rows:
        while at < len(changes) and changes[at][0] <= r.ts:
            changed[changes[at][1]] = changes[at][0]
            at += 1
        before, last = seen.get(r.cache_key), changed.get(r.path)
        expect[r.req_id] = gap(r.ts, before), gap(r.ts, last), None if before is None else last is not None and second(before) < second(last)
        seen[r.cache_key] = r.ts
    run = lambda **more: {r.req_id: (r.since_request, r.since_change, r.changed) for r in R.request_gaps(Q.keyed_requests(spark, sf), X.changes(spark, sf), **more).collect()}
    assert run() == expect and {c for _, _, c in expect.values()} == {None, True, False}
    assert run(slice_seconds=200 * 86400) == expect


def test_slices_change_nothing(spark):
    """Ties, nulls and changes many slices ago give the same for every length of a slice."""
    at = [NOON + timedelta(seconds=s) for s in (0, 0, 5, 61, 4000, 90000)]
    requests = spark.createDataFrame([(n, t, "p" if n % 2 else "q", "k", "own") for n, t in enumerate(at)] + [(7, None, "p", "k", "own"), (8, NOON, None, None, "own")], "req_id long, ts timestamp_ntz, path string, cache_key string, _own string")
    changes = spark.createDataFrame([("p", NOON), ("p", NOON), ("q", NOON - timedelta(days=9)), ("q", None), ("q", NOON + timedelta(seconds=4000)), ("z", NOON)], "path string, changed_at timestamp_ntz")
    expect = {0: (NOON - timedelta(days=9), None), 1: (NOON, at[0]), 2: (NOON - timedelta(days=9), at[1]), 3: (NOON, at[2]), 4: (at[4], at[3]), 5: (NOON, at[4]), 7: (None, None), 8: (None, None)}
    for length in (1, 60, 3600, 10**7):
        got = R.previous_request(R.last_modification(requests, changes, length), length)
        assert {r.req_id: (r.changed_at, r.previous) for r in got.collect()} == expect
        assert got.columns == [*requests.columns, "changed_at", "previous"]
    empty = requests.limit(0)
    assert R.request_gaps(empty, changes).count() == 0
    assert {r.changed for r in R.request_gaps(requests, changes.limit(0)).collect()} == {None, False}


def batches(spark, folder, rows, schema, make):
    """Rows of each batch put into a folder in turn, and what the stream has given after each."""
    out = []
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
        out.append(sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()), key=str))
    return out


def test_stream_gives_keys_once_a_retention(spark, tmp_path):
    """A key comes back with its first request a retention or more after the one given, in the same batch or
    a later one, and not before; rows without key or time, repeated rows and late rows give nothing."""
    hour = lambda n: NOON + timedelta(hours=n)
    rows = [
        [("a", hour(1)), ("a", hour(0)), ("a", hour(0)), ("b", hour(0)), (None, hour(0)), ("b", None)], [("a", hour(20)), ("c", hour(60)), ("a", hour(24)), ("a", hour(47)), ("a", hour(49))],
        [], [("d", hour(61)), ("c", hour(59))], [("a", hour(72)), ("c", hour(84)), ("b", hour(83)), ("d", hour(84))], [("d", hour(85)), ("a", hour(73))],
    ]
    for n, schema in enumerate(("cache_key string, ts timestamp_ntz", "cache_key string, ts timestamp_ntz, path string")):
        mine = [[(*r, "p")[: 2 + n] for r in batch] for batch in rows]
        got = batches(spark, tmp_path / str(n), mine, schema, lambda s: T.stream_first_requests(s, EngineConfig(retention="24 hours")))
        given = [("a", 0), ("b", 0)], [("a", 24), ("a", 49), ("c", 60)], [], [("d", 61)], [("b", 83), ("c", 84)], [("a", 73), ("d", 85)]
        want = [sorted(r for part in given[: k + 1] for r in part) for k in range(len(given))]
        assert [sorted((k, int((t - NOON).total_seconds() // 3600)) for k, t in b) for b in got] == want


def test_stream_gaps_over_batches(spark, tmp_path):
    """Changes and requests of earlier batches count; keys unused for the retention do not."""
    hour = lambda n: NOON + timedelta(hours=n)
    ask = lambda n, h, key="k", path="p": (path, hour(h), n, key)
    rows = [[ask(1, 0), ask(2, 1), ask(3, 1, "m")], [("p", hour(2), None, None), ask(4, 2), ask(5, 3)], [ask(6, 4, "m"), ask(7, 27)], [ask(8, 52), ask(9, 60, "m"), ask(10, 60, "x", None)], [ask(11, 61, "x", None), ask(12, 62)]]
    got = batches(spark, tmp_path, rows, "path string, ts timestamp_ntz, req_id long, cache_key string", lambda s: T.stream_request_gaps(s, "24 hours"))
    none, h = (None, None), 3600
    assert {n: r for n, _, *r in got[-1]} == {1: [*none], 2: [h, False], 3: [*none], 4: [h, True], 5: [h, False], 6: [3 * h, True], 7: [24 * h, False], 8: [*none], 9: [*none], 10: [*none], 11: [h, False], 12: [10 * h, False]}
    assert [len(b) for b in got] == [3, 5, 7, 10, 12]


def test_joins_plan_without_python(spark, sf):
    plan = J.attach_assets(X.requests(spark, sf), X.assets(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
