"""Registered queries of the request, cache and image operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops import fixtures as X
from mediaops import oracle as O
from mediaops.config import EngineConfig
from mediaops.functions import formats as M
from mediaops.functions import geometry as G
from mediaops.functions import keys as K
from mediaops.functions import parsing as P
from mediaops.operators import cache as C
from mediaops.operators import pixels as I
from mediaops.operators import replay as R
from mediaops.operators import requests as Q
from mediaops.operators import signing as S
from mediaops.plans import routing as J
from mediaops.session import bound, cut, per_distinct, shared_path
from mediaops.sources import files as S_FILES
from mediaops.sources import listing as L
from mediaops.sources import store
from mediaops.sources.inventory import OUTPUTS, write_inventory
from mediaops.sources.logs import parse_access_log
from mediaops.sources.sinks import write_cache_index, write_variants
from mediaops.streaming import streams as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _flat(name: str, fields: str) -> list[Column]:
    return [F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in fields.split()]


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.typed_requests(X.requests(spark, sf_dir))


# --- parsing ---------------------------------------------------------------------------------


@query("""
SELECT page_id, regexp_replace(url_decode(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*|[?].*$', '', 'g')), '^/+', '') AS path,
  array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1), '&'), lambda p: p <> ''), lambda p: url_decode(replace(p, '+', ' ')))), '&') AS params
FROM pages""")
def req1_split_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = Q.split_request(pages, "url")
    return out.select("page_id", "path", F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&").alias("params"))


@query(O.RAW + " SELECT req_id, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(q AS INTEGER) AS q, CAST(dpr AS DOUBLE) AS dpr, original, crop_t AS crop, thumb_t AS thumb, rot_t AS rot, bg_t AS bg, f_t AS f, bad FROM typed")
def req2_parse_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("req_id", "raw.*").drop("token").withColumn("dpr", F.col("dpr").cast("double"))


@query(O.RAW + " SELECT req_id, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height FROM spec")
def req3_scale_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("req_id", "spec.width", "spec.height")


@query(O.RAW + " SELECT format, count(*) AS n FROM spec GROUP BY format")
def req4_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).groupBy(F.col("spec.format").alias("format")).agg(F.count("*").alias("n"))


@query(O.RAW + " SELECT rotate, count(*) AS n FROM spec GROUP BY rotate")
def req5_parse_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).groupBy(F.col("spec.rotate").alias("rotate")).agg(F.count("*").alias("n"))


#: Parameter texts made of event ids, more varied than those of the requests.
VARIED = {
    "bg": ["white", "black", "transparent", "1,2,3", "1,2,3,4", "1,2", "256,0,0", "ffffff", "12345678", "+f00+1", "#fff000", "12345", "red", ""],
    "ratio": ["video", "square", "free", "16:9", "4:3:2", "x:1", "300:1", "1", ""],
    "gravity": ["top", "left-top", "center-right", "bottom", "nowhere", "right-bottom", ""],
    "side": ["0", "100", "+20", "70000", "x", "-5", ""],
    "thumb": ["p:2", "p:0", "p:x,p:7", "q:3", "p:4:9", "p", "", "p:4294967296"],
}


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda name, n: F.get(F.array(*map(F.lit, VARIED[name])), (n % len(VARIED[name])).cast("int"))
    crop = F.concat_ws(",", pick("ratio", e), pick("side", e + 1), pick("side", F.floor(e / 7)), pick("gravity", e), pick("side", F.floor(e / 3)), pick("side", F.floor(e / 5)))
    crop = F.when(e % 11 == 0, pick("ratio", e)).otherwise(crop)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", pick("bg", e).alias("bg"), crop.alias("crop"), pick("gravity", e).alias("gravity"), pick("thumb", e).alias("thumb"))


def _sql_pick(name: str, n: str) -> str:
    return O._list(VARIED[name]) + f"[CAST({n} AS BIGINT) % {len(VARIED[name])} + 1]"


VARIED_SQL = f"""WITH varied AS (SELECT event_id, {_sql_pick('bg', 'event_id')} AS bg, {_sql_pick('gravity', 'event_id')} AS gravity, {_sql_pick('thumb', 'event_id')} AS thumb,
  CASE WHEN event_id % 11 = 0 THEN {_sql_pick('ratio', 'event_id')} ELSE concat_ws(',', {_sql_pick('ratio', 'event_id')}, {_sql_pick('side', '(event_id + 1)')}, {_sql_pick('side', '(event_id // 7)')},
    {_sql_pick('gravity', 'event_id')}, {_sql_pick('side', '(event_id // 3)')}, {_sql_pick('side', '(event_id // 5)')}) END AS crop FROM events)"""


@query(VARIED_SQL + f", b AS (SELECT event_id, bg, {O.background('bg')} AS c FROM varied) SELECT event_id, bg, c.r AS c_r, c.g AS c_g, c.b AS c_b, c.a AS c_a FROM b")
def req6_parse_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied(spark, sf_dir).withColumn("c", P.parse_background(F.col("bg"))).select("event_id", "bg", *_flat("c", "r g b a"))


@query(
    VARIED_SQL + f", b AS (SELECT event_id, {O.background('bg')} AS c FROM varied) SELECT event_id, CAST(c.r AS DOUBLE) AS v1, CAST(c.g AS DOUBLE) AS v2, CAST(c.b AS DOUBLE) AS v3, CAST(c.a AS DOUBLE) AS v4, "
    "CAST(CASE WHEN c IS NULL THEN 0 ELSE 3 END AS INTEGER) AS n_flat, coalesce(c.a = 0, false) AS transparent FROM b"
)
def req7_background_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.parse_background(F.col("bg"))
    v = P.background_vector(c)
    return varied(spark, sf_dir).select("event_id", *[F.get(v, F.lit(i)).alias(f"v{i + 1}") for i in range(4)], F.size(P.flatten_colour(c)).alias("n_flat"), P.is_transparent(c).alias("transparent"))


@query(VARIED_SQL + f", b AS (SELECT event_id, crop, {O.crop('crop')} AS c FROM varied) SELECT event_id, crop, c.kind AS kind, c.rw AS rw, c.rh AS rh, c.width AS width, c.height AS height, c.gravity AS gravity, c.dx AS dx, c.dy AS dy FROM b")
def req8_parse_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = varied(spark, sf_dir).withColumn("c", P.parse_crop(F.col("crop")))
    return df.select("event_id", "crop", F.col("c.ratio.kind").alias("kind"), *[F.col(f"c.ratio.{x}").cast("long").alias(f"r{x}") for x in "wh"], *[F.col(f"c.{x}").cast("long").alias(x) for x in ("width", "height")], "c.gravity", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("dx", "dy")])


@query(VARIED_SQL + f" SELECT {O.lookup(O.ORIGINS, 'gravity', 'center')} AS origin, count(*) AS n FROM varied GROUP BY 1")
def req9_parse_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied(spark, sf_dir).groupBy(P.parse_origin(F.col("gravity")).alias("origin")).agg(F.count("*").alias("n"))


@query(VARIED_SQL + f" SELECT event_id, thumb, {O.thumb('thumb')} AS page FROM varied")
def req10_parse_thumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied(spark, sf_dir).select("event_id", "thumb", P.parse_thumb(F.col("thumb")).alias("page"))


@query(O.RAW + f", s AS (SELECT req_id, path, bad, {O.CANONICAL} AS spec FROM spec) SELECT * FROM s")
def req11_build_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("req_id", "path", F.col("raw.bad").alias("bad"), K.canonical_params(F.col("spec")).alias("spec"))


# --- formats and geometry ----------------------------------------------------------------------


@query(O.REQUESTS + f" SELECT path, {O.EXT} AS ext, {O.STEM} AS stem, count(*) AS n FROM requests GROUP BY path")
def fmt1_file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return X.requests(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n")).select("path", M.file_extension(path).alias("ext"), M.file_stem(path).alias("stem"), "n")


@query(
    O.REQUESTS + f", e AS (SELECT DISTINCT path, coalesce({O.EXT}, '') AS ext FROM requests) SELECT path, ext IN {O.any_of([*O.RASTER, *O.DOCUMENTS, 'pdf'])} AS supported, ext IN {O.any_of([*O.DOCUMENTS, 'pdf'])} AS paged, "
    f"ext IN {O.any_of(O.DOCUMENTS)} AS convertible, ext = 'svg' AS svg, ext NOT IN {O.any_of(O.OPAQUE)} AS transparent FROM e"
)
def fmt2_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.requests(spark, sf_dir).select("path").distinct().withColumn("k", M.classify(F.col("path"))).select("path", "k.*")


@query(O.RAW + " SELECT req_id, CASE WHEN format <> 'auto' THEN format WHEN accept IS NULL THEN 'webp' WHEN contains(accept, 'image/avif') THEN 'avif' WHEN contains(accept, 'image/webp') THEN 'webp' ELSE 'jpg' END AS negotiated FROM spec")
def fmt3_negotiate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("req_id", M.negotiate_format(F.col("spec.format"), F.col("accept"), True).alias("negotiated"))


def planned(spark: SparkSession, sf_dir: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    plan = lambda d: J.plan_requests(J.attach_assets(Q.typed_requests(d), X.assets(spark, sf_dir)), cfg)
    return per_distinct(X.requests(spark, sf_dir), ["path", "query", "accept"], plan)


@query(O.PLANNED + " SELECT req_id, negotiated, output_format, limit_error FROM keyed")
def fmt4_enforce_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select("req_id", "negotiated", "output_format", F.col("limited.error").alias("limit_error"))


QUALITY_SQL = """CASE fmt WHEN 'png' THEN 78 WHEN 'avif' THEN CAST(floor(room * 19.0 / 7.75 + 40.0) AS INTEGER) WHEN 'webp' THEN CAST(floor(room * 62.0 / 7.75 + 16.0) AS INTEGER) WHEN 'jpg' THEN CAST(floor(room * 35.0 / 7.75 + 40.0) AS INTEGER) END"""
ROOM_SQL = "least(greatest(8.0::DOUBLE - CAST(w AS DOUBLE) * CAST(h AS DOUBLE) / 1e6::DOUBLE, 0.0::DOUBLE), 7.75::DOUBLE)"


@query(
    O.PLANNED + f", sz AS (SELECT *, output_format AS fmt, ow AS w, oh AS h FROM keyed), rm AS (SELECT *, {ROOM_SQL} AS room FROM sz), ql AS (SELECT *, CAST(coalesce(quality, {QUALITY_SQL}) AS INTEGER) AS use_quality FROM rm) "
    "SELECT req_id, CASE WHEN fmt IN ('avif', 'webp', 'jpg', 'png') THEN use_quality END AS quality, CASE WHEN fmt = 'png' THEN CASE WHEN use_quality < 90 THEN 0.8::DOUBLE WHEN use_quality >= 90 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END END AS dither, "
    "CAST(CASE WHEN fmt = 'webp' THEN 50 END AS INTEGER) AS alpha_quality, CASE fmt WHEN 'webp' THEN 'smart' WHEN 'avif' THEN 'off' END AS subsampling, "
    "CASE WHEN fmt IN ('avif', 'webp', 'jpg', 'png') THEN CASE WHEN background IS NULL THEN '' ELSE concat_ws(',', CAST(background.r AS VARCHAR), CAST(background.g AS VARCHAR), CAST(background.b AS VARCHAR)) END END AS flatten FROM ql"
)
def fmt5_encode_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.col("spec")
    df = planned(spark, sf_dir).withColumn("e", M.encode_options(spec["quality"], spec["background"], F.col("output_format"), F.col("out.w"), F.col("out.h")))
    return df.select("req_id", "e.quality", "e.dither", "e.alpha_quality", "e.subsampling", F.array_join(F.transform("e.flatten", lambda x: x.cast("int").cast("string")), ",").alias("flatten"))


SIZES_SQL = "WITH s AS (SELECT event_id, CAST(1 + event_id * 37 % 6000 AS INTEGER) AS w, CAST(1 + event_id * 53 % 4000 AS INTEGER) AS h, ['avif', 'webp', 'jpg', 'png'][event_id % 4 + 1] AS fmt FROM events)"


@query(SIZES_SQL + f", r AS (SELECT *, {ROOM_SQL} AS room FROM s) SELECT event_id, fmt, CAST({QUALITY_SQL} AS INTEGER) AS quality FROM r")
def fmt6_default_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (1 + e * 37 % 6000).cast("int").alias("w"), (1 + e * 53 % 4000).cast("int").alias("h"), F.get(F.array(*map(F.lit, ["avif", "webp", "jpg", "png"])), (e % 4).cast("int")).alias("fmt"))
    return df.select("event_id", "fmt", M.default_quality(F.col("fmt"), F.col("w"), F.col("h")).alias("quality"))


def _dims(spark: SparkSession, sf_dir: str, dims, size=None) -> DataFrame:
    """Sizes of requests whose source exists; the functions take the source's upright sides."""
    df = J.attach_assets(typed(spark, sf_dir), X.assets(spark, sf_dir)).filter("exists")
    df = bound(df, src=J.upright(F.col("orientation"), F.col("width"), F.col("height")))
    df = df if size is None else bound(df, size=size(F.col("src.w"), F.col("src.h")))
    return bound(df, d=dims(F.col("src.w"), F.col("src.h"))).select("req_id", F.col("d.w").cast("long").alias("w"), F.col("d.h").cast("long").alias("h"))


@query(O.PLANNED + " SELECT req_id, CAST(tw AS BIGINT) AS w, CAST(th AS BIGINT) AS h FROM sized WHERE found")
def geo1_target_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dims(spark, sf_dir, lambda w, h: G.target_dims(F.col("spec.width"), F.col("spec.height"), w, h))


@query(O.PLANNED + " SELECT req_id, CAST(pw AS BIGINT) AS w, CAST(ph AS BIGINT) AS h FROM sized WHERE found")
def geo2_pipeline_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dims(spark, sf_dir, lambda w, h: G.pipeline_dims(F.col("spec.width"), F.col("spec.height"), F.col("spec.rotate"), w, h))


@query(
    O.PLANNED + " SELECT req_id, CASE WHEN rotate NOT IN (90, 270) THEN CAST(tw AS BIGINT) WHEN tw > th THEN CAST(th + 2 AS BIGINT) ELSE CAST(floor(sw * (CAST(tw AS DOUBLE) / sh) + 0.5) AS BIGINT) END AS w, "
    "CASE WHEN rotate NOT IN (90, 270) THEN CAST(th AS BIGINT) WHEN tw > th THEN CAST(floor(sh * (CAST(tw AS DOUBLE) / sh) + 0.5) AS BIGINT) ELSE CAST(tw + 2 AS BIGINT) END AS h FROM sized WHERE found"
)
def geo3_rasterize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda w, h: G.target_dims(F.col("spec.width"), F.col("spec.height"), w, h)
    return _dims(spark, sf_dir, lambda w, h: G.rasterize_dims(F.col("size"), F.col("spec.rotate"), w, h), size)


@query(O.PLANNED + " SELECT req_id, CAST(CASE WHEN rotate IN (90, 270) THEN own_h ELSE own_w END AS BIGINT) AS w, CAST(CASE WHEN rotate IN (90, 270) THEN own_w ELSE own_h END AS BIGINT) AS h FROM loads WHERE found")
def geo4_output_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    resize = F.col("spec.width").isNotNull() | F.col("spec.height").isNotNull()
    box = lambda w, h: G.pipeline_dims(F.col("spec.width"), F.col("spec.height"), F.col("spec.rotate"), w, h)
    return _dims(spark, sf_dir, lambda w, h: G.output_dims(F.col("size"), resize, F.col("spec.rotate"), w, h), box)


@query(O.PLANNED + " SELECT req_id, least(page - 1, n_pages - 1) AS page FROM attached WHERE found")
def geo5_clamp_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = J.attach_assets(typed(spark, sf_dir), X.assets(spark, sf_dir)).filter("exists")
    return df.select("req_id", G.clamp_page(F.col("spec.page"), F.col("n_pages")).alias("page"))


# --- keys and signatures -------------------------------------------------------------------------


@query(O.PLANNED + " SELECT req_id, cache_key FROM keyed")
def key1_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select("req_id", "cache_key")


@query(O.REQUESTS + f" SELECT DISTINCT path, 'pdf/' || sha256(path) || '/' || {O.STEM} || '.pdf' AS document_key FROM requests")
def key2_document_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.requests(spark, sf_dir).select("path").distinct().select("path", K.document_key(F.col("path")).alias("document_key"))


CANONICAL_QUERY_SQL = O.REQUESTS + """, canon AS (SELECT req_id, path || '?' || array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''),
  lambda p: {'k': string_split(p, '=')[1], 'v': url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' '))})), lambda e: e.k || '=' || e.v), '&') AS message FROM requests)"""


@query(CANONICAL_QUERY_SQL + " SELECT req_id, message FROM canon")
def key3_canonical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.split_request(X.requests(spark, sf_dir)).select("req_id", K.canonical_query(F.col("path"), F.col("params")).alias("message"))


_PAD = X.KEY.encode().ljust(64, b"\0")
HMAC_SQL = f"sha256(unhex('{bytes(b ^ 0x5C for b in _PAD).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _PAD).hex()}') || encode(message))))"


@query(CANONICAL_QUERY_SQL + f" SELECT req_id, {HMAC_SQL} AS token FROM canon")
def key4_sign_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sign_requests(Q.split_request(X.requests(spark, sf_dir)), X.KEY).select("req_id", "token")


def signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose params hold a token of one of five kinds."""
    signed = S.sign_requests(Q.split_request(X.requests(spark, sf_dir)), X.KEY)
    token = X.signed_tokens(F.col("token"))
    with_token = F.when(token.isNotNull(), F.map_concat("params", F.create_map(F.lit("token"), token))).otherwise(F.col("params"))
    return signed.withColumn("params", with_token).drop("token")


@query(O.REQUESTS + " SELECT req_id, ['token_missing', 'token_invalid', 'ok', 'token_malformed', 'ok'][req_id % 5 + 1] AS auth FROM requests")
def key5_verify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.verify_tokens(signed_requests(spark, sf_dir), X.KEY).select("req_id", "auth")


# --- joins and routing -----------------------------------------------------------------------------


@query(O.REQUESTS + ", " + O.ASSETS + " SELECT req_id, path FROM requests WHERE path NOT IN (SELECT path FROM assets)")
def join1_missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.missing_assets(X.requests(spark, sf_dir), X.assets(spark, sf_dir)).select("req_id", "path")


@query(O.REQUESTS + ", " + O.ASSETS + " SELECT req_id, r.path, width, height, has_alpha, n_pages, a.path IS NOT NULL AS found, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified FROM requests r LEFT JOIN assets a ON r.path = a.path")
def join2_attach_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = J.attach_assets(X.requests(spark, sf_dir), X.assets(spark, sf_dir))
    return df.select("req_id", "path", "width", "height", "has_alpha", "n_pages", F.col("exists").alias("found"), _stamp(F.col("modified_at")).alias("modified"))


def variants(spark: SparkSession, sf_dir: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The cache's inventory: cache_key, path, output_format, length, cached_at, stem."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("path", "query").orderBy("req_id"))
    df = cut(planned(spark, sf_dir, cfg).filter("req_id % 3 = 0").select("req_id", "ts", "path", "query", "cache_key", "output_format"), "variants").withColumn("nth", nth).filter("nth = 1")
    return df.select("cache_key", "path", "output_format", (1000 + F.col("req_id") % 5000).alias("length"), F.col("ts").alias("cached_at"), M.file_stem(F.col("cache_key")).alias("stem"))


def cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).groupBy("path").agg(F.min("stem").alias("stem"), F.min("cached_at").alias("written_at"))


def documents_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = X.events(spark, sf_dir).filter((F.col("f") % 2 == 0) & F.col("path").endswith(".docx"))
    return ev.select("path").distinct().withColumn("cached_at", F.lit("2024-01-10").cast("timestamp_ntz"))


@query(O.ROUTED + " SELECT req_id, cache_key, cache_state FROM looked")
def join3_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cache_lookup(planned(spark, sf_dir), variants(spark, sf_dir)).select("req_id", "cache_key", "cache_state")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.route_requests(X.requests(spark, sf_dir), X.assets(spark, sf_dir), variants(spark, sf_dir), EngineConfig(), documents_cache(spark, sf_dir))


ROUTE_SELECT = " SELECT req_id, path, outcome, CAST(CASE outcome WHEN 'bad_request' THEN 400 WHEN 'not_found' THEN 404 WHEN 'error' THEN 500 ELSE 200 END AS INTEGER) AS status, CASE WHEN outcome = 'error' THEN plan_error END AS error, output_format FROM routed"


@query(O.ROUTED + ROUTE_SELECT)
def join4_route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("req_id", "path", "outcome", "status", "error", "output_format")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache's inventory as a bucketed table."""
    name = f"inventory_{uuid.uuid4().hex}"
    return write_inventory(variants(spark, sf_dir), name, 16, shared_path(spark, "inventory"))


@query(O.ROUTED + ROUTE_SELECT)
def join4_route_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing against a bucketed inventory, which no exchange stands on."""
    found = J.route_requests(X.requests(spark, sf_dir), X.assets(spark, sf_dir), inventory(spark, sf_dir), EngineConfig(), documents_cache(spark, sf_dir))
    return found.select("req_id", "path", "outcome", "status", "error", "output_format")


LOCKED = EngineConfig(key=X.KEY, avif_enable=True)


@query(
    O.routed_sql(True, "['token_missing', 'token_invalid', 'ok', 'token_malformed', 'ok'][req_id % 5 + 1]")
    + ROUTE_SELECT.replace("CASE outcome WHEN", "CASE outcome WHEN 'forbidden' THEN 403 WHEN", 1)
)
def join4_route_signed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing with a key, so that tokens count, and with AVIF."""
    signed = S.sign_requests(Q.split_request(X.requests(spark, sf_dir)), X.KEY)
    token = X.signed_tokens(F.col("token"))
    asked = signed.withColumn("query", F.concat("query", F.coalesce(F.concat(F.lit("&token="), token), F.lit("")))).drop("params", "token")
    found = J.route_requests(asked, X.assets(spark, sf_dir), variants(spark, sf_dir, LOCKED), LOCKED, documents_cache(spark, sf_dir))
    return found.select("req_id", "path", "outcome", "status", "error", "output_format")


@query(O.PLANNED + O.VARIANTS + " SELECT i.path, stem FROM cache_index i JOIN assets a ON i.path = a.path WHERE date_trunc('second', modified_at) > date_trunc('second', written_at)")
def join5_stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.stale_index(cache_index(spark, sf_dir), X.assets(spark, sf_dir)).select("path", "stem")


# --- cache -------------------------------------------------------------------------------------------


@query(O.PLANNED + O.VARIANTS + " SELECT output_format, CAST(sum(CAST(ceil(length / 1024.0) AS BIGINT)) AS BIGINT) AS size_kib FROM variants GROUP BY output_format UNION ALL SELECT 'all', CAST(sum(CAST(ceil(length / 1024.0) AS BIGINT)) AS BIGINT) FROM variants")
def cache1_cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir)
    return C.cache_usage(v, ["output_format"]).unionByName(C.cache_usage(v).withColumn("output_format", F.lit("all")))


SMALL = EngineConfig(cache_capacity_gb=0.0001)


@query(O.PLANNED + O.VARIANTS + " SELECT sum(CAST(ceil(length / 1024.0) AS BIGINT)) > 0.0001 * 1024 * 1024 AS over FROM variants")
def cache2_over_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.over_capacity(variants(spark, sf_dir), SMALL)


STALE_SQL = O.PLANNED + O.VARIANTS + """, inventory AS (SELECT *, regexp_extract(cache_key, '([^/]*)\\.[^./]*$', 1) AS stem FROM variants),
stale AS (SELECT DISTINCT stem FROM cache_index i JOIN assets a ON i.path = a.path WHERE date_trunc('second', modified_at) > date_trunc('second', written_at))"""


@query(STALE_SQL + " SELECT cache_key, stem, stem IN (SELECT stem FROM stale) AS removed FROM inventory")
def cache3_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = J.stale_index(cache_index(spark, sf_dir), X.assets(spark, sf_dir))
    return C.evict(variants(spark, sf_dir), stale).select("cache_key", "stem", "removed")


@query(
    O.PLANNED + O.VARIANTS + f", wanted AS (SELECT DISTINCT path FROM requests WHERE coalesce({O.EXT}, '') IN {O.any_of(O.DOCUMENTS)}), j AS (SELECT w.path, CASE WHEN d.cached_at IS NULL THEN 'absent' WHEN d.cached_at < a.modified_at THEN 'stale' END AS reason "
    f"FROM wanted w JOIN assets a ON w.path = a.path LEFT JOIN documents_cache d ON w.path = d.path) SELECT path, 'pdf/' || sha256(path) || '/' || {O.STEM} || '.pdf' AS document_key, reason FROM j WHERE reason IS NOT NULL"
)
def cache4_document_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_work(X.requests(spark, sf_dir), documents_cache(spark, sf_dir), X.assets(spark, sf_dir))


PLAN_SELECT = """ SELECT DISTINCT cache_key, path, output_format, CAST(rotate AS INTEGER) AS rotate, CAST(ow AS BIGINT) AS out_w, CAST(oh AS BIGINT) AS out_h,
  CASE WHEN ext IN ('docx', 'pdf') THEN least(page - 1, n_pages - 1) ELSE 0 END AS page FROM routed WHERE outcome = 'render'"""


@query(O.ROUTED + PLAN_SELECT)
def cache5_render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = C.render_plan(routed(spark, sf_dir))
    return plan.select("cache_key", "path", "output_format", "rotate", F.col("out.w").cast("long").alias("out_w"), F.col("out.h").cast("long").alias("out_h"), "page")


@query(STALE_SQL + ", gate AS (SELECT sum(CAST(ceil(length / 1024.0) AS BIGINT)) > 0.0001 * 1024 * 1024 AS over FROM variants) SELECT cache_key, path, stem IN (SELECT stem FROM stale) AND (SELECT over FROM gate) AS removed FROM inventory")
def cache6_bust_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bust_cache(variants(spark, sf_dir), cache_index(spark, sf_dir), X.assets(spark, sf_dir), SMALL).select("cache_key", "path", "removed")


@query(
    O.PLANNED + ", short AS (SELECT DISTINCT sha256(path) AS path_hash, substr(spec_hash, 1, 1) AS prefix, coalesce(output_format, negotiated) AS output_format, spec_hash FROM keyed) "
    "SELECT path_hash, prefix, output_format, count(*) AS n_specs FROM short GROUP BY ALL HAVING count(*) > 1"
)
def cache7_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.col("spec")
    table = planned(spark, sf_dir).select(K.path_hash(spec["path"]).alias("path_hash"), "params_hash", F.coalesce("output_format", "negotiated").alias("output_format"))
    return C.key_collisions(table, 1)


# --- windows -------------------------------------------------------------------------------------------


@query(O.REQUESTS + ", " + O.CHANGES + " SELECT req_id, strftime(max(changed_at), '%Y-%m-%d %H:%M:%S') AS changed FROM requests r LEFT JOIN changes c ON r.path = c.path AND c.changed_at <= r.ts GROUP BY req_id")
def win1_last_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_modification(X.requests(spark, sf_dir), X.changes(spark, sf_dir)).select("req_id", _stamp(F.col("changed_at")).alias("changed"))


def keyed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(planned(spark, sf_dir).select("req_id", "ts", "path", "cache_key"), "keyed-requests")


GAPS_SQL = O.PLANNED + """, latest AS (SELECT r.req_id, max(changed_at) AS changed_at FROM requests r LEFT JOIN changes c ON r.path = c.path AND c.changed_at <= r.ts GROUP BY r.req_id),
seen AS (SELECT req_id, cache_key, changed_at, ts, lag(ts) OVER (PARTITION BY cache_key ORDER BY ts, req_id) AS previous FROM keyed JOIN latest USING (req_id))
SELECT req_id, cache_key, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', previous)) AS BIGINT) AS since_request, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', changed_at)) AS BIGINT) AS since_change,
  CASE WHEN previous IS NOT NULL THEN coalesce(date_trunc('second', previous) < date_trunc('second', changed_at), false) END AS changed FROM seen"""


@query(GAPS_SQL)
def win2_request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.request_gaps(keyed_requests(spark, sf_dir), X.changes(spark, sf_dir)).select("req_id", "cache_key", "since_request", "since_change", "changed")


# --- sources and sinks ---------------------------------------------------------------------------------


LOG_SQL = O.REQUESTS + """ SELECT req_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, 'GET' AS method, '/' || path || '?' || query AS target, CAST([200, 404, 500][req_id % 3 + 1] AS INTEGER) AS status,
  req_id * 13 % 5000 AS bytes, CASE WHEN req_id % 4 <> 0 THEN 'https://example.com/' || (req_id % 10) END AS referer, 'agent/' || (req_id % 5) AS agent FROM requests"""


@query(LOG_SQL)
def src5_parse_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_access_log(X.log_lines(spark, sf_dir)).drop("value", "version")


@query(O.PLANNED + O.VARIANTS + " SELECT cache_key, path, output_format, length FROM variants WHERE output_format IS NOT NULL")
def src6_write_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "variants-sink")
    write_variants(variants(spark, sf_dir).filter("output_format is not null"), path)
    return spark.read.parquet(path).select("cache_key", "path", "output_format", "length")


@query(
    O.PLANNED + O.VARIANTS + ", rows AS (SELECT * FROM variants WHERE output_format IS NOT NULL) SELECT cache_key, path, output_format, CASE WHEN output_format = 'jpg' OR length % 3 <> 0 THEN length ELSE length + 1 END AS length, "
    "regexp_extract(cache_key, '([^/]*)\\.[^./]*$', 1) AS stem, CAST(CASE WHEN output_format = 'jpg' AND length % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM rows"
)
def src6_commit_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, the second with later rows of some keys, one of them sent twice; all formats but JPEG
    compacted; renditions and index rows of the last snapshot."""
    root = shared_path(spark, "renditions")
    rows = cut(variants(spark, sf_dir).filter("output_format is not null"), "renditions-made")
    later = rows.filter("length % 3 = 0").withColumns({"cached_at": F.col("cached_at") + F.expr("INTERVAL 1 DAY"), "length": F.when(F.col("output_format") == "jpg", F.col("length")).otherwise(F.col("length") + 1)})
    store.commit_renditions(rows, root)
    for _ in range(2):
        store.commit_renditions(later, root, "later")
    store.compact_renditions(spark, root, [f for f in OUTPUTS if f != "jpg"])
    index = store.read_rendition_index(spark, root).groupBy("cache_key", "stem").agg(F.count("*").alias("n"))
    made = store.read_renditions(spark, root).groupBy("cache_key", "path", "output_format").agg(F.max("length").alias("length"), F.count("*").alias("rows"))
    return made.join(index, "cache_key").filter("n = rows").select("cache_key", "path", "output_format", "length", "stem", "n")


@query(O.PLANNED + O.VARIANTS + " SELECT cache_key, path, regexp_extract(cache_key, '([^/]*)\\.[^./]*$', 1) AS stem, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS written FROM variants")
def src7_write_cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "index-sink")
    write_cache_index(variants(spark, sf_dir), path)
    return spark.read.parquet(path).select("cache_key", "path", "stem", _stamp(F.col("written_at")).alias("written"))


IMAGES_SQL = "WITH im AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: CAST(greatest(least(floor((CAST(x AS DOUBLE) + 1.0) * 127.5), 255), 0) AS INTEGER)) AS px FROM embeddings)"
FILES_SQL = IMAGES_SQL + """, files AS (SELECT image_id, ['png', 'jpg', 'gif'][image_id % 3 + 1] AS ext, CAST([134, 53, 14][image_id % 3 + 1] AS BIGINT) AS length,
  ['png', 'jpg', 'gif'][image_id % 3 + 1] || '/' || image_id || '.' || ['png', 'jpg', 'gif'][image_id % 3 + 1] AS path, upper(array_to_string(list_transform(px, lambda x: printf('%02x', x)), '')) AS hex FROM im)"""


def image_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of PNG, JPEG and GIF files made of the embeddings."""
    root = shared_path(spark, "image-files")
    X.write_files(X.image_arrays(spark, sf_dir).select("image_id", "px"), root, X.image_file)
    return root


@query(FILES_SQL + " SELECT path, length, CASE ext WHEN 'png' THEN '00' || substr(hex, 1, 64) || '00' || substr(hex, 65) END AS pixels FROM files")
def src1_scan_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S_FILES.scan_assets(spark, image_files(spark, sf_dir))
    return found.select("path", "length", F.when(F.col("path").startswith("png/"), F.hex(F.substring("content", 49, 66))).alias("pixels"))


@query(FILES_SQL + " SELECT path, ext, CAST(image_id AS VARCHAR) AS stem, length, true AS dated FROM files")
def src2_asset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S_FILES.asset_inventory(S_FILES.scan_assets(spark, image_files(spark, sf_dir)))
    return found.select("path", "ext", "stem", "length", F.col("modified_at").isNotNull().alias("dated"))


@query(
    FILES_SQL + " SELECT path, CASE ext WHEN 'png' THEN 2 ELSE -1 END AS height, CASE ext WHEN 'png' THEN 8 ELSE -1 END AS width, CASE ext WHEN 'png' THEN 4 ELSE -1 END AS channels, "
    "CASE ext WHEN 'png' THEN array_to_string(list_transform(range(0, 64), lambda i: im.px[(i // 4) * 4 + [3, 2, 1, 4][i % 4 + 1]]), ',') ELSE '' END AS px, CASE WHEN ext <> 'png' THEN 'undecodable' END AS error FROM files JOIN im USING (image_id)"
)
def src3_scan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S_FILES.scan_images(spark, image_files(spark, sf_dir))
    return found.select("path", "height", "width", F.col("nChannels").alias("channels"), I.to_text(F.col("data")).alias("px"), "error")


@query(
    FILES_SQL + " SELECT path, CASE ext WHEN 'jpg' THEN 'jpeg' ELSE ext END AS image_type, CASE ext WHEN 'png' THEN 8 ELSE 1 + image_id % 500 END AS width, CASE ext WHEN 'png' THEN 2 ELSE 1 + image_id % 300 END AS height, "
    "ext = 'png' AS has_alpha, CAST(CASE ext WHEN 'jpg' THEN 1 + image_id % 8 ELSE 1 END AS INTEGER) AS orientation, 1 AS n_pages, length FROM files"
)
def src4_probe_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S_FILES.probe_assets(S_FILES.scan_assets(spark, image_files(spark, sf_dir))).drop("modified_at")


CONTAINERS_SQL = """WITH files AS (SELECT vec_id AS id, ['tiff', 'png', 'gif', 'webp', 'webp', 'avif', 'svg', 'pdf'][vec_id % 8 + 1] AS kind, CAST(1 + vec_id % 500 AS BIGINT) AS width, CAST(1 + vec_id % 300 AS BIGINT) AS height,
  vec_id % 3 = 0 OR vec_id % 8 > 5 AS has_alpha, CAST(CASE WHEN vec_id % 8 = 0 THEN 1 + vec_id % 8 ELSE 1 END AS INTEGER) AS orientation, CAST(CASE WHEN vec_id % 8 IN (0, 2, 3, 7) THEN 1 + vec_id % 4 ELSE 1 END AS INTEGER) AS n_pages FROM embeddings)"""


def container_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files of eight kinds, by the ids of the embeddings."""
    root = shared_path(spark, "container-files")
    X.write_files(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id"), root, X.container_file)
    return root


@query(CONTAINERS_SQL + " SELECT kind || '/' || id || '.' || kind AS path, kind AS image_type, width, height, has_alpha, orientation, n_pages FROM files")
def src4_probe_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all kinds, by ranged reads of listed files."""
    root = container_files(spark, sf_dir)
    return S_FILES.probe_assets(L.list_files(spark, root), root).drop("length", "modified_at")


@query(
    CONTAINERS_SQL + " SELECT id AS req_id, kind || '/' || id || '.' || kind AS path, CASE WHEN kind = 'pdf' THEN least(id % 6, n_pages - 1) ELSE 0 END AS page, "
    "CAST(CASE WHEN orientation >= 5 THEN height ELSE width END AS INTEGER) AS loaded_w, CAST(CASE WHEN orientation >= 5 THEN width ELSE height END AS INTEGER) AS loaded_h, 'render' AS outcome FROM files"
)
def join2_attach_probed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the n-th page of every file, routed with what its header says alone."""
    root = container_files(spark, sf_dir)
    files = S_FILES.probe_assets(L.list_files(spark, root), root)
    n = F.regexp_extract("path", "([0-9]+)[.]", 1).cast("long")
    asked = files.select(n.alias("req_id"), "path", F.concat(F.lit("thumb=p:"), (1 + n % 6).cast("string")).alias("query"), F.lit("*/*").alias("accept"))
    none = spark.createDataFrame([], "cache_key string, cached_at timestamp_ntz")
    found = J.route_requests(asked, files, none, EngineConfig(), spark.createDataFrame([], "path string, cached_at timestamp_ntz"))
    return found.select("req_id", "path", F.when(F.col("kind.paged"), G.clamp_page(F.col("spec.page"), F.col("n_pages"))).otherwise(0).cast("int").alias("page"), F.col("loaded.w").alias("loaded_w"), F.col("loaded.h").alias("loaded_h"), "outcome")


@query(O.EV + " SELECT 'k' || event_id AS stem, path FROM ev WHERE event_type = 'purchase'")
def src8_read_cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "index-files")
    events = X.events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "path")
    X.write_files(events, root, lambda event_id, path: (f"d{event_id % 16}/k{event_id}.index", f"{path}\n".encode()))
    return S_FILES.read_cache_index(spark, root).select("stem", "path")


@query(O.EV + " SELECT 'd' || (event_id % 16) || '/k' || event_id || '.index' AS path, CAST(length(path) + 1 AS BIGINT) AS length, 'k' || event_id AS stem, path AS source FROM ev WHERE event_type = 'purchase'")
def src8_list_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, listed and read by tasks."""
    root = shared_path(spark, "index-files")
    events = X.events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "path")
    X.write_files(events, root, lambda event_id, path: (f"d{event_id % 16}/k{event_id}.index", f"{path}\n".encode()))
    listed = L.list_files(spark, root).select("path", "length", F.regexp_extract("path", "([^/]*)[.]index$", 1).alias("stem"))
    return listed.join(L.read_index_files(spark, root).select("stem", F.col("path").alias("source")), "stem").select("path", "length", "stem", "source")


@query(FILES_SQL + " SELECT image_id AS req_id, path, length, CASE ext WHEN 'png' THEN '89504E470D0A' WHEN 'jpg' THEN 'FFD8FFE10022' ELSE '474946383961' END AS head FROM files WHERE image_id % 2 = 0")
def src9_select_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = image_files(spark, sf_dir)
    ext = F.get(F.array(F.lit("png"), F.lit("jpg"), F.lit("gif")), (F.col("image_id") % 3).cast("int"))
    asked = X.image_arrays(spark, sf_dir).select(F.col("image_id").alias("req_id"), F.concat(ext, F.lit("/"), F.col("image_id").cast("string"), F.lit("."), ext).alias("path"), F.when(F.col("image_id") % 2 == 0, "original").otherwise("render").alias("outcome"))
    return S_FILES.select_originals(asked, L.list_files(spark, root), root).select("req_id", "path", "length", F.hex(F.substring("content", 1, 6)).alias("head"))


# --- images -----------------------------------------------------------------------------------------------



def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.from_arrays(X.image_arrays(spark, sf_dir).select("image_id", "height", "width", "channels", "px"))


def _shown(images: DataFrame) -> DataFrame:
    return images.select("image_id", "height", "width", I.to_text(F.col("data")).alias("px"))


@query(IMAGES_SQL + " SELECT image_id, 8 AS height, 2 AS width, array_to_string(list_transform(range(0, 64), lambda i: px[((1 - (i // 4) % 2) * 8 + i // 8) * 4 + i % 4 + 1]), ',') AS px FROM im")
def img2_rotate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(I.rotate_images(_images(spark, sf_dir), 90))


@query(IMAGES_SQL + " SELECT image_id, 2 AS height, 8 AS width, array_to_string(list_transform(range(0, 64), lambda i: px[(i // 32) * 32 + (7 - (i // 4) % 8) * 4 + i % 4 + 1]), ',') AS px FROM im")
def img1_apply_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(I.apply_orientation(_images(spark, sf_dir).withColumn("orientation", F.lit(2))))


@query(
    IMAGES_SQL + " SELECT image_id, 1 AS height, 4 AS width, array_to_string(list_transform(range(0, 16), lambda i: CAST(floor((px[(i // 4) * 8 + i % 4 + 1] + px[(i // 4) * 8 + 4 + i % 4 + 1] + px[32 + (i // 4) * 8 + i % 4 + 1] + px[36 + (i // 4) * 8 + i % 4 + 1]) / 4.0 + 0.5) AS INTEGER)), ',') AS px FROM im"
)
def img3_resize_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(I.resize_cover(_images(spark, sf_dir), 4, 1))


@query(ORACLE_SQL["img3_resize_cover"])
def img3_resize_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of images that come in strips of one row."""
    images = _images(spark, sf_dir).withColumn("path", F.col("image_id").cast("string"))
    found = I.assembled(I.resize_strips(I.in_strips(images, 1), 4, 1))
    return _shown(found.withColumn("image_id", F.col("path").cast("long")))


_AF, _AB = "(px[(i // 4) * 4 + 4] / 255.0::DOUBLE)", "(128 / 255.0::DOUBLE)"
_A = f"({_AF} + {_AB} * (1 - {_AF}))"


@query(
    IMAGES_SQL + f" SELECT image_id, 2 AS height, 8 AS width, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN i % 4 = 3 THEN CAST(floor({_A} * 255 + 0.5) AS INTEGER) ELSE "
    f"CAST(floor((px[i + 1] * {_AF} + [56, 34, 12][i % 4 + 1] * {_AB} * (1 - {_AF})) / {_A} + 0.5) AS INTEGER) END), ',') AS px FROM im"
)
def img4_composite_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    bg = F.struct(F.lit(12).alias("r"), F.lit(34).alias("g"), F.lit(56).alias("b"), F.lit(128).alias("a"))
    return _shown(I.composite_background(_images(spark, sf_dir), bg))


@query(
    IMAGES_SQL + " SELECT image_id, 2 AS height, 8 AS width, array_to_string(list_transform(range(0, 48), lambda i: CAST(floor(px[(i // 3) * 4 + i % 3 + 1] * (px[(i // 3) * 4 + 4] / 255.0::DOUBLE) + 0.5) AS INTEGER)), ',') AS px FROM im"
)
def img5_flatten_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(I.flatten_alpha(_images(spark, sf_dir)))


@query(
    IMAGES_SQL + " SELECT CAST(image_id AS VARCHAR) || '/turned' AS cache_key, 'img' || (image_id) AS path, 4 AS height, 1 AS width, array_to_string(list_transform(range(0, 16), lambda i: CAST(floor((px[(i // 4) * 8 + i % 4 + 1] + px[(i // 4) * 8 + 4 + i % 4 + 1] + px[32 + (i // 4) * 8 + i % 4 + 1] "
    "+ px[36 + (i // 4) * 8 + i % 4 + 1]) / 4.0 + 0.5) AS INTEGER)), ',') AS px FROM im"
)
def img6_render_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir).withColumn("path", F.concat(F.lit("img"), F.col("image_id").cast("string")))
    none = F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")
    plan = images.select(F.concat(F.col("image_id").cast("string"), F.lit("/turned")).alias("cache_key"), "path", F.lit("png").alias("output_format"), F.struct(F.lit(4).alias("w"), F.lit(1).alias("h")).alias("resize"), F.lit(90).alias("rotate"), none.alias("composite"))
    return I.render_variants(plan, images).select("cache_key", "path", "height", "width", I.to_text(F.col("data")).alias("px"))


# --- streams ------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str, at_once: int = 2) -> DataFrame:
    """The events as files that arrive in a folder, some in each batch."""
    events, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), shared_path(spark, "events")
    events.repartitionByRange(4, "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", at_once).parquet(folder)


def _drained(df: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the data there is, as a table."""
    spark = df.sparkSession
    out = shared_path(spark, name)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(O.ROUTED + ROUTE_SELECT)
def str1_stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = X.as_requests(X.with_paths(_event_stream(spark, sf_dir)))
    out = shared_path(spark, "routed-stream")
    T.stream_route(requests, X.assets(spark, sf_dir), inventory(spark, sf_dir), EngineConfig(), out, shared_path(spark, "routed-checkpoint"), documents_cache(spark, sf_dir), once=True).awaitTermination()
    return spark.read.parquet(out).select("req_id", "path", "outcome", "status", "error", "output_format")


def _in_spans(spark: SparkSession, sf_dir: str, folder: str) -> Iterator[DataFrame]:
    """The stream of events in ``folder``, each time after one more of four spans of time has come."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = ev.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75])).first()[0] or []
    span = sum((F.unix_micros(F.col("ts").cast("timestamp")) > end).cast("int") for end in ends) if ends else F.lit(0)
    for n in range(4):
        ev.filter(F.coalesce(span, F.lit(0)) == n).write.mode("append").parquet(folder)
        yield X.with_paths(spark.readStream.schema(ev.schema).parquet(folder))


def _taken_up(found: DataFrame, out: str, at: str) -> None:
    """Run a stream on what has come since its checkpoint ``at``; its rows are added to ``out``."""
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


@query(
    O.REQUESTS.replace("WITH ", "WITH RECURSIVE ", 1) + ", keyed AS (SELECT path || '?' || query AS cache_key, ts FROM requests), "
    "given AS (SELECT cache_key, min(ts) AS given_at FROM keyed GROUP BY cache_key UNION ALL SELECT k.cache_key, min(k.ts) FROM given g JOIN keyed k ON k.cache_key = g.cache_key AND k.ts >= g.given_at + INTERVAL 7 DAY GROUP BY k.cache_key) "
    "SELECT cache_key, strftime(given_at, '%Y-%m-%d %H:%M:%S.%f') AS given_at FROM given"
)
def str2_stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in four spans of time; keys come once in seven days, whichever batch they come in."""
    folder, out, at = (shared_path(spark, n) for n in ("events", "first", "first-checkpoint"))
    for rows in _in_spans(spark, sf_dir, folder):
        keyed = X.as_requests(rows).select("path", "ts", F.concat_ws("?", "path", "query").alias("cache_key"))
        found = T.stream_first_requests(keyed, EngineConfig())
        _taken_up(found, out, at)
    return spark.read.schema(found.schema).parquet(out).select("cache_key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("given_at"))


STREAM_GAPS_SQL = O.REQUESTS + ", " + O.CHANGES + """, latest AS (SELECT r.req_id, max(changed_at) AS changed_at FROM requests r LEFT JOIN changes c ON r.path = c.path AND c.changed_at <= r.ts GROUP BY r.req_id),
seen AS (SELECT req_id, path || '?' || query AS cache_key, changed_at, ts, lag(ts) OVER (PARTITION BY path, query ORDER BY ts, req_id) AS previous FROM requests JOIN latest USING (req_id)),
gaps AS (SELECT *, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', previous)) AS BIGINT) AS gap FROM seen)
SELECT req_id, cache_key, CASE WHEN gap <= 51 * 3600 THEN gap END AS since_request, CASE WHEN gap <= 51 * 3600 THEN coalesce(date_trunc('second', previous) < date_trunc('second', changed_at), false) END AS changed FROM gaps"""


@query(STREAM_GAPS_SQL)
def str3_stream_request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in four spans of time; the stream takes up each with the state of those before."""
    folder, out, at = (shared_path(spark, n) for n in ("events", "gaps", "gaps-checkpoint"))
    for rows in _in_spans(spark, sf_dir, folder):
        change = F.col("event_type") == "purchase"
        rows = rows.select("path", "ts", F.when(~change, F.col("event_id")).alias("req_id"), F.when(~change, F.concat_ws("?", F.col("path"), X.query_text())).alias("cache_key"))
        found = T.stream_request_gaps(rows, "51 hours")
        _taken_up(found, out, at)
    return spark.read.schema(found.schema).parquet(out)


@query(
    FILES_SQL + ", steps AS (SELECT unnest([1, 2, 3]) AS step), happened AS (SELECT step, path, image_id, CASE WHEN step = 1 OR (step = 3 AND image_id % 5 = 2) THEN 'added' WHEN step = 2 AND image_id % 5 = 1 THEN 'changed' WHEN image_id % 5 = step THEN 'deleted' END AS change FROM files, steps) "
    "SELECT CAST(step AS INTEGER) AS step, path, change, 's' || image_id AS stem FROM happened WHERE change = 'deleted' OR (change IS NOT NULL AND image_id % 4 < 2)"
)
def str4_stream_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three listings on one checkpoint: all files come; some are overwritten in place and some go; of
    those that went all come back, and others go."""
    root, state, out, at = image_files(spark, sf_dir), *(shared_path(spark, n) for n in ("listings", "stale", "stale-checkpoint"))
    made = X.image_arrays(spark, sf_dir).select("image_id", "px")
    entries = cut(L.list_files(spark, root).select("path", F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("n")), "entries")
    cached_at = F.when(F.col("n") % 4 < 2, F.lit("2001-01-01")).otherwise(F.lit("2999-01-01")).cast("timestamp")
    cached = cut(entries.select("path", F.concat(F.lit("k/s"), F.col("n").cast("string"), F.lit(".webp")).alias("cache_key"), cached_at.alias("cached_at")), "variants")

    def longer(image_id: int, px: list[int]) -> tuple[str, bytes]:
        name, data = X.image_file(image_id, px)
        return name, data + b"."

    for step in range(3):
        if step == 1:
            X.write_files(made.filter("image_id % 5 = 1"), root, longer)
        if step == 2:
            X.write_files(made.filter("image_id % 5 = 2"), root, X.image_file)
        if step:
            X.remove_files(entries.filter(F.col("n") % 5 == step + 1), root)
        found = T.stream_invalidate(L.asset_changes(spark, root, state), cached).select("path", "change", "stem")
        found.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, change string, stem string, batch int").parquet(out).select((F.col("batch") + 1).alias("step"), "path", "change", "stem")


@query(
    IMAGES_SQL + " SELECT CAST(image_id AS VARCHAR) || '/turned' AS cache_key, 'img' || image_id AS path, CASE WHEN image_id % 5 = 0 THEN NULL ELSE 8 END AS height, array_to_string(CASE WHEN image_id % 5 = 0 THEN NULL ELSE list_transform(range(0, 64), lambda i: px[((1 - (i // 4) % 2) * 8 + i // 8) * 4 + i % 4 + 1]) END, ',') AS px, "
    "CASE WHEN image_id % 5 = 0 THEN 'missing_source' END AS error, image_id % 5 <> 0 AS indexed FROM im"
)
def str5_stream_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that arrive in four batches and once more, some of them without a source."""
    images = _images(spark, sf_dir).withColumn("path", F.concat(F.lit("img"), F.col("image_id").cast("string")))
    none = F.lit(None)
    plan = images.select(F.concat(F.col("image_id").cast("string"), F.lit("/turned")).alias("cache_key"), "path", F.lit("png").alias("output_format"), none.cast("struct<w:int,h:int>").alias("resize"), F.lit(90).alias("rotate"), none.cast("struct<r:int,g:int,b:int,a:int>").alias("composite"))
    folder, out, index, at = (shared_path(spark, n) for n in ("plans", "rendered", "rendered-index", "render-checkpoint"))
    plan.repartition(4, "cache_key").write.parquet(folder)
    for again in range(2):
        stream = spark.readStream.schema(plan.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        T.stream_render(stream, images.filter("image_id % 5 <> 0"), out, index, at, once=True).awaitTermination()
        if not again:
            plan.filter("length(cache_key) % 2 = 0").coalesce(1).write.mode("append").parquet(folder)
    made = spark.read.parquet(out).dropDuplicates(["cache_key"])
    known = spark.read.parquet(index).groupBy("cache_key").agg(F.count("*").alias("n"))
    return made.join(known, "cache_key", "left").select("cache_key", "path", "height", F.when(F.col("error").isNull(), I.to_text(F.col("data"))).alias("px"), "error", (F.coalesce("n", F.lit(0)) == 1).alias("indexed"))
