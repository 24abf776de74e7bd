"""Request tables: splitting, typing and the full rendition spec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import parsing as P
from mediaops.session import bound, per_distinct


def split_request(requests: DataFrame, target: str | None = None) -> DataFrame:
    """Adds ``params`` (decoded parameters, the last of equal names wins) and decodes ``path``.

    With ``target`` that column holds path and query together, possibly with scheme and host;
    else the table has path and query apart. Leading slashes of the path go. The query of a null
    target is empty.
    """
    if target is not None:
        bare = F.regexp_replace(F.regexp_replace(F.col(target), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
        requests = requests.withColumn("path", F.substring_index(bare, "?", 1)).withColumn("query", F.regexp_extract(bare, r"(?s)\?(.*)$", 1))
    return bound(requests.withColumn("path", bare_path(F.col("path"))), params=P.query_map(F.col("query")))


def bare_path(path: Column) -> Column:
    """A decoded path without leading slashes; a '+' stays one."""
    encoded = F.contains(path, F.lit("%"))
    return F.regexp_replace(F.when(encoded, F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)).otherwise(path), "^/+", "")


def parse_requests(requests: DataFrame) -> DataFrame:
    """Adds ``raw``, the typed optional parameters with their ``bad`` flag."""
    return bound(requests, raw=P.parse_raw(F.col("params")))


def build_params(requests: DataFrame) -> DataFrame:
    """Adds ``spec``, the full typed rendition spec with its defaults, made of ``raw`` and ``path``."""
    return with_path(bound(requests, spec=_spec(F.col("raw"))))


def _spec(raw: Column) -> Column:
    return F.struct(
        P.scale_side(raw["w"], raw["dpr"]).alias("width"), P.scale_side(raw["h"], raw["dpr"]).alias("height"), raw["q"].alias("quality"), P.parse_crop(raw["crop"]).alias("crop"),
        P.parse_thumb(raw["thumb"]).alias("page"), F.coalesce(raw["original"], F.lit(False)).alias("original"), P.parse_rotate(raw["rot"]).alias("rotate"), P.parse_background(raw["bg"]).alias("background"), P.parse_format(raw["f"]).alias("format"),
    )


def with_path(requests: DataFrame) -> DataFrame:
    fields = ("width", "height", "quality", "crop", "page", "original", "rotate", "background", "format")
    return requests.withColumn("spec", F.struct("path", *(F.col(f"spec.{f}") for f in fields)))


def typed_requests(requests: DataFrame) -> DataFrame:
    """path and query to path, params, raw and spec. Each distinct query string is parsed once."""
    parse = lambda q: bound(bound(bound(q, params=P.query_map(F.col("query"))), raw=P.parse_raw(F.col("params"))), spec=_spec(F.col("raw")))
    return with_path(per_distinct(requests.withColumn("path", bare_path(F.col("path"))), ["query"], parse))
