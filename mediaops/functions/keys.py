"""Keys and signatures as Column functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaops.functions.formats import file_stem


def canonical_params(p: Column) -> Column:
    """The whole typed spec but its path as one string; equal specs and no others have equal
    strings. Missing values are '-'."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    crop, bg = p["crop"], p["background"]
    crop_text = F.when(crop.isNull(), "-").otherwise(F.concat_ws(",", crop["ratio"]["kind"], *[text(crop["ratio"][c]) for c in "wh"], text(crop["width"]), text(crop["height"]), crop["gravity"], text(crop["dx"]), text(crop["dy"])))
    bg_text = F.when(bg.isNull(), "-").otherwise(F.concat_ws(",", *[text(bg[c]) for c in "rgba"]))
    return F.concat_ws("|", text(p["width"]), text(p["height"]), text(p["quality"]), crop_text, text(p["page"]), text(p["original"]), text(p["rotate"]), bg_text, text(p["format"]))


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def params_hash(p: Column) -> Column:
    """Of the whole spec, the path included."""
    return F.sha2(F.concat_ws("|", p["path"], canonical_params(p)), 256)


def cache_key(spec_hash: Column, path: Column, fmt: Column) -> Column:
    """shard/shard/shard/spec-path.format, from params_hash: the full digest of the spec stands in
    the key, so two specs do not meet in one entry."""
    shards = [F.substring(spec_hash, i, 2) for i in (1, 3, 5)]
    return F.concat(F.concat_ws("/", *shards, F.concat(spec_hash, F.lit("-"), path_hash(path))), F.lit("."), fmt)


def document_key(path: Column) -> Column:
    return F.concat_ws("/", F.lit("pdf"), path_hash(path), F.concat(file_stem(path), F.lit(".pdf")))


def canonical_query(path: Column, params: Column) -> Column:
    """path?k=v&...: sorted by name, without the token. The '?' always stands."""
    kept = F.array_sort(F.filter(F.map_entries(params), lambda e: e["key"] != "token"))
    return F.concat(path, F.lit("?"), F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), "&"))


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in lower-case hexadecimal, from two plain digests."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), F.unhex(inner)), 256)


def verify_token(path: Column, params: Column, key: str | None) -> Column:
    """ok, token_missing, token_malformed (no hexadecimal bytes) or token_invalid."""
    if key is None:
        return F.lit("ok")
    token = F.try_element_at(params, F.lit("token"))
    return (
        F.when(token.isNull(), "token_missing")
        .when(~token.rlike("^([0-9a-fA-F]{2})*$"), "token_malformed")
        .when(F.lower(token) == hmac_sha256(canonical_query(path, params), key), "ok")
        .otherwise("token_invalid")
    )
