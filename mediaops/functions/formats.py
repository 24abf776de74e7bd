"""Format rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaops.functions.parsing import flatten_colour

# Extensions and limits.
RASTER = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "ico", "svg", "heic", "heif", "jp2", "jpm", "jpx", "jpf", "avif", "avifs"]
DOCUMENTS = ["doc", "docx", "odt", "xls", "xlsx", "ods", "ppt", "pptx", "odp", "rtf"]
OPAQUE = ["jpg", "jpeg"]
WEBP_SIDE, WEBP_AREA = 16383, 170_000_000
AVIF_SIDE = PNG_SIDE = 16384
#: Default quality at 8 megapixels and more, and at a quarter megapixel and less.
QUALITY = {"avif": (40.0, 59.0), "webp": (16.0, 78.0), "jpg": (40.0, 75.0)}
PNG_QUALITY = 78


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; null for none and for dot files."""
    return F.lower(F.nullif(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1), F.lit("")))


def file_stem(path: Column) -> Column:
    """The name without its extension."""
    name = file_name(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1), F.lit("")), name)


def classify(path: Column) -> Column:
    """supported, paged (document or PDF), convertible (document), svg, transparent (may be)."""
    return classify_extension(file_extension(path))


def classify_extension(ext: Column) -> Column:
    """classify() from the extension."""
    ext = F.coalesce(ext, F.lit(""))
    return F.struct(
        ext.isin(*RASTER, *DOCUMENTS, "pdf").alias("supported"), ext.isin(*DOCUMENTS, "pdf").alias("paged"), ext.isin(*DOCUMENTS).alias("convertible"),
        (ext == "svg").alias("svg"), (~ext.isin(*OPAQUE)).alias("transparent"),
    )


def negotiate_format(fmt: Column, accept: Column, avif_enable: bool) -> Column:
    """The asked format; for auto what the client accepts. An absent header, or one that is not
    visible ASCII, gets webp."""
    visible = accept.rlike(r"^[\x20-\x7E\t]*$")
    return (
        F.when(fmt != "auto", fmt)
        .when(accept.isNull() | ~visible, "webp")
        .when(F.lit(avif_enable) & accept.contains("image/avif"), "avif")
        .when(accept.contains("image/webp"), "webp")
        .otherwise("jpg")
    )


def enforce_limits(fmt: Column, explicit: Column, width: Column, height: Column, alpha: Column) -> Column:
    """output_format and error for an image of this size: formats have size limits, beyond which an
    automatic format falls back and an asked one is an error."""
    w, h = width.cast("long"), height.cast("long")
    over = lambda side: F.coalesce((w > side) | (h > side), F.lit(False))
    too_large = ((fmt == "webp") & (over(WEBP_SIDE) | F.coalesce(w * h > WEBP_AREA, F.lit(False)))) | ((fmt == "avif") & over(AVIF_SIDE)) | ((fmt == "png") & over(PNG_SIDE))
    fallback = F.when((fmt == "webp") & F.coalesce(alpha, F.lit(False)) & ~over(PNG_SIDE), "png").otherwise("jpg")
    out = F.when(~too_large, fmt).when(~explicit, fallback)
    return F.struct(out.alias("output_format"), F.when(too_large & explicit, "too_large").alias("error"))


def default_quality(fmt: Column, w: Column, h: Column) -> Column:
    """Falls with the area: full at a quarter megapixel, least at 8 megapixels."""
    room = F.least(F.greatest(8.0 - w.cast("double") * h.cast("double") / 1e6, F.lit(0.0)), F.lit(7.75))
    out = F.when(fmt == "png", PNG_QUALITY)
    for name, (low, high) in QUALITY.items():
        out = out.when(fmt == name, (room * (high - low) / 7.75 + low).cast("int"))
    return out


def encode_options(quality: Column, background: Column, fmt: Column, out_w: Column, out_h: Column) -> Column:
    """What the encoder of ``fmt`` is told; null for formats that are not encoded."""
    q = F.coalesce(quality, default_quality(fmt, out_w, out_h)).cast("int")
    only = lambda name, value: F.when(fmt == name, F.lit(value))
    options = F.struct(
        q.alias("quality"), F.when(fmt == "png", F.when(q < 90, 0.8).otherwise(1.0)).alias("dither"), only("webp", 50).alias("alpha_quality"), only("avif", 1).alias("effort"), only("avif", 8).alias("bit_depth"),
        F.when(fmt == "webp", "smart").when(fmt == "avif", "off").alias("subsampling"), (fmt == "png").alias("palette"), (fmt == "jpg").alias("optimise"), flatten_colour(background).alias("flatten"), F.lit(True).alias("strip"),
    )
    return F.when(fmt.isin("avif", "webp", "jpg", "png"), options)
