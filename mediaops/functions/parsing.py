"""Request parsing as Column functions: everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that requests may use.
FORMATS = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp", "avif": "avif", "pdf": "pdf"}
ROTATIONS = {"90": 270, "left": 270, "anticlockwise": 270, "180": 180, "bottom-up": 180, "upside-down": 180, "270": 90, "right": 90, "clockwise": 90}
COLOURS = {"transparent": (0, 0, 0, 0), "black": (0, 0, 0, 255), "white": (255, 255, 255, 255)}
ORIGINS = {
    "top-left": "top-left", "left-top": "top-left",
    "top-center": "top-center", "center-top": "top-center", "top": "top-center",
    "top-right": "top-right", "right-top": "top-right",
    "left-center": "left-center", "center-left": "left-center", "left": "left-center",
    "right-center": "right-center", "center-right": "right-center", "right": "right-center",
    "bottom-left": "bottom-left", "left-bottom": "bottom-left",
    "bottom-center": "bottom-center", "center-bottom": "bottom-center", "bottom": "bottom-center",
    "bottom-right": "bottom-right", "right-bottom": "bottom-right",
}
NAMED_RATIOS = ("video", "square", "free")

U8, U16, U32 = 255, 65535, 4294967295


def lookup(table: dict, key: Column, default) -> Column:
    """The table's value for ``key``; ``default`` for other keys and null."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit(default))


def strict_int(text: Column, low: int, high: int, signed: bool = False) -> Column:
    """Digits after an optional sign, in range; anything else is null. Spark's own cast would also
    take blanks and fractions."""
    pattern = r"^[+-]?[0-9]+$" if signed else r"^[+]?[0-9]+$"
    n = F.when(text.rlike(pattern), text.try_cast("long"))
    return F.when(n.between(low, high), n)


def strict_float(text: Column) -> Column:
    """A decimal number, an exponent allowed, or inf, infinity or nan in any case; else null."""
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    infinite = F.lower(text).rlike(r"^[+-]?inf(inity)?$")
    signed = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(number, text.try_cast("float")).when(infinite, signed.cast("float")).when(F.lower(text).rlike(r"^[+-]?nan$"), F.lit(float("nan")).cast("float"))


def percent_decode(text: Column) -> Column:
    """Form decoding: '+' is a blank, %XX a byte; what cannot be decoded stays."""
    decoded = F.coalesce(F.try_url_decode(text), F.regexp_replace(text, r"\+", " "))
    return F.when(F.contains(text, F.lit("%")) | F.contains(text, F.lit("+")), decoded).otherwise(text)


def query_map(query: Column) -> Column:
    """Parameters of a query string; of equal names the last wins, and a missing '=' means ''. One walk
    over the pairs, each decoded once."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    pairs = F.transform(parts, lambda p: F.struct(percent_decode(F.substring_index(p, "=", 1)).alias("k"), percent_decode(value(p)).alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.map_from_entries(F.aggregate(pairs, none, lambda seen, p: F.array_append(F.filter(seen, lambda s: s["k"] != p["k"]), p)))


def parse_raw(params: Column) -> Column:
    """The typed optional parameters; ``bad`` tells that one of them has the wrong type."""
    get = lambda k: F.try_element_at(params, F.lit(k))
    w, h, q = strict_int(get("w"), 0, U16), strict_int(get("h"), 0, U16), strict_int(get("q"), 0, U8)
    dpr = strict_float(get("dpr"))
    original = F.when(get("original") == "true", True).when(get("original") == "false", False)
    typed = {"w": w, "h": h, "q": q, "dpr": dpr, "original": original}
    bad = F.lit(False)
    for k, parsed in typed.items():
        bad = bad | (get(k).isNotNull() & parsed.isNull())
    return F.struct(
        w.cast("int").alias("w"), h.cast("int").alias("h"), q.cast("int").alias("q"), dpr.alias("dpr"), original.alias("original"),
        *[get(k).alias(k) for k in ("crop", "thumb", "rot", "bg", "f", "token")], bad.alias("bad"),
    )


def scale_side(side: Column, dpr: Column) -> Column:
    """side x dpr in single precision, rounded half away from zero, kept in 0..65535."""
    product = side.cast("float") * F.coalesce(dpr, F.lit(1.0)).cast("float")
    x = product.cast("double")
    rounded = F.when(F.isnan(x) | (x <= 0), 0.0).when(x >= U16, float(U16)).otherwise(F.floor(x + 0.5))
    return F.when(side.isNotNull(), F.least(F.lit(U16), rounded.cast("int")))


def parse_format(f: Column) -> Column:
    return lookup(FORMATS, f, "auto")


def parse_rotate(rot: Column) -> Column:
    """Degrees clockwise."""
    return lookup(ROTATIONS, rot, 0)


def parse_origin(gravity: Column) -> Column:
    return lookup(ORIGINS, gravity, "center")


def _rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), a.cast("int").alias("a"))


def parse_background(bg: Column) -> Column:
    """A named colour, r,g,b[,a] or 6 or 8 hexadecimal digits as an RGBA struct; else null."""
    out = F.when(bg.isNull(), F.lit(None).cast("struct<r:int,g:int,b:int,a:int>"))
    for name, channels in COLOURS.items():
        out = out.when(bg == name, _rgba(*map(F.lit, channels)))
    parts = F.split(bg, ",")
    dec = [strict_int(F.get(parts, F.lit(i)), 0, U8) for i in range(4)]
    n = F.size(parts)
    listed = dec[0].isNotNull() & dec[1].isNotNull() & dec[2].isNotNull() & ((n == 3) | ((n == 4) & dec[3].isNotNull()))
    pair = lambda i: F.regexp_replace(F.substring(bg, 2 * i + 1, 2), r"^\+", "0")
    byte = lambda i: F.conv(pair(i), 16, 10)
    hexed = bg.rlike(r"^([0-9a-fA-F+][0-9a-fA-F]){3,4}$")
    out = out.when(bg.contains(","), F.when(listed, _rgba(*dec[:3], F.when(n == 4, dec[3]).otherwise(255))))
    return out.when(hexed, _rgba(byte(0), byte(1), byte(2), F.when(F.length(bg) == 8, byte(3)).otherwise(255)))


def background_vector(bg: Column) -> Column:
    """RGBA as doubles; null for no background."""
    return F.when(bg.isNotNull(), F.array(*[bg[c].cast("double") for c in "rgba"]))


def flatten_colour(bg: Column) -> Column:
    """The three colours that an encoder without alpha flattens onto; empty for no background."""
    return F.coalesce(F.slice(background_vector(bg), 1, 3), F.array().cast("array<double>"))


def is_transparent(bg: Column) -> Column:
    return F.coalesce(bg["a"] == 0, F.lit(False))


def parse_crop(crop: Column) -> Column:
    """ratio,width,height,gravity,x,y by position; null without a known ratio, and for a free ratio
    without both sides."""
    parts = F.split(crop, ",")
    at = lambda i: F.get(parts, F.lit(i))
    ratio = F.split(at(0), ":")
    rw, rh = strict_int(F.get(ratio, F.lit(0)), 0, U8), strict_int(F.get(ratio, F.lit(1)), 0, U8)
    named = at(0).isin(*NAMED_RATIOS)
    custom = rw.isNotNull() & rh.isNotNull()
    positive = lambda x: F.when(x > 0, x).cast("int")
    width, height = positive(strict_int(at(1), 0, U16)), positive(strict_int(at(2), 0, U16))
    offset = lambda i: F.coalesce(strict_int(at(i), -32768, 32767, signed=True), F.lit(0)).cast("int")
    kind = F.struct(F.when(named, at(0)).otherwise("custom").alias("kind"), F.when(~named, rw).cast("int").alias("w"), F.when(~named, rh).cast("int").alias("h"))
    found = F.struct(kind.alias("ratio"), width.alias("width"), height.alias("height"), parse_origin(at(3)).alias("gravity"), offset(4).alias("dx"), offset(5).alias("dy"))
    complete = (at(0) != "free") | (width.isNotNull() & height.isNotNull())
    return F.when(crop.isNotNull() & (named | custom) & complete, found)


def parse_thumb(thumb: Column) -> Column:
    """The page asked for by the last p:N, from 1; 1 by default and for what is no number."""
    pages = F.filter(F.split(F.coalesce(thumb, F.lit("")), ","), lambda p: F.substring_index(p, ":", 1) == "p")
    page = strict_int(F.substring_index(F.try_element_at(pages, F.lit(-1)), ":", -1), 0, U32)
    return F.greatest(F.coalesce(page, F.lit(1)), F.lit(1)).cast("long")
