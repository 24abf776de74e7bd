"""Sizes as Column functions; all results are struct<w int, h int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaops.functions.parsing import U16


def nearest(x: Column) -> Column:
    """Half away from zero, for values not below zero."""
    return F.floor(x + 0.5)


def _to_u16(x: Column) -> Column:
    """Rounded and saturated to 0..65535; a NaN is 0."""
    return F.when(F.isnan(x), 0).when(x >= U16, U16).otherwise(nearest(x)).cast("int")


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))


def quarter_turn(rotate: Column) -> Column:
    return rotate.isin(90, 270)


def target_dims(w: Column, h: Column, src_w: Column, src_h: Column) -> Column:
    """A missing side follows from the source's ratio; without any side the source's width holds."""
    ratio = src_w.cast("double") / F.nullif(src_h.cast("double"), F.lit(0.0))
    given_w = F.when(w.isNull() & h.isNull(), src_w.cast("int").bitwiseAND(F.lit(U16))).otherwise(w)
    out_w = F.coalesce(given_w, _to_u16(h.cast("double") * ratio))
    out_h = F.coalesce(h, _to_u16(out_w.cast("double") / F.nullif(ratio, F.lit(0.0))))
    return _size(out_w, out_h)


def pipeline_dims(w: Column, h: Column, rotate: Column, src_w: Column, src_h: Column) -> Column:
    """target_dims with the sides swapped for quarter turns, since the turn follows the resize."""
    turned = quarter_turn(rotate)
    return target_dims(F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h), src_w, src_h)


def rasterize_dims(size: Column, rotate: Column, src_w: Column, src_h: Column) -> Column:
    """The size at which a vector or page source is loaded, from ``size`` of target_dims."""
    tw, th = size["w"], size["h"]
    long_side = nearest(src_h.cast("double") * (tw.cast("double") / src_h.cast("double")))
    other = nearest(src_w.cast("double") * (tw.cast("double") / src_h.cast("double")))
    return F.when(~quarter_turn(rotate), _size(tw, th)).when(tw > th, _size(th + 2, long_side)).otherwise(_size(other, tw + 2))


def output_dims(box: Column, resize: Column, rotate: Column, src_w: Column, src_h: Column) -> Column:
    """The final size: shrunk to cover ``box`` (of pipeline_dims) and cut to it, never enlarged, then
    turned. Where ``resize`` is false, no side was requested and the source's size stays."""
    sw, sh = src_w.cast("double"), src_h.cast("double")
    shrink = F.greatest(F.lit(1.0), F.least(sw / F.nullif(box["w"].cast("double"), F.lit(0.0)), sh / F.nullif(box["h"].cast("double"), F.lit(0.0))))
    w = F.when(resize, F.least(box["w"], nearest(sw / shrink).cast("int"))).otherwise(src_w)
    h = F.when(resize, F.least(box["h"], nearest(sh / shrink).cast("int"))).otherwise(src_h)
    turned = quarter_turn(rotate)
    return _size(F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h))


def clamp_page(page: Column, n_pages: Column) -> Column:
    """The page counted from 0, the last one at most."""
    return F.least(page - 1, n_pages.cast("long") - 1)
