"""Pixel transforms on tables of decoded images.

Images are columns height, width, nChannels and data (rows of interleaved bytes; colours stand as
blue, green, red and alpha). Spark deals out the images; a numpy kernel works on one image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.session import with_workers

PIXELS = ("height", "width", "nChannels", "data")
#: Renditions of one source that one row asks for.
CHUNK = 64
TRANSPARENT = {"r": 0, "g": 0, "b": 0, "a": 0}


def turn(img: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.rot90(img, -(degrees // 90) % 4)


def orient(img: np.ndarray, orientation: int | None) -> np.ndarray:
    """Undo an EXIF orientation of 1 to 8; other values leave the image."""
    steps = {2: (True, 0), 3: (False, 180), 4: (True, 180), 5: (True, 270), 6: (False, 90), 7: (True, 90), 8: (False, 270)}
    mirrored, degrees = steps.get(orientation or 1, (False, 0))
    return turn(img[:, ::-1] if mirrored else img, degrees)


def stretch_sums(x: np.ndarray, n: int, out: int, top: int = 0) -> tuple[int, np.ndarray]:
    """Of rows ``top`` and on of ``n``, which are dealt to ``out`` equal stretches: the first stretch they
    reach, and for each the sum of its rows times ``out``, rows that lie in two by their parts. Sums
    are whole numbers, so those of several strips add up to the same, in any order."""
    m = len(x)
    first, last = top * out // n, -(-(top + m) * out // n)
    total = np.zeros((m + 1, *x.shape[1:]), np.int64)
    np.cumsum(x, axis=0, out=total[1:])
    at = np.clip(np.arange(first, last + 1) * n - top * out, 0, m * out)
    row, part = at // out, (at % out).reshape(-1, *[1] * (x.ndim - 1))
    return first, np.diff(total[row] * out + part * x[np.minimum(row, m - 1)].astype(np.int64), axis=0)


def _rounded(sums: np.ndarray, n: int) -> np.ndarray:
    """sums / n, halves up."""
    return ((2 * sums + n) // (2 * n)).astype(np.uint8)


def _strip_sums(img: np.ndarray, height: int, w: int, h: int, top: int = 0) -> tuple[int, np.ndarray]:
    """Sums over both directions, by strips of columns, so that few pixels are held as numbers of 8 bytes."""
    parts = [stretch_sums(img[:, at : at + 512], height, h, top) for at in range(0, img.shape[1], 512)]
    rows = np.concatenate([p for _, p in parts], axis=1).swapaxes(0, 1)
    return parts[0][0], stretch_sums(rows, img.shape[1], w)[1].swapaxes(0, 1)


def _shrunk(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area averages in w x h."""
    return _rounded(_strip_sums(img, len(img), w, h)[1], img.shape[0] * img.shape[1])


def covering(sw: int, sh: int, w: int, h: int) -> tuple[int, int, int, int]:
    """Width and height to which a source is shrunk to just cover a box, and where the box begins there."""
    shrink = max(1.0, min(sw / w, sh / h))
    tw, th = int(sw / shrink + 0.5), int(sh / shrink + 0.5)
    return tw, th, max(0, (tw - w) // 2), max(0, (th - h) // 2)


def cover(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Shrink by area averages until the box is just covered, then cut its centre; never enlarge."""
    sh, sw = img.shape[:2]
    tw, th, left, top = covering(sw, sh, w, h)
    if (tw, th) != (sw, sh):
        img = _shrunk(img, tw, th)
    return img[top : top + h, left : left + w]


def _with_alpha(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 4:
        return img
    colours = np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img
    return np.concatenate([colours, np.full((*img.shape[:2], 1), 255, np.uint8)], axis=2)


def over_colour(img: np.ndarray, bg: dict) -> np.ndarray:
    """The image over an RGBA colour (source-over), with four channels."""
    x = _with_alpha(img).astype(float)
    colour, ab = np.array([bg["b"], bg["g"], bg["r"]], float), bg["a"] / 255
    af = x[:, :, 3:] / 255
    a = af + ab * (1 - af)
    c = (x[:, :, :3] * af + colour * ab * (1 - af)) / np.where(a > 0, a, 1)
    return np.floor(np.concatenate([np.where(a > 0, c, 0), a * 255], axis=2) + 0.5).astype(np.uint8)


def without_alpha(img: np.ndarray, bg: dict | None) -> np.ndarray:
    """Alpha dropped against a colour, black unless given; images without alpha stay."""
    if img.shape[2] != 4:
        return img
    bg = bg or TRANSPARENT
    af = img[:, :, 3:].astype(float) / 255
    return np.floor(img[:, :, :3] * af + np.array([bg["b"], bg["g"], bg["r"]], float) * (1 - af) + 0.5).astype(np.uint8)


def map_images(images: DataFrame, kernel: Callable[[np.ndarray, dict], np.ndarray], **inputs: Column) -> DataFrame:
    """Replace each image by kernel(pixels, inputs of its row). Rows without pixels, and those with a
    negative size (undecodable), pass unchanged. Batches are kept small: rows are large."""
    with_workers(images.sparkSession)
    names = images.columns
    df = images.select("*", F.struct(*[c.alias(k) for k, c in inputs.items()], F.lit(0).alias("_")).alias("_in"))
    at = {c: names.index(c) for c in PIXELS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(0, batch.num_rows, 16):
                part = batch.slice(one, 16)
                cols = {c: part.column(i).to_pylist() for c, i in at.items()}
                for r, given in enumerate(part.column(len(names)).to_pylist()):
                    h, w, n, data = (cols[c][r] for c in PIXELS)
                    if data is None or h is None or h <= 0 or w <= 0:
                        continue
                    img = kernel(np.frombuffer(data, np.uint8).reshape(h, w, n), given)
                    cols["height"][r], cols["width"][r], cols["nChannels"][r] = img.shape
                    cols["data"][r] = np.ascontiguousarray(img).tobytes()
                arrays = [pa.array(cols[c], part.column(i).type) if (c := names[i]) in cols else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, images.schema)


def apply_orientation(images: DataFrame, orientation: str = "orientation") -> DataFrame:
    return map_images(images, lambda img, x: orient(img, x["o"]), o=F.col(orientation))


def rotate_images(images: DataFrame, degrees: Column | int) -> DataFrame:
    return map_images(images, lambda img, x: turn(img, x["d"] or 0), d=degrees if isinstance(degrees, Column) else F.lit(degrees))


def resize_cover(images: DataFrame, w: Column | int, h: Column | int) -> DataFrame:
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (("w", w), ("h", h))}
    return map_images(images, lambda img, x: cover(img, x["w"], x["h"]) if x["w"] and x["h"] else img, **given)


STRIP = "path string, height int, width int, nChannels int, top int, data binary"


def in_strips(images: DataFrame, rows: int) -> DataFrame:
    """Images (path and pixels) as strips of ``rows`` rows; undecodable ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, h, w, n, data = (batch.column(j)[i].as_py() for j in range(5))
                if data is None or h is None or h <= 0 or w <= 0:
                    continue
                for top in range(0, h, rows):
                    values = (path, h, w, n, top, data[top * w * n : (top + rows) * w * n])
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _STRIP_TYPES, strict=True)], _STRIP_NAMES)

    return images.select("path", *PIXELS).mapInArrow(run, STRIP)


_STRIP_NAMES = [c.split()[0] for c in STRIP.split(", ")]
_STRIP_TYPES = [pa.string(), *[pa.int32()] * 4, pa.binary()]


def resize_strips(strips: DataFrame, w: int, h: int) -> DataFrame:
    """resize_cover of images that come as strips (path, the whole image's height, width and nChannels, the
    strip's first row ``top``, its rows), of any heights and in any order, so that no task holds an
    image: path, height, width, nChannels, row and the row's pixels, equal to those of ``cover``.

    Each strip gives the whole-number sums of the output rows it reaches; those of one output row
    meet and are added one after the other."""
    with_workers(strips.sparkSession)
    held = f"{STRIP.replace('top', 'row')}"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, sh, sw, n, at, data = (batch.column(j)[i].as_py() for j in range(6))
                img = np.frombuffer(data, np.uint8).reshape(-1, sw, n)
                tw, th, left, top = covering(sw, sh, w, h)
                first, found = _strip_sums(img, sh, tw, th, at)
                found = np.ascontiguousarray(found[:, left : left + w], "<i8")
                rows = [(path, sh, sw, n, first + k - top, r.tobytes()) for k, r in enumerate(found) if 0 <= first + k - top < h]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _STRIP_TYPES, strict=True)], [*_STRIP_NAMES[:4], "row", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        total = None

        def out() -> pa.RecordBatch:
            path, sh, sw, n, row = last
            tw, th, left, top = covering(sw, sh, w, h)
            values = (path, min(h, th - top), min(w, tw - left), n, row, _rounded(total, sh * sw).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _STRIP_TYPES, strict=True)], [*_STRIP_NAMES[:4], "row", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                *key, data = (batch.column(j)[i].as_py() for j in range(6))
                part = np.frombuffer(data, "<i8")
                if tuple(key) == last:
                    total = total + part
                else:
                    if last is not None:
                        yield out()
                    last, total = tuple(key), part
        if last is not None:
            yield out()

    parts = strips.select(*_STRIP_NAMES).mapInArrow(sums, held)
    keys = [*_STRIP_NAMES[:4], "row"]
    return parts.repartition("path", "row").sortWithinPartitions(*keys).mapInArrow(added, held)


def assembled(rows: DataFrame) -> DataFrame:
    """Rows of resize_strips as images; each must fit one task."""
    data = F.array_sort(F.collect_list(F.struct("row", F.hex("data").alias("x"))))
    whole = rows.groupBy("path", *PIXELS[:3]).agg(data.alias("d"))
    return whole.select("path", *PIXELS[:3], F.unhex(F.array_join("d.x", "")).alias("data"))


def composite_background(images: DataFrame, bg: Column) -> DataFrame:
    """``bg``: an RGBA struct; where it is null the image stays."""
    return map_images(images, lambda img, x: over_colour(img, x["bg"]) if x["bg"] else img, bg=bg)


def flatten_alpha(images: DataFrame, bg: Column | None = None) -> DataFrame:
    return map_images(images, lambda img, x: without_alpha(img, x["bg"]), bg=F.lit(None).cast("struct<r:int,g:int,b:int,a:int>") if bg is None else bg)


RENDERED = "cache_key string, path string, output_format string, height int, width int, nChannels int, data binary, error string"


def render_one(img: np.ndarray, orientation: int | None, step: dict) -> np.ndarray:
    """All steps of one rendition in their order."""
    img = orient(img, orientation)
    if step["resize"]:
        img = cover(img, step["resize"]["w"], step["resize"]["h"])
    img = turn(img, step["rotate"] or 0)
    if step["composite"]:
        img = over_colour(img, step["composite"])
    return without_alpha(img, step["composite"]) if step["output_format"] == "jpg" else img


def render_variants(plan: DataFrame, images: DataFrame) -> DataFrame:
    """The renditions of a render plan: cache_key, path, output_format, the pixels, and error.

    Plan rows are gathered per source, at most about CHUNK to a row, and meet the images last: a
    source is decoded once for each such row, pixels are shuffled only if Spark finds the plan
    too large to broadcast. Sources that are missing or undecodable give rows with an error.
    ``images`` may have an ``orientation`` column.
    """
    with_workers(images.sparkSession)
    steps = plan.select("path", F.struct("cache_key", "output_format", "resize", "rotate", "composite").alias("step"))
    sizes = plan.groupBy("path").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("step.cache_key"), F.ceil(F.col("n") / CHUNK)).alias("part")
    grouped = steps.join(sizes, "path").select("path", "step", part).groupBy("path", "part").agg(F.collect_list("step").alias("steps"))
    images = images if "orientation" in images.columns else images.withColumn("orientation", F.lit(1))
    rows = grouped.join(images.select("path", "orientation", *PIXELS), "path", "left").select("path", "steps", "orientation", *PIXELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RENDERED.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.binary(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(("path", "steps", "orientation", *PIXELS))}
                error = "missing_source" if row["data"] is None and row["height"] is None else "undecodable" if (row["height"] or -1) <= 0 else None
                img = None if error else np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                out = []
                for step in row["steps"]:
                    if error:
                        out.append((step["cache_key"], row["path"], step["output_format"], None, None, None, None, error))
                    else:
                        done = render_one(img, row["orientation"], step)
                        out.append((step["cache_key"], row["path"], step["output_format"], *done.shape, np.ascontiguousarray(done).tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, RENDERED)


def from_arrays(df: DataFrame, px: str = "px") -> DataFrame:
    """Images whose pixels stand in an int array, as image columns."""
    data = F.unhex(F.array_join(F.transform(px, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return df.withColumnRenamed("channels", "nChannels").withColumn("data", data).drop(px)


def to_text(data: Column) -> Column:
    """The bytes as decimal numbers joined by commas."""
    byte = lambda i: F.conv(F.substring(F.hex(data), 2 * i - 1, 2), 16, 10)
    return F.when(F.length(data) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(data)), byte), ",")).otherwise("")
