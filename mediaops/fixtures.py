"""Request, change and asset tables derived from the driver's event table.

The same derivations stand as SQL in ``queries``; integer arithmetic only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".jpg", ".JPEG", ".png", ".webp", ".svg", ".pdf", ".docx", ".gif", ".tiff", ".txt", "", ".tar.png"]
ACCEPTS = ["image/avif,image/webp,*/*", "image/webp,*/*", "*/*", None]
KEY = "studio-key"


def _pick(table: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), index.cast("int"))


def _or_empty(n: Column, *choices: str) -> Column:
    out = F.when(F.lit(False), "")
    for i, c in enumerate(choices):
        out = out.when(n == i, c)
    return out.otherwise("")


def with_paths(ev: DataFrame) -> DataFrame:
    """Events with k, f and their asset path."""
    k = F.col("event_id") % 720
    f = (k * 31) % 97
    path = F.concat(F.lit("data/d"), (k % 7).cast("string"), F.lit("/f"), f.cast("string"), _pick(EXTENSIONS, f % 12))
    return ev.select("event_id", "ts", "user_id", "event_type", k.alias("k"), f.alias("f"), path.alias("path"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_paths(spark.read.parquet(f"{sf_dir}/events.parquet"))


def query_text() -> Column:
    k = F.col("k")
    width = F.when(k % 6 == 0, "w=320").when(k % 6 == 1, "w=160&dpr=2").when(k % 6 == 2, "h=200&w=").otherwise(F.concat(F.lit("w="), (1 + (k * 37) % 4000).cast("string")))
    return F.concat(
        width, _or_empty(k % 5, "&rot=left", "&rot=180", "&rot=sideways"), _or_empty(k % 11, "&bg=white", "&bg=12,34,56", "&bg=1234567f", "&bg=%23ffffff", "&bg=12,34"),
        _or_empty(k % 7, "&f=png", "&f=jpeg", "&f=pdf", "&f=bogus"), _or_empty(k % 9, "&thumb=p:3", "&thumb=p:0,p:x", "&crop=video,100,0,top,5", "&crop=free,10", "&q=50", "&q=999"),
        _or_empty(k % 13, "&original=true", "&original=yes"),
    )


def as_requests(ev: DataFrame) -> DataFrame:
    return ev.filter("event_type <> 'purchase'").select(
        F.col("event_id").alias("req_id"), "ts", F.col("user_id").alias("client"), "path", query_text().alias("query"), _pick(ACCEPTS, F.col("k") % 4).alias("accept")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, ts, client, path, query, accept."""
    return as_requests(events(spark, sf_dir))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, path, changed_at."""
    return events(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("change_id"), "path", F.col("ts").alias("changed_at"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, width, height, has_alpha, n_pages, length, modified_at, orientation of the files that exist;
    JPEG files stand in any of the eight orientations."""
    f = F.col("f")
    paths = events(spark, sf_dir).filter(f % 10 != 3).select("path", "f").distinct()
    return paths.select(
        "path", (200 + (f * 977) % 20000).cast("int").alias("width"), (100 + (f * 577) % 9000).cast("int").alias("height"), (f % 2 == 0).alias("has_alpha"), (1 + f % 5).cast("int").alias("n_pages"), (1000 + f * 7919).alias("length"),
        F.timestamp_add("DAY", (f % 20).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("modified_at"), F.when(f % 12 < 2, 1 + f % 8).otherwise(1).cast("int").alias("orientation"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access-log line per request, in the server's log format."""
    r = requests(spark, sf_dir)
    n = F.col("req_id")
    line = F.format_string(
        '[%s] "GET /%s?%s HTTP/1.1" %s %s "%s" "agent/%s"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "path", "query",
        _pick([200, 404, 500], n % 3).cast("string"), (n * 13 % 5000).cast("string"), F.when(n % 4 == 0, "-").otherwise(F.concat(F.lit("https://example.com/"), (n % 10).cast("string"))), (n % 5).cast("string"),
    )
    return r.select("req_id", line.alias("value"))


def signed_tokens(correct: Column) -> Column:
    """A request's token: none, spoilt, in upper case, no hexadecimal, or correct."""
    n = F.col("req_id") % 5
    spoilt = F.concat(F.when(F.substring(correct, 1, 1) == "0", "1").otherwise("0"), F.substring(correct, 2, 64))
    return F.when(n == 1, spoilt).when(n == 2, F.upper(correct)).when(n == 3, F.lit("zz")).when(n == 4, correct)


def image_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, source_id, height, width, channels and px, 2 x 8 RGBA images made of embeddings."""
    px = F.transform("embedding", lambda x: F.greatest(F.least(F.floor((x.cast("double") + 1.0) * 127.5), F.lit(255)), F.lit(0)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 9).alias("source_id"), F.lit(2).alias("height"), F.lit(8).alias("width"), F.lit(4).alias("channels"), px.alias("px"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image_file(image_id: int, px: list[int]) -> tuple[str, bytes]:
    """Name and bytes of a file made of an image id and 2 x 8 RGBA pixels: in turn an uncompressed PNG of
    these, and a JPEG and a GIF that consist of a header with sizes (and orientation) by the id."""
    w, h = 1 + image_id % 500, 1 + image_id % 300
    if image_id % 3 == 0:
        raw = b"".join(b"\0" + bytes(px[32 * y : 32 * y + 32]) for y in range(2))
        return f"png/{image_id}.png", b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 2, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 0)) + _chunk(b"IEND", b"")
    if image_id % 3 == 1:
        exif = b"Exif\0\0II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 1 + image_id % 8, 0) + b"\0\0\0\0"
        frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00"
        return f"jpg/{image_id}.jpg", b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + frame + b"\xff\xd9"
    return f"gif/{image_id}.gif", b"GIF89a" + struct.pack("<HH", w, h) + b"\0\0\0;"


def container_file(image_id: int) -> tuple[str, bytes]:
    """Name and bytes of a file without pixels, in turn of eight kinds: TIFF of some directories, PNG with
    a palette, GIF of some frames, WebP with and without an extended header, AVIF, SVG and PDF. Sizes,
    transparency (every third id) and pages follow from the id."""
    w, h, pages, clear = 1 + image_id % 500, 1 + image_id % 300, 1 + image_id % 4, image_id % 3 == 0
    kind = image_id % 8
    if kind == 0:
        tags = [(256, w), (257, h), (262, 2), (274, 1 + image_id % 8), (277, 4 if clear else 3)]
        size = 2 + 12 * len(tags) + 4
        page = lambda n: struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 3, 1, v) for t, v in tags) + struct.pack("<I", 8 + size * (n + 1) if n + 1 < pages else 0)
        return f"tiff/{image_id}.tiff", b"II*\0" + struct.pack("<I", 8) + b"".join(map(page, range(pages)))
    if kind == 1:
        tail = (_chunk(b"tRNS", b"\0") if clear else b"") + _chunk(b"IDAT", b"") + _chunk(b"IEND", b"")
        return f"png/{image_id}.png", b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)) + _chunk(b"PLTE", b"\0\0\0") + tail
    if kind == 2:
        frame = b"\x21\xf9\x04" + bytes([clear]) + b"\0\0\0\0" + b"\x2c" + struct.pack("<HHHH", 0, 0, w, h) + b"\0\x02\x02\x4c\x01\0"
        return f"gif/{image_id}.gif", b"GIF89a" + struct.pack("<HH", w, h) + b"\x80\0\0" + bytes(6) + frame * pages + b";"
    if kind in (3, 4):
        riff = lambda name, data: name + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
        side = lambda n: struct.pack("<I", n - 1)[:3]
        lossless = riff(b"VP8L", b"\x2f" + struct.pack("<I", w - 1 | h - 1 << 14 | clear << 28))
        body = lossless if kind == 4 else riff(b"VP8X", bytes([16 * clear + 2, 0, 0, 0]) + side(w) + side(h)) + riff(b"ANMF", bytes(16)) * pages
        return f"webp/{image_id}.webp", riff(b"RIFF", b"WEBP" + body)
    if kind == 5:
        box = lambda name, *data: struct.pack(">I", 8 + len(b"".join(data))) + name + b"".join(data)
        alpha = [box(b"auxC", bytes(4), b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")] if clear else []
        own = box(b"ipco", box(b"ispe", struct.pack(">III", 0, w, h)), box(b"ispe", struct.pack(">III", 0, 1, 1)), *alpha)
        return f"avif/{image_id}.avif", box(b"ftyp", b"avif", bytes(4)) + box(b"meta", bytes(4), box(b"iprp", own))
    if kind == 6:
        return f"svg/{image_id}.svg", f'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}"></svg>'.encode()
    tree = f"<< /Type /Pages /Resources << /A << >> >> /Kids [{' '.join(f'{k + 3} 0 R' for k in range(pages))}] /Count {pages} /MediaBox [0 0 {w} {h}] >>".encode()
    leaf = b"<< /Type /Pages /Parent 2 0 R /Count 900 >>"
    if not clear:
        return f"pdf/{image_id}.pdf", b"%PDF-1.7\n2 0 obj " + tree + b" endobj\n3 0 obj " + leaf + b" endobj\n"
    packed = zlib.compress(b"2 0 3 90 " + tree + b" " + leaf)
    return f"pdf/{image_id}.pdf", b"%PDF-1.7\n9 0 obj << /Type /ObjStm /N 2 /Filter /FlateDecode >> stream\r\n" + packed + b"\r\nendstream endobj\n"


def write_files(df: DataFrame, root: str, make: Callable[..., tuple[str, bytes]]) -> None:
    """One file under ``root`` for each row: make(*columns) gives its name and bytes. Rows are dealt over all
    tasks, which write through Arrow's file systems; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa_fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, data = make(*row)
                at = f"{base}/{name}"
                if (folder := at.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(at) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def remove_files(names: DataFrame, root: str) -> None:
    """Deletes the files ``path`` below ``root``, in tasks; those that are gone stay so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa_fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if fs.get_file_info(f"{base}/{path}").is_file:
                    fs.delete_file(f"{base}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    names.select("path").mapInArrow(run, "n long").agg(F.sum("n")).collect()
