"""Files as tables: originals, images, headers and cache indexes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.functions.formats import file_extension, file_stem
from mediaops.session import with_workers
from mediaops.sources.headers import Header, Ranges, probe
from mediaops.sources.listing import opened, read_index_files, with_content

#: Tasks that may share the requests of one path.
SPREAD = 8


def relative_path(path: Column, root: str) -> Column:
    """The path below the root, percent signs decoded, without scheme."""
    bare = root.rstrip("/").split("://")[-1]
    bare = bare[bare.index(":") + 1 :] if bare.startswith("file:") else bare
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path), "^.*?" + _quoted(bare) + "/", "")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def scan_assets(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files under ``root``, one row each: path (relative), modified_at, length and content, which
    is read only where it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    return df.select(relative_path(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified_at"), "length", "content")


def asset_inventory(assets: DataFrame) -> DataFrame:
    """path, ext, stem, length and modified_at (the later of modification and ``changed_at``, where
    there is such a column); contents are not read."""
    at = F.greatest("modified_at", "changed_at") if "changed_at" in assets.columns else F.col("modified_at")
    return assets.select("path", file_extension(F.col("path")).alias("ext"), file_stem(F.col("path")).alias("stem"), "length", at.alias("modified_at"))


def scan_images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded raster files: path, height, width, nChannels, mode, data (rows of BGR or BGRA bytes) and
    ``error`` for files that cannot be decoded, which stay unless dropped."""
    df = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(root)
    img = [F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "mode", "data")]
    return df.select(relative_path(F.col("image.origin"), root).alias("path"), *img, F.when(F.col("image.width") < 0, "undecodable").alias("error"))


HEADER = "image_type string, width long, height long, has_alpha boolean, orientation int, n_pages int"
#: Bytes of a file that are enough for nearly all headers; GIF, TIFF and PDF files are walked to their end.
HEAD = 1 << 16


def _headers(content: pd.Series) -> pd.DataFrame:
    rows = [(probe(Ranges(bytes(c), len(c))) if c is not None else None) or (None,) * 6 for c in content]
    out = pd.DataFrame(rows, columns=list(Header._fields))
    return out.astype({"width": "Int64", "height": "Int64", "has_alpha": "boolean", "orientation": "Int32", "n_pages": "Int32"})


def _probed_ranges(assets: DataFrame, root: str) -> DataFrame:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            rows = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                found = None
                with contextlib.suppress(FileNotFoundError, IsADirectoryError):
                    if path is not None:
                        with fs.open_input_file(f"{base}/{path}") as f:
                            found = probe(Ranges(f, f.size()))
                rows.append(found or (None,) * 6)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *Header._fields])

    kept = assets.select("path", *(c for c in ("length", "modified_at") if c in assets.columns))
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes)
    return kept.repartition(4 * assets.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(run, f"{schema}, {HEADER}")


def probe_assets(assets: DataFrame, root: str | None = None) -> DataFrame:
    """path, image_type, width, height, has_alpha, orientation and n_pages from headers, pixels undecoded,
    with length and modified_at where ``assets`` has them: a table that ``attach_assets`` takes.

    With ``root`` the tasks open the files below it and read only the ranges that a header walk
    enters; ``assets`` needs no contents. Without it they are taken from ``content``: first the head
    of a file alone, then the whole of those that it does not settle. Files of other kinds, broken
    ones and those that are gone have null values."""
    with_workers(assets.sparkSession)
    if root is not None:
        return _probed_ranges(assets, root)
    header = F.pandas_udf(_headers, HEADER)
    c, head = F.col("content"), F.hex(F.substring("content", 1, 4))
    walked = head.startswith("47494638") | head.isin("49492A00", "4D4D002A", "49492B00", "4D4D002B") | (head == "25504446")
    df = assets.withColumn("_first", header(F.when(walked, c).otherwise(F.substring("content", 1, HEAD))))
    df = df.withColumn("_then", header(F.when(F.col("_first.image_type").isNull() & ~walked & (F.length(c) > HEAD), c)))
    fields = [F.coalesce(f"_first.{f}", f"_then.{f}").alias(f) for f in Header._fields]
    return df.select("path", *(c for c in ("length", "modified_at") if c in assets.columns), *fields)


def read_cache_index(spark: SparkSession, root: str) -> DataFrame:
    """Every *.index file: stem, path (its content, the source) and written_at (the file's time).

    Tasks list and read a folder that Arrow can open; files and folders whose name begins with a dot
    or, without an equals sign, with an underscore are hidden, as from Spark's readers. Globs, single
    files and stores that Arrow doesn't know are left to Spark's reader, which lists on the driver
    and opens 32 small files a task."""
    try:
        fs, base = opened(root)
        known = fs.get_file_info(base or "/").type == pa_fs.FileType.Directory
    except (pa.ArrowException, OSError, ImportError):
        known = False
    return read_index_files(spark, root) if known else _read_by_spark(spark, root)


def _read_by_spark(spark: SparkSession, root: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.index").text(root, wholetext=True)
    return df.select(file_stem(relative_path(F.col("_metadata.file_path"), root)).alias("stem"), F.btrim("value", F.lit(" \r\n")).alias("path"), F.col("_metadata.file_modification_time").alias("written_at"))


def select_originals(routed: DataFrame, assets: DataFrame, root: str | None = None) -> DataFrame:
    """The unmodified bytes of requests that are passed through: req_id, path, length and content.

    With ``root`` no content is shuffled: requests meet the listed files by path, those of a path
    are dealt to a few tasks and stand side by side there, and each task reads a file once."""
    asked = routed.filter("outcome = 'original'").select("req_id", "path")
    if root is None:
        return asked.join(assets.select("path", "length", "content"), "path")
    found = asked.join(assets.select("path", "length"), "path").repartition("path", F.pmod(F.xxhash64("req_id"), F.lit(SPREAD))).sortWithinPartitions("path")
    return with_content(found, root).filter("content is not null")
