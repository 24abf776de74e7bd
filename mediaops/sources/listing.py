"""Listing large folders over tasks, and a stream of what changes below a folder.

Tasks open the folder through Arrow's file systems, so roots are paths or URIs that these know.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from mediaops.functions.formats import file_stem
from mediaops.session import cut, with_workers

ENTRY = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("modified_at", pa.timestamp("us", "UTC")), ("length", pa.int64())])
#: Rows of one Arrow batch of a listing, and bytes of file contents in one.
ROWS, BYTES = 10_000, 1 << 26


def opened(root: str) -> tuple[pa_fs.FileSystem, str]:
    fs, base = pa_fs.FileSystem.from_uri(root)
    return fs, base.rstrip("/")


def entries(fs: pa_fs.FileSystem, base: str, folder: str, deep: bool) -> Iterator[tuple]:
    """(path below base, is folder, time, length) of what a folder holds; one that is gone holds nothing.

    Local folders are read entry by entry. Arrow lists a folder of other stores as a whole: there the
    entries of one folder, not of all below it, are held at a time."""
    local = isinstance(fs, pa_fs.LocalFileSystem)
    folders = [folder]
    while folders:
        at = folders.pop()
        for entry in _scanned(base, at) if local else _selected(fs, base, at):
            if deep and entry[1]:
                folders.append(entry[0])
            yield entry


def _selected(fs: pa_fs.FileSystem, base: str, folder: str) -> Iterator[tuple]:
    for e in fs.get_file_info(pa_fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
        is_dir = e.type == pa_fs.FileType.Directory
        yield e.path[len(base) + 1 :], is_dir, e.mtime_ns // 1000 if e.mtime_ns is not None else None, None if is_dir else e.size


def _scanned(base: str, folder: str) -> Iterator[tuple]:
    with contextlib.suppress(FileNotFoundError), os.scandir(f"{base}/{folder}" if folder else base or "/") as found:
        for e in found:
            try:
                s = e.stat()
            except OSError:  # gone, or a link to nothing
                continue
            yield f"{folder}/{e.name}" if folder else e.name, stat.S_ISDIR(s.st_mode), s.st_mtime_ns // 1000, s.st_size if stat.S_ISREG(s.st_mode) else None


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def list_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """All files under ``root``: path (below it), modified_at and length. The first ``depth`` levels are
    listed one after the other, the folders of each dealt over all tasks; below them each task walks
    its own folders. The driver lists nothing. Hidden files are listed like others."""
    with_workers(spark)
    tasks = spark.sparkContext.defaultParallelism

    def run(deep: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = opened(root)
            yield from _batches((e for b in batches for folder in b.column(0).to_pylist() for e in entries(fs, base, folder, deep)), ENTRY)

        return work

    folders, out = spark.createDataFrame([("",)], "path string"), []
    schema = "path string, is_dir boolean, modified_at timestamp, length long"
    for _ in range(depth):
        level = cut(folders.mapInArrow(run(False), schema), "listing")
        out.append(level)
        folders = level.filter("is_dir").select("path").repartition(4 * tasks, F.rand(1))
    out.append(folders.mapInArrow(run(True), schema))
    files = out[0]
    for more in out[1:]:
        files = files.unionByName(more)
    return files.filter("not is_dir").select("path", "modified_at", "length")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Adds ``content`` to rows with a ``path`` below ``root``, read by the task that has the row; null
    for a file that is gone. A file asked for in rows that follow one another is read once."""
    with_workers(files.sparkSession)
    at = files.columns.index("path")
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        last: tuple[str | None, bytes | None] = (None, None)
        for batch in batches:
            begun, held, size = 0, [], 0
            for n, path in enumerate(batch.column(at).to_pylist()):
                if path != last[0]:
                    data = None
                    if path is not None:
                        with contextlib.suppress(FileNotFoundError), fs.open_input_stream(f"{base}/{path}") as f:
                            data = f.read()
                    last = path, data
                held.append(last[1])
                size += len(last[1] or b"")
                if size >= BYTES or n + 1 == batch.num_rows:
                    part = batch.slice(begun, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])
                    begun, held, size = n + 1, [], 0

    return files.mapInArrow(run, schema)


def read_index_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """Every *.index file below ``root``, listed and read by tasks: stem, path (its content, the source)
    and written_at (the file's time), as ``files.read_cache_index`` has them. What is listed is dealt
    anew before it is read, so that a folder with most of the files is read by all tasks."""
    found = list_files(spark, root, depth).filter(F.col("path").endswith(".index") & ~F.col("path").rlike("(^|/)([.]|_[^/=]*(/|$))"))
    found = found.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return with_content(found, root).filter("content is not null").select(file_stem(F.col("path")).alias("stem"), F.btrim(F.col("content").cast("string"), F.lit(" \r\n")).alias("path"), F.col("modified_at").alias("written_at"))


# --- changes as a stream ---------------------------------------------------------------------------------


@dataclass
class _Bucket(InputPartition):
    number: int
    start: int
    end: int


class AssetChangeReader(DataSourceStreamReader):
    """An offset is the number of a listing. A task lists the entries of the top folder that are dealt to
    its bucket, keeps that as its part of the new listing, and gives what differs from the old part.
    A listing that stands is never made anew, so a batch that runs again gives the same rows."""

    def __init__(self, options: dict):
        self.root, self.state, self.buckets = options["root"], options["state"].rstrip("/"), int(options.get("buckets", "8"))

    def listings(self) -> list[int]:
        fs, base = opened(self.state)
        return sorted(int(e.base_name) for e in fs.get_file_info(pa_fs.FileSelector(base, allow_not_found=True)) if re.fullmatch("[0-9]+", e.base_name))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        return {"listing": max(self.listings(), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Bucket(n, start["listing"], end["listing"]) for n in range(self.buckets)]

    def commit(self, end: dict) -> None:
        fs, base = opened(self.state)
        for n in self.listings():
            if n < end["listing"]:
                fs.delete_dir(f"{base}/{n}")

    def _kept(self, listing: int, bucket: int) -> dict[str, tuple] | None:
        fs, base = opened(self.state)
        at = f"{base}/{listing}/{bucket}.parquet"
        if fs.get_file_info(at).type == pa_fs.FileType.NotFound:
            return None
        t = pq.read_table(at, filesystem=fs)
        return dict(zip(t["path"].to_pylist(), zip(t["modified_at"].to_pylist(), t["length"].to_pylist(), strict=True), strict=True))

    def _listed(self, listing: int, bucket: int) -> None:
        (fs, base), (to, kept) = opened(self.root), opened(self.state)
        rows = []
        for name, is_dir, at, size in entries(fs, base, "", False):
            if zlib.crc32(name.encode()) % self.buckets == bucket:
                rows += [(p, t, n) for p, d, t, n in entries(fs, base, name, True) if not d] if is_dir else [(name, at, size)]
        schema = pa.schema([ENTRY.field("path"), ENTRY.field("modified_at"), ENTRY.field("length")])
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else schema.empty_table().columns, schema=schema)
        to.create_dir(f"{kept}/{listing}", recursive=True)
        draft = f"{kept}/{listing}/.{bucket}-{id(table)}"
        pq.write_table(table, draft, filesystem=to)
        to.move(draft, f"{kept}/{listing}/{bucket}.parquet")

    def read(self, partition: _Bucket) -> Iterator[pa.RecordBatch]:
        old = self._kept(partition.start, partition.number) if partition.start else {}
        if old is None:
            raise RuntimeError(f"part {partition.number} of listing {partition.start} is missing from {self.state}: start with a new checkpoint and state")
        if (new := self._kept(partition.end, partition.number)) is None:
            self._listed(partition.end, partition.number)
            new = self._kept(partition.end, partition.number) or {}
        rows = [(p, "added" if p not in old else "changed", *v) for p, v in new.items() if old.get(p) != v]
        rows += [(p, "deleted", *v) for p, v in old.items() if p not in new]
        schema = pa.schema([("path", pa.string()), ("change", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("length", pa.int64())])
        yield from _batches(iter(sorted(rows)), schema)


class AssetChanges(DataSource):
    """Streaming source ``asset_changes``; options root, state (a folder that all executors share) and
    buckets (tasks of a listing)."""

    @classmethod
    def name(cls) -> str:
        return "asset_changes"

    def schema(self) -> str:
        return "path string, change string, modified_at timestamp, length long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AssetChangeReader(dict(self.options))


def asset_changes(spark: SparkSession, root: str, state: str, buckets: int = 8) -> DataFrame:
    """What changes below ``root`` as a stream: path, change (added, changed, deleted), modified_at and
    length; a file counts as changed if its time or its length differs, and a deleted one has its last
    ones. Each trigger lists the folder once, over ``buckets`` tasks that hold one part of the
    entries of the top folder; give a trigger interval. ``state`` belongs to one checkpoint: it holds
    the last listing, and older ones go when a batch is committed."""
    with_workers(spark).dataSource.register(AssetChanges)
    return spark.readStream.format("asset_changes").options(root=root, state=state, buckets=buckets).load()
