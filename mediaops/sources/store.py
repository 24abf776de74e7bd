"""Renditions and their index behind one manifest: both show up together, or neither.

``root`` holds variants/dir=D/output_format=F, index/dir=D/output_format=F and manifests/N. Writers add
folders that no reader knows, then a manifest that lists the parts of the new snapshot; a manifest
is never overwritten, so of two writers one begins anew. Readers read the parts of one manifest.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaops.functions.formats import file_stem

#: Attempts of a writer that another one overtakes.
ATTEMPTS = 20


class Overtaken(Exception):
    """Another writer has made the next snapshot."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Versions that can be read, oldest first."""
    return [int(n) for n in _names(spark, f"{root}/manifests") if n.isdigit()]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version, parts and tags of a snapshot (the latest); an empty one where nothing is committed."""
    version = max(snapshots(spark, root), default=0) if version is None else version
    if not version:
        return {"version": 0, "parts": [], "tags": []}
    return json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(f"{root}/manifests/{version:012d}").collect()))


def _publish(spark: SparkSession, root: str, content: dict) -> None:
    """Puts a manifest in its place unless one stands there."""
    fs, folder = _hadoop(spark, f"{root}/manifests")
    fs.mkdirs(folder)
    _, draft = _hadoop(spark, f"{root}/manifests/.draft-{uuid.uuid4().hex}")
    _, place = _hadoop(spark, f"{root}/manifests/{content['version']:012d}")
    out = fs.create(draft, False)
    out.write(json.dumps(content).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context.rename(draft, place, spark.sparkContext._gateway.new_array(option, 0))
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Overtaken(str(content["version"])) from None
        raise


def _write(variants: DataFrame, root: str) -> list[str]:
    """Writes both tables into a folder of their own; its parts."""
    spark, name = variants.sparkSession, f"dir={uuid.uuid4().hex}"
    variants.write.partitionBy("output_format").parquet(f"{root}/variants/{name}")
    stem = F.col("stem") if "stem" in variants.columns else file_stem(F.col("cache_key")).alias("stem")
    again = spark.read.schema(variants.schema).parquet(f"{root}/variants/{name}")  # as they were written
    again.select(stem, "cache_key", "path", F.col("cached_at").alias("written_at"), "output_format").write.partitionBy("output_format").parquet(f"{root}/index/{name}")
    return [f"{name}/{p}" for p in _names(spark, f"{root}/variants/{name}") if "=" in p]


def commit_renditions(variants: DataFrame, root: str, tag: str | None = None) -> int:
    """Adds renditions (cache_key, path, output_format, cached_at and more) with their index rows as one new
    snapshot; its version. A ``tag`` that a snapshot has had (a batch that runs again) adds nothing."""
    spark, parts = variants.sparkSession, None
    for _ in range(ATTEMPTS):
        now = manifest(spark, root)
        if tag is not None and tag in now["tags"]:
            return now["version"]
        parts = _write(variants, root) if parts is None else parts
        try:
            _publish(spark, root, {"version": now["version"] + 1, "parts": now["parts"] + parts, "tags": now["tags"] + ([] if tag is None else [tag])})
            return now["version"] + 1
        except Overtaken:
            continue
    raise Overtaken(f"{ATTEMPTS} times, at {root}")


def _read(spark: SparkSession, root: str, table: str, parts: list[str]) -> DataFrame:
    found = spark.read.option("basePath", f"{root}/{table}").option("mergeSchema", True).parquet(*(f"{root}/{table}/{p}" for p in parts))
    return found.drop("dir").withColumn("output_format", F.col("output_format").cast("string"))


def read_renditions(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The renditions of a snapshot (the latest)."""
    return _read(spark, root, "variants", manifest(spark, root, version)["parts"])


def read_rendition_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """stem, cache_key, path and written_at of the same snapshot's renditions."""
    return _read(spark, root, "index", manifest(spark, root, version)["parts"])


def compact_renditions(spark: SparkSession, root: str, formats: list[str] | None = None) -> int:
    """A snapshot with one row, the latest, of each cache_key of some formats (all), in one folder for
    each; parts of other formats, and what others add meanwhile, stay. Its version."""
    now = manifest(spark, root)
    old = [p for p in now["parts"] if formats is None or p.rsplit("=", 1)[1] in formats]
    if not old:
        return now["version"]
    last = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("cached_at"), F.struct("path")))
    parts = _write(_read(spark, root, "variants", old).withColumn("_last", last).filter("_last = 1").drop("_last"), root)
    for _ in range(ATTEMPTS):
        now = manifest(spark, root)
        if not set(old) <= set(now["parts"]):
            raise Overtaken("another compaction has replaced these parts")
        try:
            _publish(spark, root, {"version": now["version"] + 1, "parts": [p for p in now["parts"] if p not in old] + parts, "tags": now["tags"]})
            return now["version"] + 1
        except Overtaken:
            continue
    raise Overtaken(f"{ATTEMPTS} times, at {root}")


def clean_renditions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drops all but the last ``keep`` snapshots and the folders that no kept one lists; how many folders.
    Folders of writers that have not committed yet go too: run it while none writes."""
    standing = snapshots(spark, root)
    kept = standing[-keep:]
    live = {p.split("/")[0] for v in kept for p in manifest(spark, root, v)["parts"]}
    gone = [f"{root}/{t}/{d}" for t in ("variants", "index") for d in _names(spark, f"{root}/{t}") if d.startswith("dir=") and d not in live]
    for path in [f"{root}/manifests/{v:012d}" for v in standing if v not in kept] + gone:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)
    return len(gone)
