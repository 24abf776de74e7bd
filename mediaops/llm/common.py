"""Shared pieces of the operators: shared-folder tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", REPO)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only in local mode, where one
    machine is all there is, an unset folder is made in its temporary space."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        folder = "file://" + tempfile.mkdtemp(prefix="llm-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of the tables that the run around has written and not dropped yet; one of each thread's own.
_kept: ContextVar[set[str] | None] = ContextVar("kept", default=None)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; otherwise these stay until the driver's
    garbage collection finds their plans dead, which may be long after the last step has read them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives the
    loss of any executor, and gives Spark the true size for its join choices. What was shuffled on
    the way goes at once: the table is all that is read later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (kept := _kept.get()) is not None:
        kept.add(path)
    return out


@contextmanager
def kept_tables() -> Iterator[set[str]]:
    """The paths of the tables that are ``stored`` inside, and still stand. Runs beside this one, in
    other threads, have sets of their own; a run inside another adds what it leaves to that."""
    outer, mine = _kept.get(), set()
    token = _kept.set(mine)
    try:
        yield mine
    finally:
        _kept.reset(token)
        if outer is not None:
            outer |= mine


def dropped(spark: SparkSession, paths: set[str]) -> None:
    """Remove stored tables by path, through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if (kept := _kept.get()) is not None:
            kept.discard(path)


def release(*tables: DataFrame) -> None:
    """Drop tables of ``stored`` that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        dropped(df.sparkSession, {df._stored_at})


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the fixed split into learning and held-out rows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, component) for every id that has an
    edge, component being the smallest id reachable.

    Each round every node steps to the neighbour with the least hash (or stays; in the first round
    the least id counts, where most edges lead), nodes that meet become one, and the edges between
    those that are left go on: they shrink by a factor in each round, stars at once. A hub's rows meet small stored tables,
    so Spark may broadcast these or split the hub's rows. An empty edge table gives no rows.
    """
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    steps: list[DataFrame] = []
    while e.limit(1).count():
        if len(steps) == max_rounds:
            raise RuntimeError("components did not settle")
        draw = lambda c: F.xxhash64(c, F.lit(len(steps))) if steps else F.col(c)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min_by("b", draw("b")).alias("b"))
        step = stored(best.select(F.col("a").alias("id"), F.when(draw("b") < draw("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "steps")
        moved = e.join(step.select(F.col("id").alias("a"), F.col("to").alias("p")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("q")), "b")
        gone = e
        e = stored(moved.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        release(gone)
        steps.append(step)
    if not steps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    ends = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
        ends = ends.join(later, "to", "left").select("id", F.coalesce("then", "to").alias("to"))
    ends = stored(ends, "ends")
    least = stored(ends.groupBy("to").agg(F.min("id").alias("component")), "least-ids")
    return ends.join(least, "to").select("id", "component")
