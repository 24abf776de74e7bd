"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", REPO)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir). Only in local mode,
    where one machine is all there is, an unset folder is made in its temporary space."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        folder = "file://" + tempfile.mkdtemp(prefix="media-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row: the optimiser does not copy an expression
    through a generator into every place that uses its column."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def per_distinct(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(df)`` for work that looks at ``keys`` only (null or not) and adds or replaces columns: it is
    done once for each distinct key row, and joined to the rows. Logs repeat themselves, and the
    work costs far more than a join. On a stream, which has no distinct rows, each row is worked on."""
    if df.isStreaming:
        return work(df)
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):  # inside other such work
        mark += "_"
    own, key = ([f"{mark}{side}{i}" for i in range(len(keys))] for side in ("own", "key"))
    done = work(df.select(*keys).distinct().select(*keys, *(F.col(k).alias(a) for k, a in zip(keys, key, strict=True))))
    rest = df.select(*(c for c in df.columns if c not in keys), *(F.col(k).alias(a) for k, a in zip(keys, own, strict=True)))
    return rest.join(done, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, key, strict=True)]).drop(*own, *key)


def cut(df, name: str):
    """Write ``df`` to the shared folder and read it back: later steps plan on its columns instead of
    on all the expressions behind them, and a lost executor costs no more than what follows."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
