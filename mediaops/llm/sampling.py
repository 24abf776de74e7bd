"""Bounded learning samples, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, label: str, per_label: int, seed: str = "sample-1") -> DataFrame:
    """About ``per_label`` rows (all, where there are fewer) of every label: a row stays if the hash
    of its id falls under per_label / rows with its label. Counts per label are joined to the rows."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / 2.0**52
    rate = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("_n"))
    return rows.join(F.broadcast(counts), label).filter(u < rate).select(*rows.columns)
