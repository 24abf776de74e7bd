"""Cache tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.session import cut


def write_variants(variants: DataFrame, path: str, compact: bool = False) -> None:
    """Append renditions, one partition per output format; ``compact`` rewrites just the partitions that
    the rows stand in, with one row per cache_key: the one passed, else one that stands there.

    Readers may meet a rewrite half done; ``sources.store`` commits renditions and index at once."""
    if not compact:
        variants.write.mode("append").partitionBy("output_format").parquet(path)
        return
    spark, unique = variants.sparkSession, variants.dropDuplicates(["cache_key"])
    standing = spark.read.schema(variants.schema).parquet(path)
    kept = standing.join(unique.select("output_format").distinct(), "output_format", "left_semi").join(unique.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    merged = cut(unique.unionByName(kept), "compacted")  # what is read is written over
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("output_format").parquet(path)


def write_cache_index(variants: DataFrame, path: str) -> None:
    """Append stem, cache_key, path and written_at of renditions."""
    columns = ["stem", "cache_key", "path", F.col("cached_at").alias("written_at")]
    variants.select(*columns).write.mode("append").parquet(path)
