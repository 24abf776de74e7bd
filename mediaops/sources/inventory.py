"""The cache's inventory as a bucketed table: one row for each rendition name, whatever its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.functions.parsing import FORMATS

#: Formats that a key may end in.
OUTPUTS = sorted(set(FORMATS.values()))
#: Up to so many names, a lookup reads only the buckets that they lie in.
FEW = 2000


def stem_of(key: Column) -> Column:
    """A key without its format; the dot before it stays, so that a key without one is told apart."""
    return F.substring(key, F.lit(1), F.length(key) - F.length(F.substring_index(key, ".", -1)))


def cache_inventory(variants: DataFrame) -> DataFrame:
    """stem and ``cached``, the latest time of each format, of cache_key and cached_at. Keys of other
    formats, which no request can ask for, are left out; so are null keys."""
    fmt = F.substring_index("cache_key", ".", -1)
    times = F.struct(*(F.max(F.when(fmt == f, F.col("cached_at"))).alias(f) for f in OUTPUTS))
    return variants.filter(fmt.isin(OUTPUTS)).groupBy(stem_of(F.col("cache_key")).alias("stem")).agg(times.alias("cached"))


def write_inventory(variants: DataFrame, name: str, buckets: int = 256, path: str | None = None) -> DataFrame:
    """The inventory as table ``name``, in buckets by stem and sorted in them: joins by stem read it as it
    lies. About 100 MB a bucket are a good size."""
    rows = cache_inventory(variants).repartition(buckets, "stem")
    writer = rows.write.mode("overwrite").bucketBy(buckets, "stem").sortBy("stem")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_inventory(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """An inventory that another session has written, registered under ``name``."""
    times = ", ".join(f"{f}: TIMESTAMP_NTZ" for f in OUTPUTS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (stem STRING, cached STRUCT<{times}>) USING parquet CLUSTERED BY (stem) SORTED BY (stem) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def asked_of(inventory: DataFrame, keys: DataFrame, column: str = "stem", most: int = FEW) -> DataFrame:
    """The part of a bucketed inventory that ``keys`` can lie in: for up to ``most`` distinct ones the
    buckets of these alone, else all of it."""
    few = [r[0] for r in keys.select(column).distinct().limit(most + 1).collect()]
    return inventory if len(few) > most else inventory.filter(F.col("stem").isin([s for s in few if s is not None]))
