"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import stored

#: Hash draws have this many bits (13 hex digits of md5), so they are exact doubles.
BITS = 52


def uniform(*parts: Column) -> Column:
    """A draw in [0, 1) from the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(2**BITS))


#: Above this rate a document draws several times, each with an equal part of the rate, and the counts
#: are added: the law is the same, and no table of it holds more than about 1,400 entries.
MOST_RATE = 1000.0
#: Steps of the search in a table: 2^11 entries.
SEARCH = 11


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Adds ``cdf``, P(N <= 0), P(N <= 1), ... of the Poisson law of each row's ``part`` (a rate of at most
    MOST_RATE) to (_mix_source, part, ...): the tail beyond part + 12 sqrt(part) + 24 is under 2^-53.
    Logarithms of the terms are summed up along each table, so large rates do not underflow."""
    last = F.ceil(F.col("part") + 12 * F.sqrt("part") + 24).cast("int")
    steps = rates.filter("part > 0").select("_mix_source", "part", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("_mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("log_p", F.sum(F.when(F.col("k") == 0, -F.col("part")).otherwise(F.log(F.col("part") / F.col("k")))).over(upto))
    steps = steps.withColumn("total", F.sum(F.exp("log_p")).over(upto))
    tables = steps.groupBy("_mix_source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "total"))), lambda x: x["total"]).alias("cdf"))
    joined = rates.join(tables.withColumnRenamed("_mix_source", "_s"), F.col("_mix_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return joined.withColumn("cdf", F.coalesce("cdf", F.array(F.lit(1.0))))


def entries_up_to(cdf: Column, u: Column) -> Column:
    """How many entries of the rising array are not above u, found by halving steps."""
    step = lambda at, bit: F.when(F.coalesce(F.get(cdf, at + bit - 1) <= u, F.lit(False)), at + bit).otherwise(at)
    return F.aggregate(F.array(*[F.lit(2**b) for b in reversed(range(SEARCH))]), F.lit(0), step)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, total: float | None) -> DataFrame:
    """One row per source present: _mix_source, n_docs, rate, draws, part (rate / draws) and cdf. A null
    source is its own source, named by null in ``weights``. Only source counts are read; two
    scalars reach the driver."""
    counts = docs.groupBy(F.col("source").alias("_mix_source")).agg(F.count("*").alias("n_docs"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        if value < 0:
            raise ValueError("weights must not be negative")
        weight = F.when(F.col("_mix_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    counts = stored(counts.withColumn("weight", weight), "mix-counts")
    sums = counts.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    all_weight, n = float(sums["w"] or 0), int(sums["n"] or 0)
    wanted = float(n if total is None else total)
    share = F.col("weight") / F.lit(all_weight) if all_weight > 0 else F.lit(0.0)
    counts = counts.withColumn("rate", F.lit(wanted) * share / F.col("n_docs"))
    draws = F.greatest(F.ceil(F.col("rate") / F.lit(MOST_RATE)), F.lit(1)).cast("int")
    return stored(poisson_tables(counts.withColumn("draws", draws).withColumn("part", F.col("rate") / F.col("draws"))), "mix-rates")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    total: float | None = None,
    seed: str = "mix-1",
    salts: int = 32,
) -> DataFrame:
    """Repeat every document a Poisson number of times so that sources take their target shares.

    The mean of the law is the source's target repetition rate: share of the weights x ``total``
    (default: as many rows as there are documents) / documents of the source. The draw is hashed
    from ``seed`` and doc_id and inverted through the cumulated law, so a rerun repeats it.
    Columns of ``docs`` plus ``copy`` (from 1), ``n_copies``, ``mix_rate`` and ``mix_key``; the rows
    are shuffled globally: partition and order within it both follow the hashed ``mix_key``.

    Rates join on (source, salt), so a source with a third of all rows is dealt over ``salts``
    keys; where the table of rates is small Spark broadcasts it by its stored size.

    Nulls: a null source is a source of its own, a null doc_id draws as the empty id, null and
    empty texts are ordinary rows. Rows with equal doc_id get equal counts. Input columns named
    copy, n_copies, mix_rate or mix_key are replaced. An empty table gives no rows.
    """
    return replicated(docs.drop(*MIXED), weights, default_weight, total, seed, salts, MIXED)


#: Columns that mix_sources adds.
MIXED = ("copy", "n_copies", "mix_rate", "mix_key")


def replicated(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, total: float | None, seed: str, salts: int, added: tuple[str, str, str, str]) -> DataFrame:
    """mix_sources with the added columns under the names ``added``; all columns of ``docs`` stay."""
    names = docs.columns
    rates = repetition_rates(docs, weights, default_weight, total).select(
        F.coalesce("_mix_source", F.lit("")).alias("_mix_name"), F.col("_mix_source").isNull().alias("_mix_null"), F.col("rate").alias("_mix_rate"), F.col("draws").alias("_mix_draws"), F.col("cdf").alias("_mix_cdf"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_mix_salt"),
    )
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(
        "*", identity.alias("_mix_id"), F.coalesce("source", F.lit("")).alias("_mix_name"), F.col("source").isNull().alias("_mix_null"),
        F.pmod(F.crc32(identity.cast("binary")), F.lit(salts)).cast("int").alias("_mix_salt"),
    )
    joined = keyed.join(rates, ["_mix_name", "_mix_null", "_mix_salt"])
    one = entries_up_to(F.col("_mix_cdf"), uniform(F.lit(seed), F.col("_mix_id")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("_mix_draws")), F.lit(0), lambda n, j: n + entries_up_to(F.col("_mix_cdf"), uniform(F.lit(seed), F.col("_mix_id"), j.cast("string"))))
    counted = joined.withColumn("_mix_n", F.when(F.col("_mix_draws") == 1, one).otherwise(more))
    copy, n_copies, rate, key = added
    copies = counted.filter("_mix_n > 0").select(
        *names, "_mix_id", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias(copy), F.col("_mix_n").alias(n_copies), F.col("_mix_rate").alias(rate)
    )
    keyed = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed + "-order"), "_mix_id", F.col(copy).cast("string")))).drop("_mix_id")
    return keyed.repartition(key).sortWithinPartitions(key)


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, total: float | None = None, seed: str = "mix-1", salts: int = 32) -> DataFrame:
    """The rows of mix_sources with the columns of ``docs`` alone, whatever their names."""
    return replicated(docs, weights, default_weight, total, seed, salts, ("_mix_copy", "_mix_copies", "_mix_times", "_mix_key")).select(*docs.columns)


#: Target weights of the registered query; sources not listed weigh 1.
QUERY_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5, "src4": 0.0}


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mix_sources (nulls and ties: see there) over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, QUERY_WEIGHTS).withColumn("mix_rate", F.round("mix_rate", 9))


OP6_SQL = """
WITH counted AS (
  SELECT source, count(*) AS n_docs,
         CASE source WHEN 'src0' THEN 4.0 WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 2.0 WHEN 'src3' THEN 0.5
                     WHEN 'src4' THEN 0.0 ELSE 1.0 END::DOUBLE AS weight
  FROM documents GROUP BY source
), rates AS (
  SELECT source, sum(n_docs) OVER () * (weight / sum(weight) OVER ()) / n_docs AS rate FROM counted
), laws AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k
        FROM rates WHERE rate > 0)
), drawn AS (
  SELECT d.*, CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents d
), listed AS (
  SELECT source, list(cdf ORDER BY k) AS cdfs FROM laws GROUP BY source
), repeated AS (
  SELECT d.* EXCLUDE (u), len(list_filter(l.cdfs, lambda c: c <= d.u)) AS n_copies
  FROM drawn d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars, CAST(c.copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies,
       round(rate, 9) AS mix_rate,
       md5('mix-1-order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(c.copy AS VARCHAR)) AS mix_key
FROM repeated r JOIN rates USING (source), LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy) c
"""
