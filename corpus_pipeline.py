"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``documents``. ``run`` writes each stage's rows as a table in the
shared folder and reads them again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.llm.common import dropped, fold, kept_tables, prepare, stored
from mediaops.llm.minhash import near_duplicates
from mediaops.llm.mixing import mixed_documents
from mediaops.llm.packing import pack_documents
from mediaops.llm.quality import quality_scores
from mediaops.llm.substrings import remove_repeats

#: Target weights of the sources; those not listed weigh 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as bad go; those without an id stay. It learns
    from the labels outside the held-out fold. Rows that share a doc_id go together, if one of them
    is bad; rows with a null doc_id stay. Null and empty texts are scored as empty texts."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)
    bad = quality_scores(docs, labels).filter("predicted = 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the
    least doc_id stays; documents without words, and rows without an id, stay."""
    prepare(spark)
    gone = near_duplicates(docs, k=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller doc_id has are cut out."""
    prepare(spark)
    return remove_repeats(docs, 13)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources take their target shares, and shuffled globally; all their
    columns stay as they are. A null source is a source of its own; repeated rows draw alike."""
    return mixed_documents(docs, SOURCE_WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; null and empty texts are the end
    id alone."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]

#: Classifier, automata and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; returns the packed pieces. What a stage has written
    for itself, and the rows that it read, go when its own rows are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with kept_tables() as kept:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                done = set(kept)
                docs = stored(docs, f"stage-{name}")
                dropped(spark, done)
    return docs
