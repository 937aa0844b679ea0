"""A corpus pipeline of five of the operators: quality, near-duplicates, benchmark, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.llm import decontam, mixing, quality, sharding, simhash
from siftlode.llm.common import own_prefix, table, work_dir

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those that came in, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: pairs that SimHash finds and whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, and what chains of them connect."""
    return simhash.drop_similar(docs, shingle=5, similar=(4, 5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the sources' target weights ask, up to three times."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, their slot in it, and the shard they would move to if there were one more."""
    crc = f"{own_prefix(docs)}crc"
    tagged = docs.withColumn(crc, F.crc32(F.coalesce("text", F.lit(""))))
    return sharding.shard_records(tagged, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1), order=(crc,)).drop(crc)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the shingles' hashes are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs, base = table(spark, sf_dir, "documents"), work_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/stage{i}")
        docs = spark.read.parquet(f"{base}/stage{i}")
    return docs
