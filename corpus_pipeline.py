"""From raw documents to balanced shards: five stages, each one operator of the library.

A stage takes (spark, docs, sf_dir) and returns what it kept; its result is written as Parquet and
read again as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longtally.llm import decontaminate, mixing, sharding, simhash, toxicity
from longtally.llm.common import quoted, stored, table, unused

SHARDS = 24


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of the other documents, scores below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused("_toxicity", docs.columns)
    return toxicity.scored(docs, model, name=score).where(F.col(score) < toxicity.THRESHOLD).select(*map(quoted, docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: that with the smallest id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a test item."""
    aside = {c: unused("_" + c, docs.columns) for c in docs.columns if c in decontaminate.ADDED}
    found = decontaminate.find_contamination(docs.withColumnsRenamed(aside), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(*(quoted(aside.get(c, c)).alias(c) for c in docs.columns))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target sizes."""
    return mixing.mixed_documents(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; equal texts share a shard."""
    return sharding.shards_by_bytes(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_weights),
    ("sharding", into_shards),
]
#: No SQL for SimHash components, learned scores and differencing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents under ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
