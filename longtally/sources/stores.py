"""Writers and incremental reads: upsert, insert-ignore, replace, export, ingest.

Tables are parquet folders. A rewrite goes to a folder beside the table and is put in
place when it is complete (``publish``), so a lost executor or a failed job never leaves
a half-written table; keyed tables that batches keep current are in ``keyed``. Replacing
by name is the one exception: it replaces whole partitions by Spark's dynamic overwrite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.merge import keep_first
from .publish import publish


def upsert_outcomes(old: DataFrame, new: DataFrame, key: str, columns, order) -> DataFrame:
    """Merged rows with their outcome: inserted, updated, unchanged or kept.

    ``new`` may repeat a key; its first row in ``order`` counts. Values are
    compared null-safely.
    """
    fresh = keep_first(new, [key], order).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_is_new"))
    both = old.select(key, *columns).withColumn("_is_old", F.lit(True)).join(fresh, F.col(key) == F.col("_key"), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns])
    outcome = (
        F.when(F.col("_is_old").isNull(), "inserted").when(F.col("_is_new").isNull(), "kept")
        .when(same, "unchanged").otherwise("updated")
    )
    value = lambda c: F.when(F.col("_is_new").isNull(), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
    return both.select(F.coalesce(key, "_key").alias(key), *[value(c) for c in columns], outcome.alias("outcome"))


def insert_ignore(old: DataFrame, new: DataFrame, keys, order) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``old`` nor earlier in ``new``."""
    return keep_first(new, keys, order).join(old.select(*keys).distinct(), list(keys), "left_anti")


def pending(docs: DataFrame, done: DataFrame, key: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """Documents still to process: an anti join that nulls cannot poison."""
    out = docs if force else docs.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in UTF-8 with a header. Each file starts with a byte-order mark, carried by the first column's name."""
    first, *others = df.columns
    marked = df.toDF("\ufeff" + first, *others)
    publish(df.sparkSession, lambda to: marked.write.option("header", True).option("encoding", "UTF-8").csv(to), path)


def write_by_source(df: DataFrame, path: str, column: str = "source_type") -> None:
    """Split a long table into one folder per source."""
    publish(df.sparkSession, lambda to: df.write.partitionBy(column).parquet(to), path)


def replace_by_name(df: DataFrame, path: str, column: str = "analysis_name") -> None:
    """Replace the results of the analyses present in ``df``; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def rebuild_table(spark: SparkSession, df: DataFrame, path: str, backup: str) -> DataFrame:
    """Replace the current table and keep it as ``backup``, which must not exist. ``df`` may read the table."""
    publish(spark, lambda to: df.write.parquet(to), path, backup)
    return spark.read.parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Seven-column tab-separated dictionary; short or empty lines are skipped."""
    names = ["indicator_code", "indicator_name", "units", "sheets", "rows", "first_period", "last_period"]
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= len(names))
    return lines.select(*[F.trim(F.col("p")[i]).alias(n) for i, n in enumerate(names)])
