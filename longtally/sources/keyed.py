"""A table with a key, kept current by batches: folders of key hashes, of which a batch rewrites those it touches.

A batch merges its rows with the stored rows of the touched buckets and writes them aside; complete buckets are
then put in place one by one, and the batch is marked done with the outcome of its rows. A lost batch is
finished or dropped before the next one, and a batch that is done is not applied again, so replays change
nothing. Every bucket has one live set of files, whatever the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import stores
from .publish import COMPLETE, Folders

#: (stored rows, rows of a batch) to the rows to store, with their ``outcome``: inserted, updated, unchanged, written,
#: or kept for rows that only lie in a touched bucket.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def first_by(key: str, order: str) -> Merge:
    """One row per key: the first by ``order``, nulls last, in whatever batch it comes; ties by the other columns.

    Stored and new rows meet in one aggregate by key, so a row is shuffled once.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in (key, order)]
        row = F.struct(F.col(order).isNull().alias("_late"), order, *rest)
        side = lambda df, stored: df.select(key, row.alias("_row"), F.lit(stored).alias("_stored"))
        first = lambda stored: F.min(F.when(F.col("_stored") == stored, F.col("_row")))
        both = side(old, True).unionByName(side(new, False)).groupBy(key).agg(first(True).alias("_old"), first(False).alias("_new"))
        stays = F.col("_old") <= F.col("_new")
        outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(stays, "unchanged").otherwise("updated")
        chosen = both.select(key, F.least("_old", "_new").alias("_row"), outcome.alias("outcome"))
        return chosen.select(*[key if c == key else F.col(f"_row.{c}").alias(c) for c in new.columns], "outcome")

    return merge


def newest(key: str, columns: list[str], order: Column) -> Merge:
    """One row per key: that of the newest batch, its first one by ``order``."""
    return lambda old, new: stores.upsert_outcomes(old, new, key, columns, order)


def ignore(keys: list[str], order: Column) -> Merge:
    """One row per key: the first that was stored."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = stores.insert_ignore(old, new, keys, order).withColumn("outcome", F.lit("inserted"))
        return old.select(*new.columns).withColumn("outcome", F.lit("kept")).unionByName(fresh)

    return merge


def replaced(key: str) -> Merge:
    """Any number of rows per key: all those of the newest batch that has the key."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        keys = new.select(F.col(key).alias("_key")).distinct()
        kept = old.select(*new.columns).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        return kept.withColumn("outcome", F.lit("kept")).unionByName(new.withColumn("outcome", F.lit("written")))

    return merge


def bucket_of(key: str | list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(buckets)).cast("int")


def recover(spark: SparkSession, path: str) -> None:
    """Finishes complete batches that were lost while their buckets were put in place; drops the others."""
    folders = Folders(spark, path)
    for batch in folders.names(f"{path}/_next"):
        aside, old = f"{path}/_next/{batch}", f"{path}/_old/{batch}"
        if not folders.exists(f"{aside}/{COMPLETE}"):
            folders.delete(aside)
            continue
        for bucket in (n for n in folders.names(aside) if n.startswith("bucket=")):
            if folders.exists(f"{path}/{bucket}"):
                folders.move(f"{path}/{bucket}", f"{old}/{bucket}")
            folders.move(f"{aside}/{bucket}", f"{path}/{bucket}")
        folders.move(aside, f"{path}/_done/{batch}")
        folders.delete(old)


def merge_batch(batch: DataFrame, path: str, batch_id: int, key: str | list[str], merge: Merge, buckets: int = 64, gather: bool = True) -> None:
    """Merges one batch into the table under ``path``. ``buckets`` must be the same for all batches of a table.

    ``gather`` brings the rows of a bucket into one task, for one file each. Without it the tasks of the merge write
    what they hold: wide rows are not shuffled again, and a bucket has as many files as the merge has tasks.
    """
    spark = batch.sparkSession
    recover(spark, path)
    folders, aside = Folders(spark, path), f"{path}/_next/batch={batch_id}"
    if folders.exists(f"{path}/_done/batch={batch_id}"):
        return
    bucket = bucket_of(key, buckets)
    batch = batch.persist()
    try:
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        stored = [f"{path}/bucket={b}" for b in sorted(touched) if folders.exists(f"{path}/bucket={b}")]
        old = spark.read.schema(batch.schema).parquet(*stored) if stored else batch.limit(0)
        # The outcome of a row stays with it until its bucket is rewritten, so counting reads one column of what was written.
        merged = merge(old, batch).withColumn("bucket", bucket)
        merged = merged.repartition("bucket") if gather else merged
        merged.write.mode("overwrite").partitionBy("bucket").parquet(aside)
        written = spark.read.schema("outcome string, bucket int").parquet(aside).where("outcome <> 'kept'")
        counts = written.groupBy("outcome").agg(F.count("*").alias("n"))
        counts = counts.select(F.lit(batch_id).cast("long").alias("batch"), "outcome", "n", F.lit(len(touched)).alias("buckets"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{aside}/_counts")
        folders.mark(f"{aside}/{COMPLETE}")
    finally:
        batch.unpersist()
    recover(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands. A batch that is lost half-way shows until ``recover`` or the next batch."""
    return spark.read.parquet(path).drop("bucket", "outcome")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(batch, outcome, n, buckets): what became of each batch's rows, and the number of buckets it rewrote."""
    done = [f"{path}/_done/{b}/_counts" for b in Folders(spark, path).names(f"{path}/_done")]
    return spark.read.schema("batch long, outcome string, n long, buckets int").parquet(*done)
