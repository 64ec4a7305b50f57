"""Run numbering inside ordered groups, safe for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.workspace import new_path


def running_groups(
    df: DataFrame, by: list[str], order: list[Column], bucket: Column, starts
) -> DataFrame:
    """Number the runs inside each group, with large groups split over tasks.

    ``starts(previous)`` says, from the previous row as a struct (null on the
    first row), whether a row opens a new run. ``bucket`` must not decrease in
    ``order``. Runs are counted inside (group, bucket), then the small bucket
    summaries are chained per group: a two-level prefix sum, so a hot group costs
    its buckets, not its rows, in one task.
    """
    names = df.columns
    row = F.struct(*[F.col(c) for c in names])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    prepared = df.withColumn("_bucket", bucket).withColumn("_previous", F.lag(row).over(inside))
    head = F.col("_previous").isNull()
    marked = prepared.withColumn("_start", F.when(head, F.lit(0)).otherwise(F.when(starts(F.col("_previous")), 1).otherwise(0)))
    running = marked.withColumn(
        "_run", F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_row", F.row_number().over(inside))

    # one row per bucket: its first row, its last row and its number of inner starts
    per_bucket = running.groupBy(*by, "_bucket").agg(
        F.min_by(row, "_row").alias("_first"), F.max_by(row, "_row").alias("_last"), F.sum("_start").alias("_inner")
    )
    across = Window.partitionBy(*by).orderBy("_bucket")
    linked = per_bucket.withColumn("_before", F.lag("_last").over(across))
    first = linked.select(*by, "_bucket", "_inner", "_before", *[F.col(f"_first.{c}").alias(c) for c in names if c not in by])
    opened = first.withColumn(
        "_open", F.when(F.col("_before").isNull() | starts(F.col("_before")), 1).otherwise(0)
    )
    chained = opened.withColumn("_weight", F.col("_open") + F.col("_inner"))
    prefix = F.sum("_weight").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner")
    offsets = chained.withColumn("_offset", prefix).select(*by, "_bucket", "_offset")
    out = running.join(offsets, by + ["_bucket"])
    return out.select(*names, (F.col("_offset") + F.col("_run")).cast("long").alias("run"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the place of each row in a total order, from 1, without one task that sees all rows.

    Rows are dealt into ranges and written, so that their ranges stay as they are; each range is
    numbered on its own, after the counts of the ranges before it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: the sizes fold into one array of at most as many entries as there are partitions
    counts = sizes.agg(F.map_from_entries(F.collect_list(F.struct("_range", "_n"))).alias("_sizes")).select("_sizes").scalar()
    earlier = F.filter(F.map_entries("_sizes"), lambda e: e["key"] < F.col("_range"))
    offsets = sizes.withColumn("_sizes", counts).select("_range", F.aggregate(earlier, F.lit(0).cast("long"), lambda t, e: t + e["value"]).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    place = (F.row_number().over(inside) + F.col("_before")).cast("int")
    return ranged.join(offsets, "_range").withColumn(name, place).drop("_range", "_before")
