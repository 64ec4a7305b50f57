"""Duplicates and conflicting sources: keep-one, clusters, priority merge.

Keep-one rules are ``row_number() == 1`` filters, which Spark limits before the
shuffle, or ordered ``min_by`` aggregates, which combine on the map side; neither
brings a whole hot group into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions.text import decimal_places
from .runs import running_groups


def keep_first(df: DataFrame, keys, *order: Column) -> DataFrame:
    """One row per key: the first in the given order (nulls in a key are equal)."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).filter("_position = 1").drop("_position")


def dedupe_business_key(df: DataFrame, preferred_sheets) -> DataFrame:
    """One row per (period, region, indicator, value, unit): listed sheets first, then smallest id."""
    preferred = F.when(F.col("sheet_name").isin(list(preferred_sheets)), 0).otherwise(1)
    return keep_first(df, ["period", "region", "indicator_name", "value", "unit"], preferred, F.col("id"))


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Exact repeats of (period, region, code, value, growth): the smallest id stays."""
    return keep_first(df, ["period", "region", "indicator_code", "value", "growth_rate"], F.col("id"))


CLUSTER_KEYS = ["period", "region", "indicator_name", "unit"]


#: Distinct values of one key that one step holds, about.
STEP = 1000
#: Cuts of one key: beyond them its steps grow.
MOST_CUTS = 4096


def with_steps(points: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the step of ``value`` among the quantiles of its key, not decreasing in ``value``; 0 in small keys.

    Only keys of more than ``STEP`` rows are looked at again. Their number of rows decides the number of cuts,
    which are every so many of a fixed grid of quantiles; the step is a binary search in the sorted cuts.
    """
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STEP)
    same = lambda left, right: reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in by])
    large = points.alias("p").join(sizes.alias("s"), same("p", "s")).select("p.*", "_n")
    shares = [(i + 1) / MOST_CUTS for i in range(MOST_CUTS - 1)]
    grid = large.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), shares, 8 * MOST_CUTS).alias("_grid"), F.first("_n").alias("_n"))
    every = F.greatest(F.lit(1), F.floor(F.lit(MOST_CUTS) / F.ceil(F.col("_n") / STEP))).cast("int")
    cuts = F.array_distinct(F.filter("_grid", lambda c, i: (i + 1) % every == 0))
    cut = grid.select(*by, cuts.alias("_cuts"))

    def search(x: Column) -> Column:
        # lowest place whose cut lies above x: halves an interval as often as the largest array needs
        start = F.struct(F.lit(0).alias("low"), F.size("_cuts").alias("high"))
        middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
        halve = lambda s, _: F.when(s["low"] >= s["high"], s).when(F.get("_cuts", middle(s)) <= x, F.struct(
            (middle(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle(s).alias("high")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_CUTS.bit_length())), start, halve, lambda s: s["low"])

    joined = points.alias("p").join(cut.alias("c"), same("p", "c"), "left").select("p.*", "_cuts")
    step = F.when(F.size("_cuts") > 0, search(F.col(value).cast("double"))).otherwise(0)
    return joined.withColumn(name, step).drop("_cuts")


def value_clusters(df: DataFrame, gap: float = lx.CONFLICT_TOLERANCE) -> DataFrame:
    """Distinct values per key with a cluster number; a step above ``gap`` opens a cluster.

    Equal values collapse first (count and smallest id). Keys with more than ``STEP`` distinct values are cut
    at quantiles of their own values into steps of about that many, found by a sketch that merges on the map
    side; a value's step is the number of cuts at or below it. Runs are numbered step by step, so a hot key is
    spread evenly over tasks however skewed its values are.
    """
    points = (
        df.filter(F.col("value").isNotNull())
        .groupBy(*CLUSTER_KEYS, "value")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id"))
    )
    limit = F.lit(str(gap)).cast("decimal(20,4)")
    stepped = with_steps(points, CLUSTER_KEYS, "value", "_step")
    return running_groups(
        stepped, CLUSTER_KEYS, [F.col("value")], F.col("_step"),
        lambda previous: F.col("value") - previous["value"] > limit,
    ).drop("_step").withColumnRenamed("run", "cluster")


def cluster_keepers(clusters: DataFrame) -> DataFrame:
    """Per cluster the value with most decimal digits, then the smallest id."""
    order = F.struct((-decimal_places(F.col("value"))).alias("a"), F.col("id").alias("b"))
    return clusters.groupBy(*CLUSTER_KEYS, "cluster").agg(
        F.min_by(F.struct("id", "value"), order).alias("k"), F.sum("rows").alias("rows")
    ).select(*CLUSTER_KEYS, "cluster", F.col("k.id").alias("id"), F.col("k.value").alias("value"), "rows")


def dropped_by_clusters(df: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows a clean-up would delete (null values are never deleted)."""
    return df.filter(F.col("value").isNotNull()).join(keepers.select("id"), "id", "left_anti")


MERGE_KEYS = ["period", "region", "indicator_name"]


def merge_order(priority: dict[str, int] | None = None, lagged=None) -> Column:
    """Order of competing rows: source priority, then document, then id.

    Higher document numbers come first, except for lagged series, where the
    smaller number is the later document.
    """
    priority = lx.MERGE_PRIORITY if priority is None else priority
    lagged = lx.LAGGED_NAMES if lagged is None else lagged
    rank = F.lit(lx.MERGE_PRIORITY_LAST)
    for level in sorted(set(priority.values()), reverse=True):
        names = [n for n, p in priority.items() if p == level]
        rank = F.when(F.col("source_name").isin(names), level).otherwise(rank)
    doc = F.when(F.col("source_name").isin(list(lagged)), F.col("doc_id")).otherwise(-F.col("doc_id"))
    return F.struct(rank.alias("a"), doc.alias("b"), F.col("id").alias("c"))


def merge_with_priority(df: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per (period, region, indicator).

    The leading row gives document, sheet and source; value, growth and unit come
    from the first row in order that has one.
    """
    df = df.withColumn("_order", merge_order() if order is None else order)
    order = F.col("_order")
    has = lambda c: F.when(F.col(c).isNotNull(), order)
    has_unit = F.when(F.coalesce(F.col("unit"), F.lit("")) != "", order)
    lead = F.struct("id", "doc_id", "source_name", "sheet_name", "source_type", "confidence")
    return (
        df.groupBy(*MERGE_KEYS)
        .agg(
            F.min_by(lead, order).alias("lead"),
            F.min_by("value", has("value")).alias("value"),
            F.min_by("growth_rate", has("growth_rate")).alias("growth_rate"),
            F.min_by("unit", has_unit).alias("unit"),
            F.count(F.lit(1)).alias("merged_rows"),
        )
        .select(*MERGE_KEYS, "value", "unit", "growth_rate", "lead.*", "merged_rows")
    )


def merge_conflicts(df: DataFrame, merged: DataFrame, tolerance: float = lx.CONFLICT_TOLERANCE) -> DataFrame:
    """Rows that disagree with the merged row of their key by more than the tolerance.

    A join of every row with the one merged row of its key: large keys split as
    skewed partitions, since only the row side is large.
    """
    m = merged.filter(F.col("merged_rows") > 1).select(
        *MERGE_KEYS, F.col("value").alias("m_value"), F.col("growth_rate").alias("m_growth"),
        F.col("doc_id").alias("m_doc"), F.col("source_name").alias("m_source"),
    )
    rows = df.join(m, MERGE_KEYS)
    kind = lambda name, a, b: F.when(F.abs(F.col(a) - F.col(b)) > tolerance, F.struct(
        F.lit(name).alias("measure"), F.col(a).alias("kept"), F.col(b).alias("other")))
    found = F.filter(
        F.array(kind("value", "m_value", "value"), kind("growth", "m_growth", "growth_rate")),
        lambda x: x.isNotNull(),
    )
    scope = F.when(F.col("m_doc") == F.col("doc_id"), "same document").otherwise("cross document")
    return rows.select(
        *MERGE_KEYS, "id", "m_source", "source_name", scope.alias("scope"), F.inline(found)
    )


def find_conflicts(df: DataFrame, tolerance: float = lx.CONFLICT_TOLERANCE) -> DataFrame:
    """Conflicts of a frame with its own merge.

    Both sides read the same few columns, so Spark can reuse the shuffled input
    instead of working the rows out twice.
    """
    slim = df.select(*MERGE_KEYS, "id", "doc_id", "source_name", "value", "growth_rate")
    ordered = slim.withColumn("_order", merge_order())
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("_order"))
    merged = ordered.groupBy(*MERGE_KEYS).agg(
        F.min_by(F.struct("doc_id", "source_name"), "_order").alias("lead"),
        F.min_by("value", has("value")).alias("value"), F.min_by("growth_rate", has("growth_rate")).alias("growth_rate"),
        F.count(F.lit(1)).alias("merged_rows"),
    ).select(*MERGE_KEYS, "value", "growth_rate", "lead.*", "merged_rows")
    return merge_conflicts(slim, merged, tolerance)


def conflict_report(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("measure", "scope").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(*MERGE_KEYS).alias("keys")
    )


def already_under_new_name(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of the old name that exist under the new one: same key, value and null-safe growth."""
    a = df.filter((F.col("indicator_name") == old) & F.col("value").isNotNull()).alias("a")
    b = df.filter((F.col("indicator_name") == new) & F.col("value").isNotNull()).alias("b")
    on = (
        (F.col("a.period") == F.col("b.period")) & (F.col("a.region") == F.col("b.region"))
        & (F.col("a.value") == F.col("b.value")) & F.col("a.growth_rate").eqNullSafe(F.col("b.growth_rate"))
    )
    return a.join(b, on, "left_semi")


def same_key_pairs(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of the old name whose (period, region) exists under the new name."""
    a = df.filter(F.col("indicator_name") == old)
    b = df.filter(F.col("indicator_name") == new).select("period", "region").distinct()
    return a.join(b, ["period", "region"], "left_semi")


def rename_and_dedupe(df: DataFrame, renames=None) -> DataFrame:
    """Rename old names to new ones, pair by pair; rows that repeat an existing row are dropped.

    A renamed row repeats another if period, region, new name, value and growth agree: a row that had the
    new name before, or one that an earlier pair of the list renamed. The row's value counts as it was,
    the other's as it is stored, that is rescaled where its pair says so. Rows without a value repeat
    nothing, and rows of the same old name do not drop each other. All pairs go in one pass: a lookup of
    the pair, an anti join with the rows of the new names, and one aggregate for the earliest pair.
    """
    from .select import rescale_above

    spark = df.sparkSession
    renames = lx.ALIGN_RENAMES if renames is None else renames
    table = lx.lookup_frame(spark, [(i, *r) for i, r in enumerate(renames)], "_pair", "old_name", "new_name", "new_unit", "scaled")
    tagged = df.join(F.broadcast(table), df.indicator_name == table.old_name, "left").drop("old_name")
    renamed = tagged.filter(F.col("new_name").isNotNull())
    kept = tagged.filter(F.col("new_name").isNull()).drop("_pair", "new_name", "new_unit", "scaled")
    targets = df.filter(
        F.col("indicator_name").isin(sorted({r[1] for r in renames})) & F.col("value").isNotNull()
    ).select("period", "region", "indicator_name", "value", "growth_rate").distinct().alias("t")
    a = renamed.alias("a")
    fresh = a.join(
        targets,
        (F.col("a.period") == F.col("t.period")) & (F.col("a.region") == F.col("t.region"))
        & (F.col("a.new_name") == F.col("t.indicator_name")) & (F.col("a.value") == F.col("t.value"))
        & F.col("a.growth_rate").eqNullSafe(F.col("t.growth_rate")),
        "left_anti",
    )
    stored = F.when(F.col("scaled"), rescale_above(F.col("value"))).otherwise(F.col("value"))
    earliest = fresh.filter(F.col("value").isNotNull()).groupBy(
        F.col("period").alias("_p"), F.col("region").alias("_r"), F.col("new_name").alias("_n"),
        stored.alias("_v"), F.col("growth_rate").alias("_g"),
    ).agg(F.min("_pair").alias("_first"))
    moved = fresh.join(
        earliest,
        (F.col("period") == F.col("_p")) & (F.col("region") == F.col("_r")) & (F.col("new_name") == F.col("_n"))
        & (F.col("value") == F.col("_v")) & F.col("growth_rate").eqNullSafe(F.col("_g")) & (F.col("_first") < F.col("_pair")),
        "left_anti",
    ).withColumns({
        "value": stored,
        "unit": F.coalesce("new_unit", "unit"),
        "indicator_code": F.regexp_replace("new_name", " ", ""),
        "indicator_name": F.col("new_name"),
    }).drop("_pair", "new_name", "new_unit", "scaled")
    return kept.unionByName(moved)
