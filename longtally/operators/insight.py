"""Rule-based conclusions on result sets: one row per group, never per-row Python.

Each function takes the metric column explicitly and an optional list of group
columns; the thresholds are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions.text import plain_number


def _grouped(df: DataFrame, by):
    return df.groupBy(*(by or []))


def conclude_trend(df: DataFrame, value: str, order: Column, by=None) -> DataFrame:
    """First against last row: up above 1.05 times, down below 0.95 times, else flat; flat if either has no number."""
    df = df.withColumn("_o", order)
    out = _grouped(df, by).agg(
        F.count(F.lit(1)).alias("points"), F.min_by(value, "_o").alias("first"), F.max_by(value, "_o").alias("last")
    )
    first, last = F.col("first"), F.col("last")
    trend = (
        F.when(first.isNull() | last.isNull(), "flat").when(last > first * lx.RISE_FACTOR, "up")
        .when(last < first * lx.FALL_FACTOR, "down").otherwise("flat")
    )
    return out.withColumn("trend", trend)


def conclude_top1(df: DataFrame, name: str, value: str, by=None) -> DataFrame:
    """Largest row and its lead over the second value; of equal values the smaller name, with no lead.

    Two aggregates that combine on the map side: the largest value, then of the rows at it the
    name and number, and of the rows below it the largest.
    """
    by = by or []
    rows = df.filter(F.col(value).isNotNull())
    best = rows.groupBy(*by).agg(F.max(value).alias("_v"))
    both = rows.join(best, by) if by else rows.withColumn("_v", best.select("_v").scalar())
    at_top = F.col(value) == F.col("_v")
    out = both.groupBy(*by).agg(
        F.min(F.when(at_top, F.col(name))).alias("name"), F.max("_v").alias("value"),
        F.count(F.when(at_top, 1)).alias("_n"), F.max(F.when(F.col(value) < F.col("_v"), F.col(value))).alias("_second"),
    )
    lead = F.when(F.col("_n") > 1, F.lit(0.0)).otherwise(F.col("value") - F.col("_second"))
    if not by:  # no row, no conclusion
        out = out.filter(F.col("value").isNotNull())
    return out.select(*by, "name", "value", F.round(lead, 4).alias("lead"))


def conclude_share(df: DataFrame, name: str, value: str, by=None) -> DataFrame:
    """Share of the largest row in the total, in percent."""
    out = _grouped(df.filter(F.col(value).isNotNull()), by).agg(
        F.max_by(name, F.struct(value, name)).alias("name"), F.max(value).alias("value"),
        F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("total"),
    )
    share = F.when(F.col("total") > 0, F.round(F.col("value") * 100 / F.col("total"), 2))
    return out.withColumn("share", share)


def conclude_compare(df: DataFrame, name: str, value: str, by=None) -> DataFrame:
    """Largest against smallest row; the gap is a percentage of the larger magnitude."""
    out = _grouped(df.filter(F.col(value).isNotNull()), by).agg(
        F.max_by(name, F.struct(value, name)).alias("high_name"), F.max(value).alias("high"),
        F.min_by(name, F.struct(value, name)).alias("low_name"), F.min(value).alias("low"), F.count(F.lit(1)).alias("n"),
    )
    base = F.greatest(F.abs("high"), F.abs("low"))
    gap = F.when(base == 0, 0.0).otherwise(F.abs(F.col("high") - F.col("low")) / base * 100)
    return out.filter("n >= 2").withColumn("gap", F.round(gap, 2)).drop("n")


def conclude_anomaly(df: DataFrame, name: str, value: str, order: Column, by=None) -> DataFrame:
    """Row furthest from the mean; the first one in order wins a tie.

    The mean is a grouped aggregate joined back, so rows of a group are never
    gathered in one task.
    """
    by = by or []
    rows = df.filter(F.col(value).isNotNull()).withColumn("_o", order)
    exact = F.col(value).cast("decimal(28,6)")
    means = rows.groupBy(*by).agg((F.sum(exact).cast("double") / F.count(value)).alias("_mean"))
    if by:
        rows = rows.join(means, by)
    else:
        rows = rows.withColumn("_mean", means.scalar())
    deviation = F.round(F.abs(F.col(value) - F.col("_mean")), 6)
    best = F.min_by(F.struct(F.col(name).alias("name"), F.col(value).alias("value"), F.col("_mean")),
                    F.struct((-deviation).alias("d"), F.col("_o").alias("o")))
    return rows.groupBy(*by).agg(best.alias("b")).select(
        *by, "b.name", "b.value", F.round("b._mean", 4).alias("mean"),
        F.round(F.abs(F.col("b.value") - F.col("b._mean")), 4).alias("deviation"),
    )


def conclude_range(df: DataFrame, value: str, by=None) -> DataFrame:
    """Rows and value range, with the bounds also as text."""
    out = _grouped(df, by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("range_text", F.concat(plain_number(F.col("low")), F.lit(" ~ "), plain_number(F.col("high"))))


def conclude_profile(df: DataFrame, name: str, value: str, by=None) -> DataFrame:
    """Largest group and its size."""
    return _grouped(df.filter(F.col(value).isNotNull()), by).agg(
        F.max_by(name, F.struct(value, name)).alias("name"), F.max(value).alias("value")
    )


def conclude_records(df: DataFrame, name: str, by=None) -> DataFrame:
    """Records found and distinct names covered."""
    return _grouped(df, by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(name).alias("names"))


def first_present(*columns: str) -> Column:
    """First non-null cell of a row as text."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns])


def last_numeric(*columns: str) -> Column:
    """Last cell of a row that reads as a number."""
    return F.coalesce(*[F.trim(F.col(c).cast("string")).try_cast("double") for c in reversed(columns)])
