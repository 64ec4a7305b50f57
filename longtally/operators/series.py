"""Chart series from result rows: long (series, axis position, value) frames.

Results stay in long form; a wide pivot would need a scan for its columns.
Axis items and series are distinct labels, so every window below runs over
periods and series names, not over rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from .. import lexicon as lx
from ..functions import periods
from .runs import numbered


def value_column(df: DataFrame) -> str:
    """Column to plot: ``value`` if present, else the first numeric one after the name column."""
    skipped = {"unit", "period", "期间"}
    rest = [c for c in df.columns[1:] if c not in skipped]
    if "value" in rest:
        return "value"
    numeric = [c for c in rest if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric[0] if numeric else df.columns[-1]


def first_unit(df: DataFrame, order) -> DataFrame:
    """The first non-blank unit."""
    return df.agg(F.min_by("unit", F.when(F.coalesce("unit", F.lit("")) != "", order)).alias("unit"))


def axis_items(df: DataFrame, axis: str) -> DataFrame:
    """Distinct axis labels in time order: raw, label and position."""
    items = df.select(F.coalesce(axis, F.lit("")).alias("raw")).distinct()
    key = periods.axis_key(F.col("raw"))
    placed = numbered(items.select("raw", key["key"].alias("_key"), key["tie"].alias("_tie")), [F.col("_key"), F.col("_tie"), F.col("raw")], "position")
    return placed.select("raw", periods.axis_label(F.col("raw")).alias("label"), "position")


def chart_series(df: DataFrame, axis: str, series: str, value: str, order) -> DataFrame:
    """Long series aligned to the ordered axis; the first row of a (series, axis) cell counts."""
    name = F.coalesce(F.col(series), F.lit("未知"))
    raw = F.coalesce(F.col(axis), F.lit(""))
    cells = df.groupBy(name.alias("series"), raw.alias("raw")).agg(
        F.min_by(F.struct(F.col(value).cast("double").alias("v")), order).alias("_c")
    )
    return cells.join(axis_items(df, axis), "raw").select("series", "position", "label", F.col("_c.v").alias("value"))


def growth_overlay(df: DataFrame, axis: str, series: str, order) -> DataFrame:
    """Growth series for every group that has growth, named apart from the values."""
    rows = df.filter(F.col("growth_rate").isNotNull())
    out = chart_series(rows, axis, series, "growth_rate", order)
    return out.withColumn("series", F.concat(F.lit("增速（%）·"), F.col("series")))


def granularity_guard(df: DataFrame, period: str, order) -> DataFrame:
    """Keep one period length where lengths are mixed: the most frequent, first seen on ties.

    Nothing is dropped when that length has fewer than two rows. Adds ``points``
    (distinct periods kept) and ``few_points`` (fewer than three). Labels are parsed
    and counted once per distinct label; rows pick their length up with one join.
    """
    labels = df.groupBy(F.col(period).alias("_label")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    # the count in the condition keeps filters on the length above the aggregate, where labels are few
    labels = labels.withColumn("granularity", F.when(F.col("n") > 0, periods.granularity(F.col("_label"))))
    counts = labels.filter(F.col("granularity").isNotNull()).groupBy("granularity").agg(
        F.sum("n").alias("n"), F.min("seen").alias("seen")
    )
    best = counts.agg(
        F.min_by(F.struct("granularity", "n"), F.struct((-F.col("n")).alias("a"), F.col("seen").alias("b"))).alias("b"),
        F.count(F.lit(1)).alias("kinds"),
    )
    keep = best.select(F.when((F.col("kinds") > 1) & (F.col("b.n") >= 2), F.col("b.granularity"))).scalar()
    kept = labels.withColumn("_keep", keep).filter(F.col("_keep").isNull() | (F.col("granularity") == F.col("_keep")))
    points = kept.agg(F.count(F.lit(1))).scalar()
    rows = df.join(kept.select("_label", "granularity"), F.col(period).eqNullSafe(F.col("_label"))).drop("_label")
    return rows.withColumn("points", points).withColumn("few_points", F.col("points") < 3)


def _maxima(series_rows: DataFrame) -> DataFrame:
    return series_rows.groupBy("series").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("peak"))


def visible_series(series_rows: DataFrame, limit: int = lx.SHOWN_SERIES) -> DataFrame:
    """Series shown by default: totals first, then by peak, up to the limit.

    The leading series come from a top-k, not from ranking every series.
    """
    is_total = F.col("series").rlike(lx.TOTAL_SERIES_RE)
    peaks = _maxima(series_rows)
    leading = peaks.orderBy(F.when(is_total, 0).otherwise(1), F.desc("peak"), "series").limit(limit)
    leading = leading.select(F.col("series").alias("_s"))
    return peaks.join(leading, F.col("series") == F.col("_s"), "left").select(
        "series", "peak", (is_total | F.col("_s").isNotNull()).alias("shown")
    )


def split_axis(series_rows: DataFrame) -> DataFrame:
    """The series that needs its own axis, if any.

    Its peak must be at least five times (three for a total) the median of the
    other peaks; the median is the element n/2 of the rest in falling order.
    """
    peaks = _maxima(series_rows).filter("peak > 0")
    ranked = numbered(peaks, [F.desc("peak"), F.col("series")], "_r")
    rest = peaks.agg(F.count(F.lit(1)) - 1).scalar()
    middle = ranked.withColumn("_m", rest).filter(F.col("_r") == F.floor(F.col("_m") / 2) + 2).agg(F.max("peak")).scalar()
    top = ranked.filter("_r = 1").withColumn("median", middle)
    share = F.col("peak") / F.col("median")
    is_total = F.col("series").rlike(lx.TOTAL_SERIES_RE)
    split = (F.col("median") > 0) & ((share >= lx.SPLIT_RATIO) | (is_total & (share >= lx.SPLIT_RATIO_TOTAL)))
    return top.select("series", "peak", "median", F.coalesce(split, F.lit(False)).alias("split"))


def pie_slices(df: DataFrame, value: str) -> DataFrame | None:
    """Slices of the latest period only.

    Where the first column is the period, the category column names the slices;
    without one there is no pie and None comes back.
    """
    period = next((c for c in df.columns if re.fullmatch("period|期间", c)), None)
    name = df.columns[0]
    if period is None:
        return df.select(F.col(name).alias("name"), F.col(value).alias("value"))
    if name == period:
        name = next((c for c in df.columns if c in ("industry", "产业", "region", "区县")), None)
        if name is None:
            return None
    key = periods.axis_key(F.col(period))
    newest = df.agg(F.max(F.struct(key["key"], key["tie"], F.col(period)))).scalar()
    rows = df.filter(F.struct(key["key"], key["tie"], F.col(period)) == newest)
    return rows.select(F.col(name).alias("name"), F.col(value).alias("value"))
