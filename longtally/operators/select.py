"""Queries on the clean long table: scopes, trends and latest-period snapshots.

"Latest" is always decided on numbers (year, end month), never on label text, and
as a scalar subquery: one partial aggregate over the scope, no window, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import periods


def with_period(long: DataFrame, column: str = "period") -> DataFrame:
    """Add year, start, end and kind parsed from the label, where they are missing."""
    if {"year", "start", "end"} <= set(long.columns):
        return long
    return long.withColumn("_p", periods.parse(F.col(column))).select("*", "_p.*").drop("_p")


def scope(long: DataFrame, metrics, region: str | None = None, exclude_region: str | None = None) -> DataFrame:
    """Rows of some metrics in one region (or all but one) that carry a number."""
    out = long.filter(F.col("indicator_name").isin(list(metrics)))
    if region is not None:
        out = out.filter(F.col("region") == region)
    if exclude_region is not None:
        out = out.filter(F.col("region") != exclude_region)
    return out.filter(F.col("value").isNotNull() | F.col("growth_rate").isNotNull())


def value_or_growth(df: DataFrame) -> DataFrame:
    """Value, else growth; the unit says which one it is ('%' where blank)."""
    return df.withColumn(
        "value_kind", F.when(F.col("value").isNotNull(), F.lit("value")).otherwise(F.lit("growth"))
    ).withColumn("value", F.coalesce("value", "growth_rate")).withColumn(
        "unit", F.coalesce(F.nullif("unit", F.lit("")), F.lit("%"))
    )


def parse_years(time_range: str | None) -> tuple[str, int] | None:
    """("absolute", 2024), ("last", 3) or None from a range such as "近3年"."""
    found = re.search(r"(\d+)\s*年", time_range or "")
    if not found or int(found.group(1)) <= 0:
        return None
    n = int(found.group(1))
    return ("absolute", n) if 1000 <= n <= 2999 else ("last", n)


def last_years(df: DataFrame, n: int) -> DataFrame:
    """Keep the n latest years, counted from the data's own last year."""
    newest = df.agg(F.max("year")).scalar()
    return df.filter(F.col("year") >= newest - (n - 1))


def in_years(df: DataFrame, time_range: str | None, absolute_only: bool = False) -> DataFrame:
    years = parse_years(time_range)
    if years is None:
        return df
    kind, n = years
    if kind == "absolute":
        return df.filter(F.col("year") == n)
    return df if absolute_only else last_years(df, n)


def latest_key(df: DataFrame) -> Column:
    """struct(year, end, start) of the latest period, as a scalar subquery."""
    return df.agg(F.max(F.struct("year", "end", "start"))).scalar()


def latest_period(df: DataFrame) -> DataFrame:
    """Rows of the latest period that exists in the frame."""
    return df.filter(F.struct("year", "end", "start") == latest_key(df))


def same_period(df: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """Rows whose start and end months equal those of the latest period of ``basis``."""
    basis = df if basis is None else basis
    key = basis.agg(F.max(F.struct("year", "end", "start")).alias("k")).select(F.struct("k.start", "k.end")).scalar()
    return df.filter(F.struct("start", "end") == key)


def expand_metrics(metrics) -> list[str]:
    """Canonical names; any income metric pulls in the other income metrics."""
    names = [lx.QUERY_METRICS.get(m, m) for m in metrics]
    return list(lx.INCOME_METRICS) if set(names) & set(lx.INCOME_METRICS) else names


def cumulative_trend(long: DataFrame, metrics=None, region: str = lx.TOTAL_REGION, time_range: str | None = None) -> DataFrame:
    """Series by period over equal cumulative periods only."""
    rows = scope(with_period(long), expand_metrics(metrics or lx.SECTOR_METRICS), region=region)
    return value_or_growth(same_period(in_years(rows, time_range), rows)).select(
        "period", F.col("indicator_name").alias("industry"), "value", "unit"
    )


def region_trend(long: DataFrame, metric: str = "地区生产总值", time_range: str | None = None) -> DataFrame:
    """The same by region, the total region left out."""
    rows = scope(with_period(long), [lx.QUERY_METRICS.get(metric, metric)], exclude_region=lx.TOTAL_REGION)
    return value_or_growth(same_period(in_years(rows, time_range), rows)).select(
        "period", "region", "value", "growth_rate", "unit"
    )


def latest_snapshot(long: DataFrame, metrics=None, region: str = lx.TOTAL_REGION, time_range: str | None = None) -> DataFrame:
    """Values at the latest period of the scope, highest first."""
    rows = scope(with_period(long), expand_metrics(metrics or lx.SECTOR_METRICS), region=region)
    latest = latest_period(in_years(rows, time_range, absolute_only=True))
    return value_or_growth(latest).select(
        "period", F.col("indicator_name").alias("industry"), "value", "unit"
    ).orderBy(F.desc_nulls_last("value"), "industry")


def region_snapshot(long: DataFrame, metric: str = "地区生产总值", time_range: str | None = None) -> DataFrame:
    """One metric by region at the latest period, highest first."""
    rows = scope(with_period(long), [lx.QUERY_METRICS.get(metric, metric)], exclude_region=lx.TOTAL_REGION)
    latest = latest_period(in_years(rows, time_range, absolute_only=True))
    return value_or_growth(latest).select("region", "value", "growth_rate", "unit").orderBy(
        F.desc_nulls_last("value"), "region"
    )


def relative_window(df: DataFrame, date_column: str, as_of: Column, time_range: str | None = None) -> DataFrame:
    """Rows of the last N days, weeks, months or years before ``as_of`` (30 days by default)."""
    found = re.search(r"(\d+)\s*(年|个月|月|周|星期|天|日)", time_range or "")
    n, unit = (int(found.group(1)), found.group(2)) if found else (30, "天")
    if unit == "年" and 1000 <= n <= 2999:
        n, unit = 30, "天"
    months = {"年": 12 * n, "个月": n, "月": n}.get(unit)
    if months is not None:
        floor = F.add_months(as_of, -months)
    else:
        floor = F.date_sub(as_of, 7 * n if unit in ("周", "星期") else n)
    return df.filter(F.col(date_column) >= floor)


def title_search(df: DataFrame, text: str, column: str = "title", **equals) -> DataFrame:
    """Substring search on a title with optional equality filters."""
    out = df.filter(F.contains(F.col(column), F.lit(text)))
    for name, value in equals.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def in_scope(long: DataFrame, source_type=None, confidence=None, period=None, region=None, low=None, high=None) -> DataFrame:
    """Fixed-scope filters on source, confidence, period, region and plausible values."""
    for name, value in (("source_type", source_type), ("confidence", confidence), ("period", period), ("region", region)):
        if value is not None:
            long = long.filter(F.col(name) == value)
    return long if low is None else long.filter(F.col("value").between(low, high))


def same_parent(left: DataFrame, parent_id) -> DataFrame:
    """Rows with this parent; null finds the roots."""
    return left.filter(F.col("parent_id").eqNullSafe(F.lit(parent_id).cast("string")))


def rescale_above(value: Column, limit: float = 10000.0, divisor: float = 10000.0) -> Column:
    return F.when(value > limit, F.round(value / divisor, 4)).otherwise(value)


def paged(df: DataFrame, page: int, size: int, *order: Column | str, max_size: int = 100) -> DataFrame:
    """One page in key order with the total row count on each row. A size above ``max_size`` is an error."""
    if not 1 <= size <= max_size:
        raise ValueError(f"a page has 1 to {max_size} rows, not {size}")
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size).withColumn("total", total)


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The page behind the row with key ``last`` (None: the first page), in order of a unique key.

    However deep, each task keeps ``size`` rows only.
    """
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(size)


def controlled(df: DataFrame, max_rows: int, *order: Column | str) -> DataFrame:
    """The first ``max_rows`` rows in ``order``, with ``more_rows`` true on each if the result has more than that."""
    first = df.orderBy(*order).limit(max_rows + 1)
    count = first.agg(F.count(F.lit(1))).scalar()
    return first.orderBy(*order).limit(max_rows).withColumn("more_rows", count > max_rows)
