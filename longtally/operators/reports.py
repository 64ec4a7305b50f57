"""Report tables: growth, core sheets, rankings, profiles, wide months, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions.periods import growth_percent
from .merge import keep_first
from .select import latest_period


def yoy(long: DataFrame) -> DataFrame:
    """Growth against the equal period of the year before, as an equi self-join."""
    keys = ["region", "indicator_name", "start", "end"]
    before = long.filter(F.col("value").isNotNull()).select(
        *keys, (F.col("year") + 1).alias("year"), F.col("value").alias("_before")
    )
    return long.join(before, keys + ["year"], "left").withColumn(
        "yoy", growth_percent(F.col("value"), F.col("_before"))
    ).drop("_before")


def wan_to_yi(value: Column, unit: Column, at_least: float = 1000.0) -> tuple[Column, Column]:
    """Values in 万元 of at least the limit become 亿元 with two digits."""
    big = F.coalesce((unit == "万元") & (F.abs(value) >= at_least), F.lit(False))
    return F.when(big, F.round(value / 10000, 2)).otherwise(value), F.when(big, "亿元").otherwise(unit)


def prefer_value(df: DataFrame, *keys: str, order: Column) -> DataFrame:
    """First row per key, but a row with a value beats one without."""
    return keep_first(df, keys, F.col("value").isNull(), order)


def core_sheet(long: DataFrame, metrics, region: str = lx.TOTAL_REGION, period: str | None = None) -> DataFrame:
    """Wanted metrics of one period, in the wanted order, with a row even where no data exists."""
    wanted = lx.lookup_frame(long.sparkSession, list(enumerate(metrics, 1)), "position", "metric")
    rows = long.filter((F.col("region") == region) & F.col("indicator_name").isin(list(metrics)))
    rows = latest_period(rows) if period is None else rows.filter(F.col("period") == period)
    rows = prefer_value(rows, "indicator_name", order=F.col("sheet_name"))
    value, unit = wan_to_yi(F.col("value"), F.col("unit"))
    return wanted.join(rows, F.col("metric") == F.col("indicator_name"), "left").select(
        "position", "metric", value.alias("value"), unit.alias("unit"), "growth_rate"
    )


def region_ranking(long: DataFrame, metric: str, by: str = "value", period: str | None = None) -> DataFrame:
    """Regions of one metric and period, one row each, numbered from the highest."""
    rows = long.filter((F.col("indicator_name") == metric) & (F.col("region") != lx.TOTAL_REGION))
    rows = latest_period(rows) if period is None else rows.filter(F.col("period") == period)
    one = prefer_value(rows, "region", order=F.col("sheet_name"))
    order = Window.partitionBy("indicator_name", "period").orderBy(F.desc_nulls_last(by), "region")
    return one.withColumn("position", F.row_number().over(order)).select(
        "position", "region", "value", "unit", "growth_rate"
    )


def region_profile(long: DataFrame, region: str) -> DataFrame:
    """Indicators of a region at its latest period with their rank where one was published."""
    rows = latest_period(long.filter(F.col("region") == region))
    is_rank = F.endswith(F.col("indicator_name"), F.lit(lx.RANK_SUFFIX))
    ranks = rows.filter(is_rank).select(
        F.regexp_replace("indicator_name", lx.RANK_SUFFIX + "$", "").alias("_base"),
        F.col("value").cast("int").alias("position"),
    )
    return rows.filter(~is_rank).join(ranks, F.col("indicator_name") == F.col("_base"), "left").select(
        "indicator_name", "value", "unit", "growth_rate", "position"
    )


def structure(long: DataFrame, parts, total: str, region: str = lx.TOTAL_REGION) -> DataFrame:
    """Share of each part in the total at the latest period of the parts, in percent."""
    rows = latest_period(long.filter(
        (F.col("region") == region) & F.col("indicator_name").isin([*parts, total]) & F.col("value").isNotNull()
    ))
    whole = rows.filter(F.col("indicator_name") == total).select("period", F.col("value").alias("_total"))
    return rows.filter(F.col("indicator_name").isin(list(parts))).join(whole, "period").select(
        "period", "indicator_name", "value",
        F.round(F.col("value") / F.nullif("_total", F.lit(0.0)) * 100, 1).alias("share"),
    )


def ratio(long: DataFrame, top: str, bottom: str) -> DataFrame:
    """One indicator over another at the same period and region; null on zero."""
    pick = lambda name: F.max(F.when(F.col("indicator_name") == name, F.col("value")))
    both = long.filter(F.col("indicator_name").isin(top, bottom)).groupBy("period", "region").agg(
        pick(top).alias("top"), pick(bottom).alias("bottom")
    )
    return both.select(
        "period", "region", F.round(F.col("top") / F.nullif("bottom", F.lit(0.0)), 3).alias("ratio")
    ).filter(F.col("ratio").isNotNull())


def monthly_wide(long: DataFrame, indicators, region: str = lx.TOTAL_REGION) -> DataFrame:
    """period x indicators with values and repeat counts; the column list is given, not scanned for."""
    rows = long.filter((F.col("region") == region) & F.col("indicator_name").isin(list(indicators)))
    cells = []
    for i, name in enumerate(indicators, 1):
        mine = F.col("indicator_name") == name
        cells += [
            F.min_by("value", F.when(mine & F.col("value").isNotNull(), F.struct("sheet_name", "value"))).alias(f"value_{i}"),
            F.count(F.when(mine, 1)).alias(f"repeats_{i}"),
        ]
    return rows.groupBy("period").agg(*cells)


def annual_fallback(long: DataFrame, sources) -> DataFrame:
    """One value per year from the first source that has one; larger values first within a source.

    ``sources`` lists (label, predicate) in order of trust.
    """
    level = reduce(
        lambda other, item: F.when(item[1][1], item[0]).otherwise(other),
        reversed(list(enumerate(sources))), F.lit(None).cast("int"),
    )
    label = F.element_at(F.array(*[F.lit(name) for name, _ in sources]), F.col("_level") + 1)
    rows = long.withColumn("_level", level).filter(F.col("_level").isNotNull() & F.col("value").isNotNull())
    best = F.min_by(F.struct("value", "_level"), F.struct(F.col("_level"), -F.col("value")))
    return rows.groupBy("year").agg(best.alias("_b")).select("year", "_b.*").select(
        "year", "value", label.alias("source")
    )


def leaders(long: DataFrame, by: str = "value") -> DataFrame:
    """Best region of each indicator at the indicator's own latest period."""
    rows = _own_latest(long, by)
    order = F.struct(F.col(by).alias("a"), F.col("region").alias("b"))
    return rows.groupBy("indicator_name").agg(
        F.max_by("region", order).alias("region"), F.max(by).alias(by)
    )


def often_in_top(long: DataFrame, by: str = "value", top: int = 3, at_least: int = 2) -> DataFrame:
    """Regions that stand in the top ranks of several indicators."""
    order = Window.partitionBy("indicator_name").orderBy(F.col(by).desc())
    ranked = _own_latest(long, by).withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= top)
    return ranked.groupBy("region").agg(F.count(F.lit(1)).alias("indicators")).filter(F.col("indicators") >= at_least)


def _own_latest(long: DataFrame, by: str) -> DataFrame:
    rows = long.filter((F.col("region") != lx.TOTAL_REGION) & F.col(by).isNotNull() & ~F.endswith(
        F.col("indicator_name"), F.lit(lx.RANK_SUFFIX)))
    newest = rows.groupBy("indicator_name").agg(F.max(F.struct("year", "end", "start")).alias("_k"))
    newest = newest.select("indicator_name", "_k.year", "_k.end", "_k.start")
    return rows.join(newest, ["indicator_name", "year", "end", "start"], "left_semi")
