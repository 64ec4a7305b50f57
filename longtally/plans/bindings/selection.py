"""Trends, snapshots, filters and limits on the clean long table."""

from pyspark.sql import functions as F

from ...operators import cursors, select as op
from ...sources import bridge as b
from ..catalog import query


@query("region_snapshot")
def region_snapshot(spark, sf):
    return op.region_snapshot(b.indicator_long(spark, sf))


@query("region_snapshot_in_year")
def region_snapshot_in_year(spark, sf):
    return op.region_snapshot(b.indicator_long(spark, sf), "规模工业增加值", "1999年")


@query("latest_snapshot")
def latest_snapshot(spark, sf):
    return op.latest_snapshot(b.indicator_long(spark, sf), ["第一产业", "第二产业", "第三产业"])


@query("latest_snapshot_income")
def latest_snapshot_income(spark, sf):
    return op.latest_snapshot(b.indicator_long(spark, sf), ["城镇居民人均可支配收入"])


@query("cumulative_trend")
def cumulative_trend(spark, sf):
    return op.cumulative_trend(b.indicator_long(spark, sf), ["地区生产总值(GDP)"])


@query("cumulative_trend_last_years")
def cumulative_trend_last_years(spark, sf):
    return op.cumulative_trend(b.indicator_long(spark, sf), None, time_range="近3年")


@query("cumulative_trend_in_year")
def cumulative_trend_in_year(spark, sf):
    return op.cumulative_trend(b.indicator_long(spark, sf), ["第二产业"], time_range="1998年")


@query("region_trend")
def region_trend(spark, sf):
    return op.region_trend(b.indicator_long(spark, sf), "地区生产总值", "近2年")


@query("growth_only_trend")
def growth_only_trend(spark, sf):
    return op.cumulative_trend(b.indicator_long(spark, sf), ["规模工业增加值"])


@query("last_years_window")
def last_years_window(spark, sf):
    return op.last_years(b.indicator_long(spark, sf), 2).groupBy("year", "indicator_name").agg(F.count(F.lit(1)).alias("n"))


@query("equal_period_years")
def equal_period_years(spark, sf):
    rows = b.indicator_long(spark, sf).filter(F.col("indicator_name") == "地区生产总值")
    return op.same_period(rows).select("period", "region", "value")


@query("relative_window")
def relative_window(spark, sf):
    facts = b.order_facts(spark, sf, dimensions=False)
    newest = facts.agg(F.max("order_date")).scalar()
    return (
        op.relative_window(facts, "order_date", newest, "近3个月")
        .groupBy("order_date").agg(F.sum("order_count").alias("order_count"))
    )


@query("title_search")
def title_search(spark, sf):
    return op.title_search(b.records(spark, sf), "the", category="财政信息").select("record_id", "title")


@query("scope_filters")
def scope_filters(spark, sf):
    raw = b.indicator_raw(spark, sf)
    return op.in_scope(raw, "XLSX", "high", low=1500.0, high=45000.0).select("id", "period", "indicator_name", "value")


@query("suffix_families")
def suffix_families(spark, sf):
    name = F.col("indicator_name")
    family = (
        F.when(F.endswith(name, F.lit("排名")), "rank")
        .when(F.endswith(name, F.lit("投资")) & (F.contains(name, F.lit("用电总量")) | F.contains(name, F.lit("商品房"))), "polluted")
        .when(F.startswith(name, F.lit("其中")), "part")
        .otherwise("plain")
    )
    return b.indicator_raw(spark, sf).groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("indicator_name").alias("names")
    )


@query("label_format_classes")
def label_format_classes(spark, sf):
    from ...functions.periods import is_standard

    cls = F.when(is_standard(F.col("period")), "STD").otherwise("OTHER")
    return b.indicator_raw(spark, sf).groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_series_points")
def distinct_series_points(spark, sf):
    return (
        b.indicator_raw(spark, sf)
        .filter((F.col("indicator_name") == "地区生产总值") & F.col("value").isNotNull())
        .select("period", "region", "unit").distinct()
    )


@query("rescale_large_values")
def rescale_large_values(spark, sf):
    raw = b.indicator_raw(spark, sf).filter(F.col("indicator_name").like("%用电总量%") & F.col("value").isNotNull())
    return raw.select("id", op.rescale_above(F.col("value") * 10).alias("value"))


@query("value_or_growth_fallback")
def value_or_growth_fallback(spark, sf):
    raw = b.indicator_raw(spark, sf).filter(F.col("value").isNotNull() | F.col("growth_rate").isNotNull())
    return op.value_or_growth(raw).groupBy("value_kind", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("preview_page")
def preview_page(spark, sf):
    return op.paged(b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 3, 100, "o_orderkey")


@query("history_page")
def history_page(spark, sf):
    steps = b.trace(spark, sf).groupBy("session_id").agg(
        F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("steps")
    )
    return op.paged(steps, 2, 10, F.desc("last_at"), "session_id")


@query("controlled_query")
def controlled_query(spark, sf):
    b.indicator_raw(spark, sf).createOrReplaceTempView("indicator_raw")
    rows = spark.sql(
        "SELECT id, period, indicator_name, value FROM indicator_raw "
        "WHERE source_type = 'XLSX' AND value IS NOT NULL"
    )
    return op.controlled(rows, 500, F.desc("value"), "id")


@query("next_page")
def next_page(spark, sf):
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return op.page_after(orders, "o_orderkey", 500, 100)


@query("page_behind_cursor")
def page_behind_cursor(spark, sf):
    steps, order = b.trace(spark, sf).select("step_id", "status", "duration_ms", "created_at"), [("status", False), ("duration_ms", True), ("step_id", False)]
    first = cursors.last_cursor(cursors.page(steps, order, 100), order)
    return cursors.page(steps, order, 100, first).drop("cursor")
