"""Conclusions and chart series."""

from pyspark.sql import functions as F

from ... import lexicon as lx
from ...functions import periods, text
from ...operators import insight as i, select, series as s
from ...sources import bridge as b
from .. import rebuild
from ..catalog import query



def _values(spark, sf):
    return b.indicator_long(spark, sf).filter(F.col("value").isNotNull())


@query("conclude_trend")
def conclude_trend(spark, sf):
    yearly = select.same_period(b.indicator_long(spark, sf))
    return i.conclude_trend(yearly, "value", F.col("year"), ["region", "indicator_name"])


@query("conclude_trend_overall")
def conclude_trend_overall(spark, sf):
    return i.conclude_trend(b.indicator_long(spark, sf), "value", F.struct("year", "end", "start"), ["region", "indicator_name"])


@query("conclude_top1")
def conclude_top1(spark, sf):
    rows = _values(spark, sf).filter(F.col("region") != lx.TOTAL_REGION)
    return i.conclude_top1(rows, "region", "value", ["period", "indicator_name"])


@query("conclude_top1_overall")
def conclude_top1_overall(spark, sf):
    return i.conclude_top1(b.indicator_raw(spark, sf).filter(F.col("value").isNotNull()), "indicator_name", "value")


@query("conclude_share")
def conclude_share(spark, sf):
    rows = _values(spark, sf).filter(F.col("indicator_name").isin(lx.SECTOR_METRICS))
    return i.conclude_share(rows, "indicator_name", "value", ["period", "region"])


@query("conclude_compare")
def conclude_compare(spark, sf):
    rows = _values(spark, sf).filter(F.col("region") != lx.TOTAL_REGION)
    return i.conclude_compare(rows, "region", "value", ["period", "indicator_name"])


@query("conclude_anomaly")
def conclude_anomaly(spark, sf):
    rows = _values(spark, sf).filter((F.col("region") != lx.TOTAL_REGION) & F.col("indicator_name").isin(lx.SECTOR_METRICS))
    return i.conclude_anomaly(rows, "region", "value", F.col("region"), ["period", "indicator_name"])


@query("conclude_anomaly_overall")
def conclude_anomaly_overall(spark, sf):
    raw = b.indicator_raw(spark, sf).filter(F.col("value").isNotNull())
    return i.conclude_anomaly(raw, "id", "value", F.col("id"))


@query("conclude_range")
def conclude_range(spark, sf):
    raw = b.indicator_raw(spark, sf).withColumn("whole", F.floor("value").cast("double"))
    return i.conclude_range(raw, "whole", ["sheet_name"])


@query("conclude_profile")
def conclude_profile(spark, sf):
    from ...operators.aggregate import totals

    groups = totals(b.user_facts(spark, sf), ["age_group", "city"], "active_user_count")
    return i.conclude_profile(groups, "city", "active_user_count", ["age_group"])


@query("conclude_records")
def conclude_records(spark, sf):
    return i.conclude_records(b.records(spark, sf), "category")


@query("row_name_and_number")
def row_name_and_number(spark, sf):
    raw = b.indicator_raw(spark, sf)
    return raw.select(
        "id", i.first_present("unit", "period").alias("name"),
        i.last_numeric("value", "growth_rate", "sheet_name").alias("number"))


@query("axis_order")
def axis_order(spark, sf):
    labels = b.indicator_raw(spark, sf).select("period").unionByName(b.indicator_long(spark, sf).select("period"))
    return s.axis_items(labels, "period")


@query("chart_series")
def chart_series(spark, sf):
    rows = select.region_trend(b.indicator_long(spark, sf))
    return s.chart_series(rows, "period", "region", s.value_column(rows), F.col("value"))


@query("growth_overlay")
def growth_overlay(spark, sf):
    rows = select.region_trend(b.indicator_long(spark, sf))
    return s.growth_overlay(rows, "period", "region", F.col("value"))


@query("granularity_guard")
def granularity_guard(spark, sf):
    rows = s.granularity_guard(rebuild.kept_periods(spark, sf), "period", F.col("id"))
    return rows.select("id", "period", "granularity", "points", "few_points")


@query("period_granularity")
def period_granularity(spark, sf):
    raw = b.indicator_raw(spark, sf)
    return raw.groupBy("period", periods.granularity(F.col("period")).alias("months")).agg(F.count(F.lit(1)).alias("n"))


def _gdp_series(spark, sf):
    rows = b.indicator_long(spark, sf).filter(F.col("indicator_name") == "地区生产总值")
    return s.chart_series(rows, "period", "region", "value", F.col("value"))


@query("visible_series")
def visible_series(spark, sf):
    return s.visible_series(_gdp_series(spark, sf))


@query("dual_axis_split")
def dual_axis_split(spark, sf):
    return s.split_axis(_gdp_series(spark, sf))


@query("pie_slices")
def pie_slices(spark, sf):
    rows = b.indicator_long(spark, sf).filter(
        (F.col("region") == lx.TOTAL_REGION) & F.col("indicator_name").isin(lx.SECTOR_METRICS)
    ).select("period", F.col("indicator_name").alias("industry"), "value")
    return s.pie_slices(rows, "value")


@query("first_unit")
def first_unit(spark, sf):
    return s.first_unit(b.indicator_raw(spark, sf), F.col("id"))


@query("shortened_texts")
def shortened_texts(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select("doc_id", text.ellipsis(F.col("text"), 60).alias("short"))


@query("plain_numbers")
def plain_numbers(spark, sf):
    v = (F.col("o_orderkey") % 1000) / F.lit(8.0)
    return b.table(spark, sf, "orders").groupBy(text.plain_number(v).alias("printed")).agg(F.count(F.lit(1)).alias("n"))
