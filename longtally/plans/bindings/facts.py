"""Template aggregates on demo facts and publication records."""

from pyspark.sql import functions as F

from ... import lexicon as lx
from ...operators import aggregate as op, select
from ...sources import bridge as b, stores
from ...sources.workspace import new_path
from ..catalog import query


@query("sales_trend_by_date")
def sales_trend_by_date(spark, sf):
    return op.totals(b.order_facts(spark, sf, dimensions=False), "order_date", "order_count", "sales_amount")


@query("sales_by_region_channel")
def sales_by_region_channel(spark, sf):
    return op.totals(b.order_facts_by_customer(spark, sf), ["region", "channel"], "sales_amount", "order_count")


@query("user_profile")
def user_profile(spark, sf):
    return op.totals(b.user_facts(spark, sf), ["age_group", "city"], "new_user_count", "active_user_count")


@query("category_ranking_top10")
def category_ranking_top10(spark, sf):
    return op.top_totals(b.product_facts(spark, sf), "category", "sales_volume", "sales_amount")


@query("brand_ranking_top10")
def brand_ranking_top10(spark, sf):
    return op.top_totals(b.product_facts(spark, sf), "brand", "sales_volume", "sales_amount")


@query("category_structure")
def category_structure(spark, sf):
    return op.totals(b.product_facts(spark, sf), "category", "sales_amount")


@query("retention_by_cohort")
def retention_by_cohort(spark, sf):
    return op.mean_rate(b.user_facts(spark, sf), "register_date", "retention_rate")


@query("anomaly_feed_latest30")
def anomaly_feed_latest30(spark, sf):
    return op.latest_detail(b.order_facts(spark, sf), "order_date", "region", "order_count", "sales_amount")


@query("average_order_amount")
def average_order_amount(spark, sf):
    return op.average_amount(b.order_facts(spark, sf), ["order_date", "region"], "sales_amount", "order_count")


@query("records_by_month")
def records_by_month(spark, sf):
    dated = b.records(spark, sf).filter(F.col("publish_date").isNotNull())
    return op.count_by(dated, op.month_label("publish_date").alias("month"))


@query("records_by_month_recent")
def records_by_month_recent(spark, sf):
    rows = b.records(spark, sf)
    recent = select.relative_window(rows, "publish_date", F.lit("2025-06-30").cast("date"), "近3年")
    return op.count_by(recent, op.month_label("publish_date").alias("month"))


@query("records_by_unit_top10")
def records_by_unit_top10(spark, sf):
    rows = op.count_by(b.records(spark, sf), op.display_unit().alias("unit"))
    return rows.orderBy(F.desc("doc_count"), "unit").limit(10)


@query("records_by_category")
def records_by_category(spark, sf):
    return op.count_by(b.records(spark, sf), "category")


@query("records_by_category_unit")
def records_by_category_unit(spark, sf):
    return op.count_by(b.records(spark, sf), "category", "publish_unit")


@query("category_share")
def category_share(spark, sf):
    return op.share_of_total(b.records(spark, sf), "category")


@query("daily_average")
def daily_average(spark, sf):
    return op.daily_average(b.records(spark, sf), "publish_date")


@query("publication_statistics")
def publication_statistics(spark, sf):
    return op.publication_statistics(b.page_statistics(spark, sf), "2022-01-01", lx.TOPIC_STOP_WORDS)


@query("most_common_indicators")
def most_common_indicators(spark, sf):
    return op.most_common(b.indicator_raw(spark, sf), "indicator_name")


@query("mode_unit_per_indicator")
def mode_unit_per_indicator(spark, sf):
    return op.mode_per_group(b.indicator_raw(spark, sf), "indicator_name", "unit")


@query("distinct_profile_by_source")
def distinct_profile_by_source(spark, sf):
    return op.distinct_profile(b.indicator_raw(spark, sf), "source_type", "period", "region", "indicator_name")


@query("dataset_profile")
def dataset_profile(spark, sf):
    raw = b.indicator_raw(spark, sf)
    return raw.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("period", "region", "indicator_name").alias("keys"),
        F.countDistinct("region").alias("regions"), F.countDistinct("period").alias("periods"),
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.when(F.coalesce("unit", F.lit("")) == "", 1)).alias("blank_units"),
    )


@query("unit_distribution")
def unit_distribution(spark, sf):
    return op.count_by(b.indicator_raw(spark, sf), F.coalesce("unit", F.lit("")).alias("unit"), name="n")


@query("format_fingerprint")
def format_fingerprint(spark, sf):
    return op.format_fingerprint(b.indicator_raw(spark, sf))


@query("any_sheet_per_indicator")
def any_sheet_per_indicator(spark, sf):
    return b.indicator_raw(spark, sf).groupBy("indicator_name").agg(F.max("sheet_name").alias("sheet_name"))


@query("step_outcomes")
def step_outcomes(spark, sf):
    return op.outcome_matrix(b.trace(spark, sf), "step_type", "status", ["SUCCESS", "FAILED"])


@query("asset_overview")
def asset_overview(spark, sf):
    return op.asset_overview(b.indicator_raw(spark, sf), ["source_type", "confidence"], ["region", "period", "indicator_name"])


@query("split_by_source")
def split_by_source(spark, sf):
    path = new_path(spark, "by-source")
    stores.write_by_source(b.indicator_raw(spark, sf).select("id", "source_type", "period"), path)
    return spark.read.parquet(path)
