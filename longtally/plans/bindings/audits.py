"""Audits, checks and reports on the clean tables."""

from pyspark.sql import functions as F

from ... import lexicon as lx
from ...operators import quality as q, reports as r
from ...sources import bridge as b
from .. import rebuild
from ..catalog import query


@query("coverage_curve")
def coverage_curve(spark, sf):
    return q.coverage_curve(rebuild.clean(spark, sf))


@query("leftovers")
def leftovers(spark, sf):
    return q.leftovers(rebuild.clean(spark, sf))


@query("latest_universe_in_years")
def latest_universe_in_years(spark, sf):
    clean = rebuild.clean(spark, sf)
    rows = clean.select(F.substring("period", 1, 4).alias("year"), "indicator_name").distinct()
    return rows.join(q.latest_universe(clean), "indicator_name", "left_semi")


@query("not_in_latest_year")
def not_in_latest_year(spark, sf):
    raw = b.indicator_raw(spark, sf)
    recent = raw.filter(F.startswith(F.col("period"), F.lit("2001年1-9"))).select("region", "indicator_name")
    return raw.select("region", "indicator_name").subtract(recent)


@query("in_both_years")
def in_both_years(spark, sf):
    raw = b.indicator_raw(spark, sf)
    names = lambda y: raw.filter(F.startswith(F.col("period"), F.lit(y))).select("region", "indicator_name")
    return names("1997年").intersect(names("2000年"))


@query("sanity_check_raw")
def sanity_check_raw(spark, sf):
    return q.sanity_check(b.indicator_raw(spark, sf).select("period", "region", "indicator_name", "value", "growth_rate"))


@query("sanity_check_snapshot")
def sanity_check_snapshot(spark, sf):
    return q.sanity_check(b.indicator_long(spark, sf).select("period", "region", "indicator_name", "value", "growth_rate"))


@query("exact_duplicates")
def exact_duplicates(spark, sf):
    raw = b.indicator_raw(spark, sf)
    return q.exact_duplicates(raw.select("period", "region", "indicator_name", F.floor(F.col("value") / 50000).alias("value")))


@query("anchors")
def anchors(spark, sf):
    spec = [
        ("2000年1-12月", "全市", "客运量(万人)", 2300.0, 100.0), ("2001年1-3月", "全市", "地区生产总值", 1.0, 0.5),
        ("1990年1-3月", "全市", "地区生产总值", 1.0, 0.5),
    ]
    return q.anchors(b.indicator_long(spark, sf), spec)


@query("residue_checks")
def residue_checks(spark, sf):
    return q.residue_checks(rebuild.clean(spark, sf))


@query("expectation_check")
def expectation_check(spark, sf):
    results = b.indicator_long(spark, sf).select(F.col("indicator_name").alias("metric"), "value", "growth_rate")
    expected = lx.lookup_frame(
        spark,
        [("地区生产总值", 3, 5.0), ("规模工业增加值", 3, None), ("公路(万人)", 500, 1.0), ("没有的指标", 1, 2.0)],
        "metric", "min_rows", "target_text",
    ).select("metric", "min_rows", F.col("target_text").cast("double").alias("target"))
    return q.expectation_check(results, expected, "metric", ["value", "growth_rate"], tolerance=0.5)


@query("falling_cumulatives")
def falling_cumulatives(spark, sf):
    return q.falling_cumulatives(b.indicator_long(spark, sf).withColumn(
        "value", F.when((F.col("year") == 1999) & (F.col("end") == 6), F.col("value") / 2).otherwise(F.col("value"))))


@query("identity_gaps")
def identity_gaps(spark, sf):
    return q.identity_gaps(b.indicator_long(spark, sf), ["公路(万人)", "水运(万人)"], "客运量(万人)", -1.0)


@query("growth_disagreements")
def growth_disagreements(spark, sf):
    long = b.indicator_long(spark, sf)
    moved = F.when(F.col("end") == 5, F.col("growth_rate") + 1).otherwise(F.col("growth_rate"))
    return q.growth_disagreements(long.withColumn("growth_rate", moved))


@query("mixed_units")
def mixed_units(spark, sf):
    return q.mixed_units(b.indicator_raw(spark, sf))


@query("core_sheet")
def core_sheet(spark, sf):
    return r.core_sheet(b.indicator_long(spark, sf), ["地区生产总值", "规模工业增加值", "客运量(万人)", "全体居民人均可支配收入"])


@query("region_ranking")
def region_ranking(spark, sf):
    return r.region_ranking(b.indicator_long(spark, sf), "地区生产总值")


@query("region_ranking_by_growth")
def region_ranking_by_growth(spark, sf):
    return r.region_ranking(b.indicator_long(spark, sf), "规模工业增加值", by="growth_rate", period="1999年1-6月")


@query("region_profile")
def region_profile(spark, sf):
    return r.region_profile(b.indicator_long(spark, sf), "NATION_7")


@query("sector_structure")
def sector_structure(spark, sf):
    return r.structure(b.indicator_long(spark, sf), lx.SECTOR_METRICS, "地区生产总值")


@query("income_ratio")
def income_ratio(spark, sf):
    return r.ratio(b.indicator_long(spark, sf), "城镇居民人均可支配收入", "农村居民人均可支配收入")


@query("monthly_wide")
def monthly_wide(spark, sf):
    raw = rebuild.kept(spark, sf).withColumn("sheet_name", F.concat("sheet_name", F.lit("#"), F.col("id").cast("string")))
    return r.monthly_wide(raw, ["地区生产总值", "第二产业增加值", "个人所得税"])


@query("annual_fallback")
def annual_fallback(spark, sf):
    raw = b.indicator_raw(spark, sf).filter(F.col("period").rlike(r"^\d{4}年")).withColumn(
        "year", F.substring("period", 1, 4).cast("int"))
    name, xlsx = F.col("indicator_name"), F.col("source_type") == "XLSX"
    bulletin = (F.col("source_type") == "BULLETIN") & F.col("value").between(1500.0, 450000.0)
    annual = F.col("period").rlike(r"^\d{4}年$")
    return r.annual_fallback(raw, [
        ("XLSX first", xlsx & annual & (name == "生产总值(GDP)")),
        ("XLSX second", xlsx & annual & (name == "地区生产总值（GDP）")),
        ("BULLETIN", bulletin & (name == "地区生产总值（GDP）")),
    ])


@query("leaders_by_value")
def leaders_by_value(spark, sf):
    return r.leaders(b.indicator_long(spark, sf))


@query("leaders_by_growth")
def leaders_by_growth(spark, sf):
    return r.leaders(b.indicator_long(spark, sf), "growth_rate")


@query("often_in_top")
def often_in_top(spark, sf):
    return r.often_in_top(b.indicator_long(spark, sf))


@query("first_seen_with_value")
def first_seen_with_value(spark, sf):
    rows = r.prefer_value(b.indicator_raw(spark, sf), "region", "indicator_name", order=F.col("id"))
    return rows.select("region", "indicator_name", "id", "value")


@query("values_in_yi")
def values_in_yi(spark, sf):
    value, unit = r.wan_to_yi(F.floor(F.col("value")), F.coalesce("unit", F.lit("")))
    rows = b.indicator_raw(spark, sf).select(value.alias("value"), unit.alias("unit"))
    return rows.groupBy("unit").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
