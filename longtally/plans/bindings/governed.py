"""Governance, merge and audit of the raw long table."""

from pyspark.sql import functions as F

from ... import lexicon as lx
from ...functions import periods, text
from ...operators import governance as gov, merge
from ...sources import bridge as b
from .. import rebuild
from ..catalog import query


@query("standard_period_labels")
def standard_period_labels(spark, sf):
    raw = b.indicator_raw(spark, sf).join(b.indicator_docs(spark, sf), "doc_id")
    label = periods.standard_label(F.col("period"), F.year("doc_date"), accept_year_only=True)
    return raw.groupBy("period", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("parsed_periods")
def parsed_periods(spark, sf):
    p = periods.parse(F.col("period"), F.lit(1990))
    raw = b.indicator_raw(spark, sf).select("period").distinct()
    return raw.select("period", p.alias("p")).select("period", "p.year", "p.start", "p.end", "p.kind")


@query("rows_with_documents")
def rows_with_documents(spark, sf):
    raw = b.indicator_raw(spark, sf).join(b.indicator_docs(spark, sf), "doc_id")
    return raw.groupBy(F.year("doc_date").alias("doc_year")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("normalise_region")
def normalise_region(spark, sf):
    return gov.normalise_region(b.indicator_raw(spark, sf)).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("remap_audit")
def remap_audit(spark, sf):
    return gov.remap_audit(b.indicator_raw(spark, sf))


@query("remap_status_totals")
def remap_status_totals(spark, sf):
    return gov.remap_audit(b.indicator_raw(spark, sf)).groupBy("status").agg(
        F.count(F.lit(1)).alias("names"), F.sum("rows").alias("rows"))


@query("alias_dictionary")
def alias_dictionary(spark, sf):
    return gov.alias_dictionary(gov.remap_audit(b.indicator_raw(spark, sf)))


@query("canonical_indicators")
def canonical_indicators(spark, sf):
    rows = gov.canonicalise_indicator(b.indicator_raw(spark, sf), "indicator_name")
    return rows.groupBy("indicator_name", "canonical", "status").agg(F.count(F.lit(1)).alias("n"))


@query("merged_name_counts")
def merged_name_counts(spark, sf):
    raw = b.indicator_raw(spark, sf).select("indicator_name")
    long = b.indicator_long(spark, sf).select("indicator_name")
    parts = [d.groupBy("indicator_name").agg(F.count(F.lit(1)).alias("n")) for d in (raw, long)]
    return parts[0].unionByName(parts[1]).groupBy("indicator_name").agg(F.sum("n").alias("n"))


@query("usd_documents")
def usd_documents(spark, sf):
    return gov.usd_documents(b.indicator_raw(spark, sf))


@query("sheet_major")
def sheet_major(spark, sf):
    return gov.sheet_major(b.indicator_raw(spark, sf))


@query("standardised_rows")
def standardised_rows(spark, sf):
    return rebuild.kept(spark, sf).select(
        "id", "period", "region", "indicator_name", "value", "unit", "growth_rate")


@query("dropped_rows")
def dropped_rows(spark, sf):
    rows = rebuild.standardised(spark, sf).filter(F.col("drop_reason").isNotNull())
    return rows.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query("note_counts")
def note_counts(spark, sf):
    notes = rebuild.kept(spark, sf).select(F.explode(F.split("note", ";")).alias("note"))
    return notes.groupBy("note").agg(F.count(F.lit(1)).alias("n"))


@query("drop_polluted")
def drop_polluted(spark, sf):
    return gov.drop_polluted(b.indicator_raw(spark, sf)).groupBy("indicator_name").agg(F.count(F.lit(1)).alias("n"))


@query("merged_clean_table")
def merged_clean_table(spark, sf):
    merged = merge.merge_with_priority(rebuild.kept(spark, sf))
    return merged.select("period", "region", "indicator_name", "value", "unit", "growth_rate", "doc_id", "merged_rows")


@query("merge_conflicts")
def merge_conflicts(spark, sf):
    return merge.find_conflicts(rebuild.kept(spark, sf)).select(
        "period", "region", "indicator_name", "id", "measure", "kept", "other", "scope")


@query("conflict_report")
def conflict_report(spark, sf):
    return merge.conflict_report(merge.find_conflicts(rebuild.kept(spark, sf)))


@query("recalibrated_rows")
def recalibrated_rows(spark, sf):
    return rebuild.recalibrated(spark, sf).filter(F.col("action") != "unchanged").select(
        "id", "indicator_name", "value", "unit", "action", "renamed_from")


@query("recalibrate_audit")
def recalibrate_audit(spark, sf):
    return rebuild.recalibrated(spark, sf).groupBy("action", "renamed_from").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_business_key")
def dedupe_business_key(spark, sf):
    rows = rebuild.kept(spark, sf)
    return merge.dedupe_business_key(rows, ["财政19", "投资11"]).select("id", "sheet_name")


@query("dedupe_exact")
def dedupe_exact(spark, sf):
    raw = b.indicator_raw(spark, sf).withColumn("value", F.floor(F.col("value") / 100000)).withColumn(
        "growth_rate", F.floor(F.col("growth_rate") / 10))
    return merge.dedupe_exact(raw).select("id")


@query("value_clusters")
def value_clusters(spark, sf):
    return merge.value_clusters(b.price_points(spark, sf)).select(
        "period", "region", "indicator_name", F.col("value").cast("double").alias("value"), "rows", "cluster")


@query("cluster_keepers")
def cluster_keepers(spark, sf):
    keep = merge.cluster_keepers(merge.value_clusters(b.price_points(spark, sf)))
    return keep.select("period", "region", "indicator_name", "cluster", "id", "rows")


@query("cluster_dropped")
def cluster_dropped(spark, sf):
    points = b.price_points(spark, sf)
    dropped = merge.dropped_by_clusters(points, merge.cluster_keepers(merge.value_clusters(points)))
    return dropped.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("already_under_new_name")
def already_under_new_name(spark, sf):
    rows = b.renamed_pairs(spark, sf)
    return merge.already_under_new_name(rows, "实际利用境外资金", "外商直接投资").select("id")


@query("same_key_pairs")
def same_key_pairs(spark, sf):
    return merge.same_key_pairs(b.renamed_pairs(spark, sf), "实际利用境外资金", "外商直接投资").select("id")


@query("rename_and_dedupe")
def rename_and_dedupe(spark, sf):
    return merge.rename_and_dedupe(b.renamed_pairs(spark, sf)).select(
        "id", "indicator_name", "indicator_code", "value", "unit")


@query("repair_region_in_name")
def repair_region_in_name(spark, sf):
    return gov.repair_region_in_name(b.region_in_name_rows(spark, sf)).groupBy("region", "indicator_name", "unit").agg(
        F.count(F.lit(1)).alias("n"))


@query("complete_units")
def complete_units(spark, sf):
    rows = gov.complete_units(rebuild.kept(spark, sf))
    return rows.groupBy("indicator_name", "unit", "unit_source").agg(F.count(F.lit(1)).alias("n"))


@query("complete_units_from_data")
def complete_units_from_data(spark, sf):
    rows = gov.complete_units_from_data(b.indicator_raw(spark, sf))
    return rows.groupBy("indicator_name", "unit", "unit_source").agg(F.count(F.lit(1)).alias("n"))


@query("derived_totals")
def derived_totals(spark, sf):
    return gov.with_derived_totals(b.indicator_long(spark, sf))


@query("unit_in_name")
def unit_in_name(spark, sf):
    name = F.col("indicator_name")
    rows = b.indicator_raw(spark, sf).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        name, text.paren_unit(name).alias("bracket"), text.unit_by_name(name).alias("rule"),
        text.clean_title_numbering(name).alias("clean"), text.normalise_name(name).alias("normal"), "n")


@query("yoy_growth")
def yoy_growth(spark, sf):
    from ...operators.reports import yoy

    return yoy(b.indicator_long(spark, sf)).filter(F.col("yoy").isNotNull()).select("period", "region", "indicator_name", "yoy")
