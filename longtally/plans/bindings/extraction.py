"""Pages, sheets and prose to records and indicator rows."""

from pyspark.sql import functions as F

from ...functions import text
from ...operators import prose as p, sheets
from ...sources import bridge as b, landed
from ..catalog import query


@query("sheet_layouts")
def sheet_layouts(spark, sf):
    return sheets.sheet_layout(sheets.filled_cells(b.cells(spark, sf)))


@query("sheet_indicator_rows")
def sheet_indicator_rows(spark, sf):
    return sheets.indicator_rows(b.cells(spark, sf))


@query("sheet_rank_rows")
def sheet_rank_rows(spark, sf):
    rows = sheets.indicator_rows(b.cells(spark, sf)).filter(F.endswith(F.col("indicator_name"), F.lit("排名")))
    return rows.groupBy("indicator_name", "region", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("sheet_header_rows")
def sheet_header_rows(spark, sf):
    head = sheets.header_cells(sheets.filled_cells(b.cells(spark, sf)))
    return head.filter("is_header").select("doc_id", "sheet", "row", "col", "index")


@query("page_texts")
def page_texts(spark, sf):
    return landed.extract_pages(b.detail_pages(spark, sf))


@query("page_links")
def page_links(spark, sf):
    links = landed.page_links(b.list_pages(spark, sf), "page_id")
    return links.select("page_id", "item", "link", "href", "title", F.array_join("reasons", ";").alias("reasons"))


@query("list_records")
def list_records(spark, sf):
    return landed.list_records(b.list_pages(spark, sf), "page_id")


@query("simple_list_records")
def simple_list_records(spark, sf):
    return landed.simple_list_records(
        b.list_pages(spark, sf), "page_id", internal=["/shaoyang/"], external=["stats.gov.cn"])


@query("fill_publish_unit")
def fill_publish_unit(spark, sf):
    return landed.fill_publish_unit(b.page_records(spark, sf)).select("record_id", "publish_unit", "unit_source")


@query("publish_unit_sources")
def publish_unit_sources(spark, sf):
    return landed.fill_publish_unit(b.page_records(spark, sf)).groupBy("unit_source").agg(F.count(F.lit(1)).alias("n"))


@query("page_hosts")
def page_hosts(spark, sf):
    return b.table(spark, sf, "pages").groupBy(text.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("prose_indicators")
def prose_indicators(spark, sf):
    return p.extract_indicators(b.prose(spark, sf))


@query("prose_anchors")
def prose_anchors(spark, sf):
    return p.anchors(b.prose(spark, sf)).select("doc_id", "position", "window", "verb", "percent")


@query("json_payload_slices")
def json_payload_slices(spark, sf):
    noisy = F.concat(F.lit("answer: "), F.col("payload"), F.lit(" end } of"))
    steps = b.trace(spark, sf).select("step_id", text.json_slice(F.concat(F.lit("x "), F.col("payload"), F.lit(" y"))).alias("json"),
                                      text.json_slice(noisy).alias("wide"))
    return steps.select("step_id", "wide", F.get_json_object("json", "$.text").alias("text"),
                        F.get_json_object("json", "$.interpretation.text").alias("answer"))


@query("numbers_from_text")
def numbers_from_text(spark, sf):
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 6 == 0, F.lit("--")).when(key % 6 == 1, F.lit(""))
        .when(key % 6 == 2, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5")))
        .when(key % 6 == 3, F.concat(F.lit(" -"), (key % 90).cast("string"), F.lit(".25% ")))
        .when(key % 6 == 4, F.concat((key % 7).cast("string"), F.lit("，000"))).otherwise(F.lit("约三成"))
    )
    rows = b.table(spark, sf, "orders").select(raw.alias("raw"), text.to_number(raw).alias("number"))
    return rows.groupBy("raw", "number").agg(F.count(F.lit(1)).alias("n"))
