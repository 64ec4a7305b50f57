"""Inputs of the library derived from the given tables.

Every operator takes DataFrames; this module builds those DataFrames from the
star-schema, event, page, document and conversation tables, so that the work of
each query grows with them. Dirty names, units and labels come from key
arithmetic, never from random numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import lexicon as lx
from ..functions import periods
from .workspace import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """Element of a literal list by a zero-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


# --- demo facts -----------------------------------------------------------------

def order_facts_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey"),
        F.to_date("o_orderdate").alias("order_date"),
        F.lit(1).cast("long").alias("order_count"),
        money("o_totalprice").alias("sales_amount"),
    )


def order_facts(spark: SparkSession, sf_dir: str, dimensions: bool = True) -> DataFrame:
    """One row per order: date, count, amount and, on request, region and channel."""
    orders = order_facts_source(spark, sf_dir)
    if not dimensions:
        return orders.drop("o_custkey")
    return orders.join(customer_dims(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        "order_date", "region", "channel", "order_count", "sales_amount"
    )


def order_facts_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals with region and channel, added up per customer before the join.

    The aggregate leaves the rows placed by customer, so the join adds no shuffle
    on this side and reads one row per customer instead of one per order.
    """
    orders = order_facts_source(spark, sf_dir).groupBy("o_custkey").agg(
        F.sum("order_count").alias("order_count"), F.sum("sales_amount").alias("sales_amount")
    )
    return orders.join(customer_dims(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select(
        "region", "channel", "order_count", "sales_amount"
    )


def customer_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> region name, nation name and channel."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("channel"),
    )


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with its sales, line items added up before the join."""
    sales = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum(F.col("l_quantity").cast("long")).alias("sales_volume"),
            F.sum(money("l_extendedprice")).alias("sales_amount"),
        )
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return part.join(sales, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), "sales_volume", "sales_amount"
    )


def user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as a cohort table: register date, age group, city and counts."""
    key = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 90).cast("int")).alias("register_date"),
            pick(["18-25", "26-35", "36-45", "46-60"], key).alias("age_group"),
            F.col("n_name").alias("city"),
            F.lit(1).cast("long").alias("new_user_count"),
            F.when(F.col("c_acctbal") > 0, 1).otherwise(0).cast("long").alias("active_user_count"),
            (key % 61).cast("decimal(5,2)").alias("retention_rate"),
        )
    )


# --- clean long table -------------------------------------------------------------

# measure name -> (indicator, unit, sheet); the order fixes nothing, names are unique
LONG_MEASURES = [
    ("gdp", "地区生产总值", "万元", "核算5"),
    ("sector1", "第一产业增加值", "万元", "核算5"),
    ("sector2", "第二产业增加值", "万元", "核算5"),
    ("sector3", "第三产业增加值", "万元", "核算5"),
    ("income_all", "全体居民人均可支配收入", "元", "全体收入49"),
    ("income_urban", "城镇居民人均可支配收入", "元", "城镇收入50"),
    ("income_rural", "农村居民人均可支配收入", "元", "农村收入51"),
    ("orders_road", "公路(万人)", "万人", "交邮10"),
    ("orders_water", "水运(万人)", "万人", "交邮10"),
    ("orders_all", "客运量(万人)", "万人", "交邮10"),
    ("machinery", "规模工业增加值", "", "工业7"),
]
RANKED = ["地区生产总值", "第一产业增加值"]
GROWTH_ONLY = "规模工业增加值"
DERIVED_FROM_YEAR = 2001


def monthly_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, month, nation -> additive measures; the only pass over the orders."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        money("o_totalprice").alias("amount"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    segment = F.col("c_mktsegment")

    def amount(*segments):
        return F.sum(F.when(segment.isin(*segments), F.col("amount")))

    def count(*segments):
        return F.count(F.when(segment.isin(*segments), F.lit(1)))

    by_nation = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("year", "month", "c_nationkey")
        .agg(
            F.sum("amount").alias("gdp"),
            amount("AUTOMOBILE").alias("sector1"),
            amount("BUILDING", "MACHINERY").alias("sector2"),
            amount("FURNITURE", "HOUSEHOLD").alias("sector3"),
            amount("BUILDING", "HOUSEHOLD").alias("urban"),
            amount("AUTOMOBILE", "FURNITURE", "MACHINERY").alias("rural"),
            amount("MACHINERY").alias("machinery"),
            F.count(F.lit(1)).alias("n_all"),
            count("BUILDING", "HOUSEHOLD").alias("n_urban"),
            count("AUTOMOBILE", "FURNITURE", "MACHINERY").alias("n_rural"),
            count("AUTOMOBILE", "BUILDING").alias("n_road"),
            count("FURNITURE", "HOUSEHOLD", "MACHINERY").alias("n_water"),
        )
    )
    return by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def indicator_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean long table, built once per application and then read."""
    return written(spark, "indicator_long", sf_dir, lambda: build_indicator_long(spark, sf_dir))


def build_indicator_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cumulative period, region and indicator, in one pass over the orders.

    Months are rolled forward to every later month of their year (a year-to-date
    sum without a running window), then each measure becomes a row. After the
    first aggregate the data is bounded by calendar x regions x indicators.
    """
    monthly = monthly_facts(spark, sf_dir)
    to_date = (
        monthly.withColumn("region", F.explode(F.array(F.col("n_name"), F.lit(lx.TOTAL_REGION))))
        .withColumn("end", F.explode(F.sequence(F.col("month"), F.lit(12))))
        .groupBy("year", "end", "region")
        .agg(F.max("month").alias("last_month"), *[
            F.sum(c).alias(c)
            for c in ("gdp", "sector1", "sector2", "sector3", "urban", "rural", "machinery",
                      "n_all", "n_urban", "n_rural", "n_road", "n_water")
        ])
    )
    published = F.max("last_month").over(Window.partitionBy("year", "end")) == F.col("end")
    to_date = to_date.withColumn("published", published).filter("published")
    double = lambda c: F.col(c).cast("double")
    measures = {
        "gdp": double("gdp"), "sector1": double("sector1"), "sector2": double("sector2"),
        "sector3": double("sector3"), "machinery": double("machinery"),
        "income_all": double("gdp") / double("n_all"),
        "income_urban": double("urban") / F.nullif(double("n_urban"), F.lit(0.0)),
        "income_rural": double("rural") / F.nullif(double("n_rural"), F.lit(0.0)),
        "orders_road": double("n_road"), "orders_water": double("n_water"),
        "orders_all": F.when(F.col("year") < DERIVED_FROM_YEAR, double("n_all")),
    }
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("indicator_name"), measures[key].alias("value"),
            F.lit(unit).alias("unit"), F.lit(sheet).alias("sheet_name"),
        )
        for key, name, unit, sheet in LONG_MEASURES
    ])
    start = F.lit(1)
    tall = (
        to_date.select("year", start.alias("start"), "end", "region", F.inline(rows))
        .filter(F.col("value").isNotNull())
    )
    series = Window.partitionBy("region", "indicator_name", "end").orderBy("year")
    previous = F.when(F.lag("year").over(series) == F.col("year") - 1, F.lag("value").over(series))
    tall = tall.withColumn("growth_rate", periods.growth_percent(F.col("value"), previous))

    within = Window.partitionBy("year", "end", "indicator_name", F.col("region") == lx.TOTAL_REGION)
    rank = F.row_number().over(within.orderBy(F.col("value").desc(), F.col("region")))
    ranked = F.col("indicator_name").isin(RANKED) & (F.col("region") != lx.TOTAL_REGION)
    growth_only = F.col("indicator_name") == GROWTH_ONLY
    own = F.struct(
        F.col("indicator_name"),
        F.when(~growth_only, F.col("value")).alias("value"), F.col("unit"), F.col("growth_rate"),
    )
    rank_row = F.struct(
        F.concat("indicator_name", F.lit(lx.RANK_SUFFIX)).alias("indicator_name"),
        F.col("position").cast("double").alias("value"), F.lit("名").alias("unit"),
        F.lit(None).cast("double").alias("growth_rate"),
    )
    return (
        tall.withColumn("position", rank)
        .select(
            "year", "start", "end", periods.label(F.col("year"), F.col("start"), F.col("end")).alias("period"),
            "region", "sheet_name",
            F.inline(F.when(ranked, F.array(own, rank_row)).otherwise(F.array(own))),
        )
        .select(
            "year", "start", "end", "period", "region", "indicator_name", "value", "unit",
            "growth_rate", "sheet_name",
        )
    )


# --- raw long table ----------------------------------------------------------------

RAW_NAMES = [
    "地区生产总值", "地区生产总值（GDP）", "分县（市、区）GDP", "生产总值(GDP)", "全市生产总值",
    "1、地方一般公共预算收入", "一般公共预算收入", "财政收入", "其中:出口", "进出口总额",
    "进出口总额（万美元）", "出口", "分县（市、区）进出口总额", "固定资产投资", "固定资产投资（不含跨区项目）",
    "社会消费品零售总额(亿元)", "社零", "#个人所得税", "（1)税收收入", "全市用电总量(万千瓦小时)投资",
    "全市用电总量(亿千瓦小时)", "实际利用境外资金", "外商直接投资", "第一产业", "第二产业增加值",
    "规模工业增加值排名", "地区生产总值排名", "规模工业利润总额", "营业收入", "增加值",
    "双清区", "长沙市", "大湘西地区", "邵东县", "完成固定资产投资", "同比增长情况分别列示",
    "饮料类", "采矿业", "全社会客运量(万人)", "保险收入(万元)", "各项存款",
]
RAW_REGIONS = [
    "全市", "全市", "双清", "大祥区", "北塔", "新 邵", "邵阳县", "隆回", "洞口", "绥宁县",
    "新宁", "城步", "城步苗族自治县", "武冈", "邵东", "邵东市",
]
RAW_UNITS = ["亿元", "万元", "", "万元", "亿元", "", "%"]
RAW_SHEETS = ["核算5", "财政19", "贸易13", "投资11", "52综研室1", "分市州GDP", "外贸和房地产15", "工业7", "分县表"]


def indicator_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source documents: one per customer, with date and title."""
    key = F.col("c_custkey")
    date = F.date_add(F.lit("1995-03-01").cast("date"), (key * 7 % 2300).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("doc_id"),
        date.alias("doc_date"),
        F.concat(F.year(date).cast("string"), F.lit("年"), F.month(date).cast("string"), F.lit("月月报卡")).alias("doc_title"),
    )


def _div(key: Column, n: int) -> Column:
    return F.floor(key / n).cast("long")


def indicator_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw long table: one row per order with dirty names, labels, regions and units."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    year = F.year("o_orderdate").cast("string")
    quarter_end = (F.quarter("o_orderdate") * 3).cast("string")
    form = _div(key, 11) % 10
    period = (
        F.when(form == 0, F.concat(quarter_end, F.lit("月末")))
        .when(form == 1, F.concat(F.lit("1-"), quarter_end, F.lit("月累计")))
        .when(form == 2, F.concat(year, F.lit("年")))
        .when(form == 3, F.concat(year, F.lit("年1-"), F.lpad(quarter_end, 2, "0"), F.lit("月")))
        .when(form == 4, F.concat(F.lit("第"), quarter_end, F.lit("期")))
        .otherwise(F.concat(year, F.lit("年1-"), quarter_end, F.lit("月")))
    )
    name = pick(RAW_NAMES, key)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        cust.alias("doc_id"),
        period.alias("period"),
        pick(RAW_REGIONS, _div(key, 3)).alias("region"),
        F.regexp_replace(name, r"\s+", "").alias("indicator_code"),
        name.alias("indicator_name"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("value"),
        F.when(_div(key, 5) % 13 != 0, pick(RAW_UNITS, _div(key, 5))).alias("unit"),
        F.when(key % 7 != 0, ((key * 37) % 401 - 200) / F.lit(10.0)).alias("growth_rate"),
        pick(RAW_SHEETS, cust * 5 + _div(key, 7) % 3).alias("sheet_name"),
        pick(["XLSX", "XLSX", "XLSX", "BULLETIN", "ANALYSIS"], cust).alias("source_type"),
        pick(["high", "medium", "low"], key).alias("confidence"),
    )


def renamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows in which old and new names of a series repeat each other's values."""
    key = F.col("o_orderkey")
    names = [
        "实际利用境外资金", "外商直接投资", "全市用电总量(万千瓦小时)投资", "全市用电总量(亿千瓦小时)",
        "全社会客运量(万人)", "客运量(万人)", "保险收入", "地区生产总值(GDP)", "生产总值(GDP)",
    ]
    value = F.floor(F.col("o_totalprice") / 60000).cast("double") * 7000
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("年1-"), (F.quarter("o_orderdate") * 3).cast("string"), F.lit("月")).alias("period"),
        pick(RAW_REGIONS[1:9], _div(key, 7)).alias("region"),
        pick(names, key).alias("indicator_name"), pick(names, key).alias("indicator_code"),
        F.when(key % 11 != 0, value).alias("value"),
        F.when(key % 4 != 0, (key % 3).cast("double")).alias("growth_rate"),
        F.lit("").alias("unit"),
    )


def region_in_name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows whose indicator is a region with a sheet marker."""
    marks = ["(45贸外处4)", "(46贸外处5)", "(99其它)"]
    key = F.col("id")
    name = F.concat(pick(RAW_REGIONS[6:10], key), pick(marks, _div(key, 4)))
    changed = F.when(key % 3 == 0, name).otherwise(F.col("indicator_name"))
    return indicator_raw(spark, sf_dir).withColumn("indicator_name", changed)


# --- records, pages and texts --------------------------------------------------------

RECORD_CATEGORIES = ["统计信息", "财政信息", "政策文件", "通知公告", "规划计划", "其它栏目"]
PAGE_PUBLISHERS = ["邵阳市统计局", "邵阳市财政局", "邵阳市司法局"]
PAGE_HOSTS = ["www.stats.gov.cn", "tjj.hunan.gov.cn", "www.gov.cn"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication records from the documents table."""
    key = F.col("doc_id")
    date = F.date_add(F.lit("2019-01-01").cast("date"), (key * 13 % 2500).cast("int"))
    return table(spark, sf_dir, "documents").select(
        key.alias("record_id"),
        F.col("text").alias("title"),
        F.when(key % 3 != 0, F.col("source")).otherwise(F.lit("")).alias("publish_unit"),
        pick(RECORD_CATEGORIES, key + F.length("lang")).alias("category"),
        F.when(key % 31 != 0, date).alias("publish_date"),
        F.concat(F.lit("https://records.example.org/"), F.col("lang"), F.lit("/"), _div(key, 2).cast("string")).alias("source_url"),
    )


STATISTICS = ["统计月报", "统计公报", "统计分析"]


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication records of the three statistical categories, one for each document."""
    return table(spark, sf_dir, "documents").select("doc_id", pick(STATISTICS, F.col("doc_id") + F.length("lang")).alias("category"))


def status_entries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Log entries of four runs over the records: fetches, of which some fail, again or for good, entries that come
    late or twice, and the reading of sheets and texts."""
    key = F.col("doc_id")
    report = F.col("category") == STATISTICS[0]
    rows = statistics(spark, sf_dir)
    at = lambda hours: F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(hours * 3600) + key)
    entry = lambda keep, stage, state, hours, attempt: rows.where(keep).select(
        "doc_id", (F.lit(stage) if isinstance(stage, int) else stage).alias("stage"), state.alias("status"), at(hours).alias("at"), F.lit(attempt).alias("attempt")
    )
    fetched = F.when(~report | (key % 4 != 0), "DONE").otherwise("TEXT_DONE")
    read = F.when(~report, "TEXT_DONE").when(key % 11 == 0, "XLSX_FAIL").otherwise("XLSX_DONE")
    first = entry(key % 13 != 0, 1, F.when(key % 5 == 0, "FAILED").otherwise(fetched), 0, 1)
    again = entry(key % 10 == 0, 1, F.when(key % 3 == 0, "FAILED").otherwise(fetched), 5, 2)
    late = entry(key % 7 == 0, 1, F.lit("FAILED"), 6, 1)
    return [first, again.union(late), again, entry(key % 4 == 1, F.when(report, 2).otherwise(3), read, 9, 1)]


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages as records whose publishing unit is often missing."""
    key = F.col("page_id")
    label = F.concat(F.lit("<p>发布单位："), pick(PAGE_PUBLISHERS, key), F.lit("</p>"))
    meta = F.concat(F.lit('<meta name="publishunit" content="'), pick(PAGE_PUBLISHERS, key + 1), F.lit('">'))
    extra = F.when(key % 5 == 0, label).when(key % 5 == 1, meta).otherwise(F.lit(""))
    known = F.concat(F.lit("https://"), pick(PAGE_HOSTS, _div(key, 6)), F.lit("/t"), key.cast("string"))
    return table(spark, sf_dir, "pages").select(
        key.alias("record_id"),
        F.when(key % 6 == 0, known).otherwise(F.col("url")).alias("source_url"),
        pick(RECORD_CATEGORIES, key).alias("category"),
        F.when(key % 4 == 0, pick(PAGE_PUBLISHERS, key + 2)).otherwise(F.lit("")).alias("publish_unit"),
        F.concat(extra, F.col("html")).alias("html"),
    )


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages in the three container forms of a detail page, some with a workbook link."""
    key = F.col("page_id")
    link = F.when(key % 2 == 0, F.concat(F.lit('<a href="files/'), key.cast("string"), F.lit('.xlsx">附件</a>'))).otherwise(F.lit(""))
    noise = F.lit("<p>版权所有 主办单位</p><p>\u3000\u3000GDP\u00a0<span>2883</span><span>.5</span>亿元</p><br/>")
    body = F.concat(link, noise, F.col("html"))
    page = (
        F.when(key % 3 == 0, F.concat(F.lit("<html><p>before</p><UCAPCONTENT>"), body, F.lit("</UCAPCONTENT><p>after</p></html>")))
        .when(key % 3 == 1, F.concat(F.lit('<html><div class="wenz"><p>'), noise, F.lit("</p></div> </div><p>after</p>"), F.col("html")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "pages").select("page_id", page.alias("html"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages with a list box whose items carry dates, units and document numbers."""
    key = F.col("page_id").cast("string")
    month = (F.col("page_id") % 9 + 1).cast("string")
    items = F.concat(
        F.lit('<ul class="box infoList"><li class="item"><a href="/shaoyang/tjyb/20230'), month, F.lit("/"), key,
        F.lit('.shtml">统计月报发布第'), key, F.lit('期</a><a href="/x">更多</a> 发布日期 2023-0'), month, F.lit("-1"), month,
        F.lit(" 发文单位：邵阳市统计局 公开类别：统计信息 邵政办发〔2023〕"), key, F.lit("号</li>"),
        F.lit('<li class="nav"><a href="http://www.stats.gov.cn/sj/t20240'), month, F.lit("15_"), key,
        F.lit('.html">国家统计数据解读 '), key, F.lit("</a></li>"),
        F.lit('<tr id="row"><td><a href="javascript:void(0)">无效链接文字</a></td><td><a href="#top">锚点链接</a></td></tr>'),
        F.lit('<li><a href="detail/'), key, F.lit('.html">关于&nbsp;工作'), key, F.lit("的通知</a></li></ul>"),
        F.lit('<!-- <li><a href="/c.html">注释里的链接标题</a></li> --></em><div class="side nav"><ul><li><a href="/site/'), key,
        F.lit(""".html">机构设置与职能介绍</a></li></ul></div><div id='main'><br/><ol><li class=outer><a title="a > b" href='/zc/"""), key,
        F.lit(".html'>外层条目标题文字"), key, F.lit("</a><p>说明<ul><li><a href=/zc/in"), key, F.lit(".html>内层条目的标题"), key,
        F.lit('</a></li><li><a href="/zc/b'), key, F.lit('.html?x=1&amp;y=2">未<b>闭合</b>条目的标题<img src=x></a></ul> 2024-03-0'), month,
        F.lit("</li></ol></div>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.col("html"), items).alias("html"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts with statistical sentences appended to each whole text."""
    key = F.col("doc_id")
    n = lambda m, d: ((key * m % 9000 + 100) / F.lit(d)).cast("string")
    g = lambda m: ((key * m % 150) / F.lit(10.0)).cast("string")
    gdp = F.concat(F.lit("全市实现地区生产总值"), n(31, 8.0), F.lit("亿元、增长"), g(7), F.lit("%。"))
    second = F.concat(F.lit("其中，第二产业完成增加值"), n(17, 4.0), F.lit("亿元、下降"), g(11), F.lit("%；"))
    retail = F.concat(F.lit("社会消费品零售总额达到"), n(13, 16.0), F.lit("亿元，同比增长了 "), g(3), F.lit(" %。"))
    other = F.concat(F.lit("粮食播种面积"), n(5, 2.0), F.lit("万亩，增长"), g(9), F.lit("%。"))
    tail = (
        F.when(key % 4 == 0, F.concat(gdp, second, retail))
        .when(key % 4 == 1, F.concat(retail, other, gdp))
        .when(key % 4 == 2, F.concat(second, F.lit("\n"), other))
        .otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "documents").select(
        key.alias("doc_id"),
        F.concat(F.col("text"), F.lit("\n"), tail).alias("text"),
        F.when(key % 2 == 0, F.lit("BULLETIN")).otherwise(F.lit("ANALYSIS")).alias("source_type"),
        F.concat((F.lit(2018) + key % 7).cast("string"), F.lit("年1-9月")).alias("period"),
    )


TITLE_WORDS = ["邵阳市经济运行情况", "居民收入稳步增长", "统计公报", "财政收支平稳", "规模工业增加值"]


def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with Chinese titles made of fixed phrases, for topic words."""
    key = F.col("record_id")
    title = F.concat(pick(TITLE_WORDS, key), F.lit(" "), pick(TITLE_WORDS, _div(key, 3)), F.lit("2024年"))
    return records(spark, sf_dir).withColumn("title", title)


# --- sheet cells ----------------------------------------------------------------------

CELL_TITLES = ["一、地区生产总值", "主要经济指标", "规模工业大类行业", "财政对比表", "目录"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet grids, one sheet per document: header cells by layout, one data row per order."""
    docs = indicator_docs(spark, sf_dir)
    layout = F.col("doc_id") % 5
    month = F.concat(F.lit("1-"), F.month("doc_date").cast("string"), F.lit("月"))
    sheet = pick(["分县GDP", "主要指标", "工业8", "对比表", "目录1"], F.col("doc_id"))

    def cell(row, col, text):
        return F.struct(F.lit(row).cast("long").alias("row"), F.lit(col).alias("col"), text.alias("text"))

    lit = F.lit
    title = cell(0, 0, pick(CELL_TITLES, F.col("doc_id")))
    heads = (
        F.when(layout == 0, F.array(
            title, cell(2, 0, lit("地  区")), cell(2, 1, month), cell(3, 1, lit("绝对额(万元)")),
            cell(3, 2, lit("增速(%)")), cell(3, 3, lit("排名"))))
        .when(layout == 1, F.array(
            title, cell(1, 2, lit("单位：亿元")), cell(2, 0, lit("项\u3000目")), cell(2, 1, lit("本月")),
            cell(2, 2, lit("本年累计")), cell(2, 3, lit("增长（%）"))))
        .when(layout == 2, F.array(title, cell(2, 0, lit("行  业")), cell(2, 1, month), cell(3, 1, lit("增速（%）"))))
        .when(layout == 3, F.array(title, cell(2, 0, lit("年份")), cell(2, 1, lit("总额"))))
        .otherwise(F.array(title, cell(2, 0, lit("项目")), cell(2, 1, lit("总额"))))
    )
    head = docs.select("doc_id", "doc_title", "doc_date", sheet.alias("sheet"), F.inline(heads))

    key = F.col("o_orderkey")
    line = F.struct(
        key.alias("k"), F.col("o_totalprice").alias("v"),
        (((key * 37) % 401 - 200) / lit(10.0)).alias("g"), ((key % 12) + 1).alias("r"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), line.alias("line"))
    row = F.col("line.k") + 10
    v = F.when(F.col("line.k") % 9 == 0, lit("--")).otherwise(F.col("line.v").cast("string"))
    g = F.concat(F.col("line.g").cast("string"), lit("%"))
    region_name = pick(["全市", "双清", "大\u3000祥", "\u00a0新宁", "邵东", "城步", "隆回县"], F.col("line.k"))
    item_name = pick(["（一）一般公共预算收入", "二、税收收入", "社会消费品零售总额", "进出口总额："], F.col("line.k"))
    industry = pick(["煤炭开采和洗选业", "纺织业", "食品制造业"], F.col("line.k"))

    def data(col, text):
        return F.struct(row.alias("row"), F.lit(col).alias("col"), text.alias("text"))

    body = (
        F.when(layout == 0, F.array(data(0, region_name), data(1, v), data(2, g), data(3, F.col("line.r").cast("string"))))
        .when(layout == 1, F.array(data(0, item_name), data(1, lit("7")), data(2, v), data(3, g)))
        .when(layout == 2, F.array(data(0, industry), data(1, g)))
        .otherwise(F.array(data(0, lit("合计")), data(1, v)))
    )
    rows = docs.join(orders, "doc_id").select("doc_id", "doc_title", "doc_date", sheet.alias("sheet"), F.inline(body))
    return head.unionByName(rows)


# --- conversations and events ------------------------------------------------------------

QUESTION_PHRASES = [
    "2024年地区生产总值趋势如何", "近3年社会消费品零售总额走势", "各县区GDP排名对比", "外商直接投资排名",
    "进出口是多少", "出口交货值与出口对比", "最新的一般公共预算收入是多少", "近五年固定资产投资增速变化",
    "为什么销售额下降", "居民收入占比结构", "9月末各项存款余额", "用户画像与偏好特征", "过去3个月纺织业增长",
    "各行业固定资产投资增速", "存贷款余额走势", "规模工业大类行业增速", "城镇和乡村零售额", "住户存款结构", "外贸情况怎么样",
    "各县经济情况", "第二产业变化", "三次产业占比变化", "政府发文情况", "分行业增加值占比", "各区县税收占比趋势",
    "预算收入中税收和非税收入的构成", "各区域占比分布", "一产投资", "功能分类支出占比",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations, every whole text followed by a question."""
    key = F.col("conv_id") * 3 + F.col("turn")
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(
            "conv_id", "turn",
            F.concat(F.col("text"), F.lit("\n"), pick(QUESTION_PHRASES, key)).alias("question"),
        )
    )


STEP_TYPES = ["QUESTION", "PLAN", "SQL", "EXECUTE", "INTERPRET"]


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysis steps: session = user, round = day of month, payload = JSON."""
    kind = (
        F.when(F.col("event_type") == "signup", "QUESTION")
        .when(F.col("event_type") == "click", "PLAN")
        .when(F.col("event_type") == "view", "SQL")
        .when(F.col("event_type") == "purchase", "EXECUTE")
        .otherwise("INTERPRET")
    )
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step_id"),
        F.col("user_id").alias("session_id"),
        F.dayofmonth("ts").alias("round_no"),
        kind.alias("step_type"),
        F.concat(F.lit('{"text":"question '), k.cast("string"), F.lit('","interpretation":{"text":"answer '),
                 (k % 7).cast("string"), F.lit('"}}')).alias("payload"),
        F.when(k % 17 == 0, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def chart_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with plans and results as payloads: rows of unlike fields, some results without columns, some cut off."""
    k = F.get_json_object("props", "$.k").cast("long")
    props = table(spark, sf_dir, "events").select(F.col("event_id").alias("step_id"), k.alias("k"), "value")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    plan = F.when(F.col("k") % 5 == 0, text('{"targetTable":"t', F.col("k") % 3, '"}')).otherwise(
        text('{"chartType":"', F.when(F.col("k") % 2 == 0, "line").otherwise("bar"), '","targetTable":"t', F.col("k") % 3, '","metrics":["产值","增速"]}'))
    result = (
        F.when(F.col("k") % 7 == 0, F.lit('{"rows":[{"a":1}]}')).when(F.col("k") % 11 == 0, F.lit('{"columns":["a"]}'))
        .when(F.col("k") % 13 == 0, F.lit('{"columns":["a"],"rows":['))
        .otherwise(text('{"columns":["region","n"],"rows":[{"region":"r', F.col("k") % 4, '","n":', F.col("k"), '},{"region":"全市","share":',
                        F.round(F.col("k") / 8, 3), ',"note":null},{"n":"', F.col("k"), '"}]}'))
    )
    steps = trace(spark, sf_dir).drop("payload").join(props.drop("value"), "step_id")
    return steps.withColumn("payload", F.when(F.col("step_type") == "PLAN", plan).when(F.col("step_type") == "EXECUTE", result)).drop("k")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with their whole text; every third is asked again at once with other blanks, for round collapsing."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") * 2).alias("seq"), F.col("text").alias("question")
    )
    again = turns.filter((F.col("session_id") + F.col("seq") / 2) % 3 == 0).select(
        "session_id", (F.col("seq") + 1).alias("seq"), F.concat(F.lit("  "), F.replace("question", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("question")
    )
    return turns.unionByName(again)


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate values in groups, from the line items."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cents = (F.col("l_quantity").cast("long") * 1000 + key % 3 * 4 + F.col("l_partkey") % 40 * 100).cast("decimal(20,4)") / 1000
    return table(spark, sf_dir, "lineitem").select(
        (key * 1000003 + F.col("l_partkey")).alias("id"),
        F.year("l_shipdate").cast("string").alias("period"),
        F.col("l_returnflag").alias("region"),
        (F.col("l_suppkey") % 20).cast("string").alias("indicator_name"),
        F.lit("元").alias("unit"),
        cents.cast("decimal(20,4)").alias("value"),
    )
