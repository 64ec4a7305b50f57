"""Scalar goldens."""

import pytest
from pyspark.sql import functions as F

from longtally.functions import periods, text


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_number_text(spark):
    got = column(spark, ["1,974.6101", "4.958%", "-6.249", "", "--", "12，000", None, "约"], text.to_number)
    assert got == [1974.6101, 4.958, -6.249, None, None, 12000.0, None, None]


def test_extraction_period(spark):
    got = column(spark, ["1-9月", "2025年", "2025年 1-9月", "9月"], lambda c: periods.extraction_label(c, F.lit(2025)))
    assert got == ["2025年1-9月", "2025年", "2025年1-9月", "2025年9月"]


def test_standard_period(spark):
    labels = ["2018年1-02月", "1-9月累计", "9月末", "2025年", "第3期"]
    got = column(spark, labels, lambda c: periods.standard_label(c, F.lit(2025)))
    assert got == ["2018年1-2月", "2025年1-9月", "2025年1-9月", None, None]
    assert column(spark, ["2025年"], lambda c: periods.standard_label(c, F.lit(2020), True)) == ["2025年"]


def test_header_unit(spark):
    assert column(spark, ["绝对额(亿元)", "增速(%)", "指标", "额(abc)"], text.paren_unit) == ["亿元", "%", "", ""]


def test_normalised_names(spark):
    names = ["1、地方一般公共预算收入", "（1)税收收入", "#个人所得税", "2.规模以下工业总产值", " 进 出口总额。"]
    want = ["地方一般公共预算收入", "税收收入", "个人所得税", "规模以下工业总产值", "进出口总额"]
    assert column(spark, names, text.normalise_name) == want


@pytest.mark.parametrize(
    "phrase, want",
    [
        ("近3年社会消费品零售总额", "近3年"), ("最近30天", "近30天"), ("过去3个月销量", "近3月"), ("近五年趋势", "近5年"),
        ("2024年GDP趋势", "2024年"), ("9月末各项存款余额", None), ("近十二个月", "近12月"), ("二十天", "近20天"), ("没有范围", None),
    ],
)
def test_time_range(spark, phrase, want):
    assert column(spark, [phrase], periods.time_range) == [want]


def test_axis_keys(spark):
    labels = ["2018年1-03月", "2024年1-9月累计", "2018年", "1-6月累计", "3月末", "2023年11月-2024年2月", "其它"]
    got = column(spark, labels, periods.axis_label)
    assert got == ["2018年1月-3月", "2024年1月-9月累计", "2018年", "1月-6月累计", "3月末", "2023年11月-2024年2月", "其它"]
    keys = column(spark, labels, lambda c: periods.axis_key(c)["key"])
    assert keys[:6] == [201803, 202409, 201812, 6, 3, 202402]
    assert column(spark, labels, periods.granularity) == [3, 9, 12, 6, None, None, None]


def test_hosts_and_urls(spark):
    assert column(spark, ["https://WWW.Gov.cn:80/a?b", "nothing"], text.host_of) == ["www.gov.cn:80", ""]
    join = lambda c: text.absolute_url(F.lit("https://h.org/a/b.html?x=1"), c)
    assert column(spark, ["/r/1", "2.html", "http://o.org/3"], join) == ["https://h.org/r/1", "https://h.org/a/2.html", "http://o.org/3"]


def test_small_text_helpers(spark):
    assert column(spark, [" a \n b  c "], text.squash) == ["a b c"]
    assert column(spark, ["x" * 61, "y"], text.ellipsis) == ["x" * 60 + "…", "y"]
    assert column(spark, ["a, b,,a ，c"], text.csv_list) == [["a", "b", "c"]]
    assert column(spark, ["发布 2023年5月6日", "none", "2023-13-40"], lambda c: text.find_date(c).cast("string")) == ["2023-05-06", None, None]
    assert column(spark, ["noise {\"a\": 1} tail", "none"], text.json_slice) == ['{"a": 1}', None]
    assert column(spark, ["一、地区生产总值（GDP）", "（三）工业："], text.clean_title_numbering) == ["地区生产总值（GDP）", "工业"]
    assert column(spark, [3.0, 2.5], text.plain_number, "double") == ["3", "2.5"]


PLANS = [
    ("存贷款余额走势", "各项存款|各项贷款", "期间|指标", "line", None),
    ("外商直接投资排名", "外商直接投资", "区县", "bar", None),
    ("最新的一般公共预算收入是多少", "一般公共预算收入", "指标", "bar", "最新期间"),
    ("各县经济情况", "地区生产总值", "期间|区县", "line", None),
    ("第二产业变化", "第二产业", "期间|产业", "line", None),
    ("外贸情况", "进出口|出口|进口|外商直接投资", "期间|指标", "line", None),
    ("各区县税收占比趋势", "税收收入", "期间|区县", "line", "最新期间"),
    ("一般公共预算收入中税收和非税收入的占比", "税收收入|非税收入", "指标", "pie", "最新期间"),
    ("三次产业占比变化", "第一产业|第二产业|第三产业", "期间|产业", "line", "最新期间"),
    ("城镇和乡村零售额", "城镇零售额|城区零售额|乡村零售额", "期间|指标", "line", None),
    ("经济怎么样", "第一产业|第二产业|第三产业", "期间|指标", "line", None),
]


def test_plans_of_questions(spark):
    from longtally.operators.questions import question_plans

    df = spark.createDataFrame([(p[0],) for p in PLANS], "question string")
    got = {r["question"]: (r["metrics"], r["dimensions"], r["chart"], r["period"]) for r in question_plans(df).collect()}
    assert got == {p[0]: p[1:] for p in PLANS}


def test_blanks_and_numbers_as_sheets_have_them(spark):
    from pyspark.sql import functions as F

    from longtally.functions import text

    df = spark.createDataFrame([("项\u3000目", "\u00a0 a\u3000\u3000b\n", "12d", "1,234.5%")], "a string, b string, c string, d string")
    row = df.select(
        text.no_space(F.col("a")), text.squash(F.col("b")), text.trim_blanks(F.col("b")), text.to_number(F.col("c")), text.to_number(F.col("d"))
    ).first()
    assert tuple(row) == ("项目", "a b", "a\u3000\u3000b", None, 1234.5)
