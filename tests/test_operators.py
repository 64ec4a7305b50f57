"""Operators against literal fixtures and brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from longtally import lexicon as lx
from longtally.operators import governance as gov, insight, merge, quality, questions, reports, select, series, trace
from longtally.operators.runs import running_groups


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_running_groups_equals_brute_force(spark, bucket):
    rng = random.Random(5)
    rows = [(k, i, rng.randrange(3)) for k, n in (("hot", 400), ("b", 9), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = running_groups(df, ["k"], [F.col("o")], F.floor(F.col("o") / bucket), lambda p: F.col("v") != p["v"])
    want, last, run = {}, {}, {}
    for k, o, v in rows:
        run[k] = run.get(k, 0) + (last.get(k) != v)
        last[k] = v
        want[(k, o)] = run[k]
    assert {(r.k, r.o): r.run for r in got.collect()} == want


def merge_brute_force(rows):
    out, conflicts = {}, 0
    groups = {}
    for r in rows:
        groups.setdefault(r[1:4], []).append(r)
    for key, items in groups.items():
        lag = lambda r: r[5] in lx.LAGGED_NAMES
        items.sort(key=lambda r: (lx.MERGE_PRIORITY.get(r[5], 9), r[4] if lag(r) else -r[4], r[0]))
        value, growth, unit = items[0][6], items[0][7], items[0][8]
        for r in items[1:]:
            value = r[6] if value is None else value
            growth = r[7] if growth is None else growth
            unit = unit or r[8]
            conflicts += value is not None and r[6] is not None and abs(value - r[6]) > 0.01
            conflicts += growth is not None and r[7] is not None and abs(growth - r[7]) > 0.01
        out[key] = (value, growth, unit or None, items[0][4])
    return out, conflicts


def test_priority_merge_equals_brute_force(spark):
    rng = random.Random(11)
    names = ["固定资产投资", "财政总收入", "分县（市、区）进出口总额", "其它"]
    rows = [
        (i, rng.choice(["p1", "p2"]), rng.choice(["r1", "r2", "r3"]), "ind", rng.randrange(30), rng.choice(names),
         rng.choice([None, 1.0, 1.005, 2.0]), rng.choice([None, 3.0, 4.0]), rng.choice([None, "", "元"]))
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, "id long, period string, region string, indicator_name string, doc_id long, source_name string, "
        "value double, growth_rate double, unit string",
    ).withColumns({c: F.lit("x") for c in ("sheet_name", "source_type", "confidence")})
    merged = merge.merge_with_priority(df)
    want, conflicts = merge_brute_force(rows)
    got = {(r.period, r.region, r.indicator_name): (r.value, r.growth_rate, r.unit, r.doc_id) for r in merged.collect()}
    assert got == want
    assert merge.merge_conflicts(df, merged).count() == conflicts
    assert merge.find_conflicts(df).count() == conflicts


def test_canonical_names(spark):
    cases = {
        "财政收入": "一般公共预算收入", "进出口总额": "进出口", "第一产业": "第一产业增加值",
        "分县（市、区）社会消费品零售总额": "社会消费品零售总额", "同比增幅达到历史新高": "", "采矿业": "采矿业", "": "",
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert {r.n: r.canonical for r in gov.canonicalise(df, "n").collect()} == cases


def test_rank_and_unit_names(spark):
    cases = {"生产总值排名": "地区生产总值排名", "社零(亿元)": "社会消费品零售总额", "煤炭业排名": "煤炭业排名"}
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert {r.n: r.canonical for r in gov.canonicalise_indicator(df, "n").collect()} == cases


def raw_frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "id long, doc_id long, period string, region string, indicator_name string, value double, unit string, growth_rate double, "
        "sheet_name string",
    ).withColumns({"source_type": F.lit("XLSX"), "confidence": F.lit("high")})


def test_standardise_rules(spark):
    docs = spark.sql("SELECT 1L AS doc_id, DATE'2025-10-01' AS doc_date UNION ALL SELECT 2L, DATE'2019-06-01'")
    raw = raw_frame(spark, [
        (1, "9月末", "全市", "城步县", 10.0, "", 3.0, "52综研室1"),
        (1, "2025年1-9月", "全市", "长沙市", 10.0, "亿元", 3.0, "分市州GDP"),
        (1, "2025年1-9月", "新 宁", "社零", 20000.0, "万元", 3.0, "贸易13"),
        (1, "2025年1-9月", "全市", "大湘西地区", 1.0, "亿元", 2.0, "表甲"),
        (1, "2025年1-9月", "全市", "地区生产总值", 5.0, "亿元", 2.0, "表甲"),
        (1, "2025年1-9月", "全市", "双清区", 5.0, "亿元", 2.0, "表乙"),
        (1, "某期", "全市", "地区生产总值", 5.0, "亿元", 2.0, "表乙"),
        (2, "2019年1-5月", "全市", "进出口总额（万美元）", 82226.0, "", 2.0, "表丙"),
        (2, "2019年1-5月", "邵东", "出口", 5.0, "亿元", 2.0, "表丙"),
        (1, "2022年1-6月", "全市", "一般公共预算收入", 5.0, "万元", 2.0, "财政19"),
        (1, "2025年1-9月", "全市", "采矿业", None, "", 2.0, "投资12"),
        (1, "2025年1-9月", "全市", "饮料类", 4.0, "", 2.0, "贸易13"),
    ])
    got = {r.id: r for r in gov.standardise(raw, docs).collect()}
    key = lambda i: (got[i].period, got[i].region, got[i].indicator_name, got[i].value, got[i].unit)
    assert key(0) == ("2025年1-9月", "城步县", "各项存款", 10.0, "亿元") and got[0].growth_rate is None
    assert key(1) == ("2025年1-9月", "长沙市", "分市州GDP", 10.0, "亿元")
    assert key(2) == ("2025年1-9月", "新宁县", "社会消费品零售总额", 2.0, "亿元")
    assert key(3) == ("2025年1-9月", "大湘西地区", "地区生产总值", 1.0, "亿元")
    assert (got[5].drop_reason, got[6].drop_reason) == ("polluted name", "period unknown")
    assert key(7)[2:] == ("进出口（万美元）", 82226.0, "万美元") and key(8)[2] == "出口（万美元）"
    assert key(9)[2] == "财政总收入"
    assert (key(10)[2], key(11)[2]) == ("采矿业投资", "饮料类零售额")


SANITY = "period string, region string, value double, growth_rate double"


@pytest.mark.parametrize(
    "rows, names",
    [
        ([("2024-01", "a", 1.0, 1.0), ("2024-02", "a", 2.0, 1.0)], set()),
        ([("2024-01", "a", 1.0, 1.0)] * 2, {"duplicates"}),
        ([("2024-01", "a", 2926.2473, 1.0), ("2024-01", "a", 29262473.0, 1.0)], {"magnitude"}),
        ([("2024-01", "a", 1.0, 1.0)] * 2 + [("2024-01", "b", 2.0, 1.0)], {"duplicates"}),
        ([(None, "a", 1.0, 1.0)], {"blank time"}),
        ([(str(i), "a", 1.0, 1.0) for i in range(2001)], {"many rows"}),
        ([("2024-01", "a", 1.0, None)], {"no growth"}),
        ([], {"empty result"}),
    ],
)
def test_sanity_check(spark, rows, names):
    got = quality.sanity_check(spark.createDataFrame(rows, SANITY))
    assert {r.check_name for r in got.collect()} == names


LONG = "period string, region string, indicator_name string, value double, unit string, growth_rate double, sheet_name string"


def long_frame(spark):
    rows = [
        ("2025年1-9月", "全市", "第一产业增加值", 303.6521, "亿元", 3.0, "s"), ("2025年1-9月", "全市", "第二产业增加值", 565.4974, "亿元", 3.0, "s"),
        ("2025年1-9月", "全市", "第三产业增加值", 1105.4606, "亿元", 3.0, "s"), ("2025年1-9月", "全市", "地区生产总值", 1974.6101, "亿元", 4.96, "s"),
        ("2024年1-9月", "全市", "地区生产总值", 1900.0, "亿元", 4.0, "s"), ("2024年1-12月", "全市", "地区生产总值", 2900.0, "亿元", 4.0, "s"),
        ("2025年1-9月", "全市", "规模工业增加值", None, "", 6.0, "s"), ("2025年1-8月", "全市", "规模工业利润总额", 106.84, "亿元", 1.0, "s"),
        ("2025年1-9月", "全市", "公路(万人)", 2088.4469, "万人", None, "s"), ("2025年1-9月", "全市", "水运(万人)", 8.1346, "万人", None, "s"),
        ("2024年1-9月", "全市", "客运量(万人)", 2554.6, "万人", None, "s"),
        ("2025年1-9月", "全市", "城镇居民人均可支配收入", 30402.30, "元", None, "s"), ("2025年1-9月", "全市", "农村居民人均可支配收入", 14314.07, "元", None, "s"),
        ("2025年1-9月", "邵东市", "地区生产总值", 165.0, "亿元", 6.4, "s"), ("2025年1-9月", "新宁县", "地区生产总值", 104.0, "亿元", 4.5, "s"),
    ]
    return select.with_period(spark.createDataFrame(rows, LONG))


def test_golden_answers(spark):
    long = long_frame(spark)
    trend = [(r.period, r.value) for r in select.cumulative_trend(long, ["地区生产总值"]).orderBy("period").collect()]
    assert trend == [("2024年1-9月", 1900.0), ("2025年1-9月", 1974.6101)]
    assert [r.value for r in select.latest_snapshot(long, ["规模工业利润总额"]).collect()] == [106.84]
    assert [(r.value, r.unit) for r in select.latest_snapshot(long, ["规模工业增加值"]).collect()] == [(6.0, "%")]
    assert [r.region for r in select.region_snapshot(long).collect()] == ["邵东市", "新宁县"]
    shares = {r.indicator_name: r.share for r in reports.structure(long, lx.SECTOR_METRICS, "地区生产总值").collect()}
    assert shares == {"第一产业增加值": 15.4, "第二产业增加值": 28.6, "第三产业增加值": 56.0}
    total = gov.with_derived_totals(long).filter("indicator_name = '客运量(万人)'").first()
    assert (round(total.value, 4), total.growth_rate) == (2096.5815, -17.93)
    assert reports.ratio(long, "城镇居民人均可支配收入", "农村居民人均可支配收入").first().ratio == 2.124
    assert select.latest_snapshot(long, ["城镇居民人均可支配收入"]).count() == 2


def test_rename_keeps_one_of_equal_rows(spark):
    rows = [
        (1, "p", "r", "实际利用境外资金", "c", 5.0, None, ""), (2, "p", "r", "外商直接投资", "c", 5.0, None, "万美元"),
        (3, "p", "r2", "实际利用境外资金", "c", 7.0, 1.0, ""), (4, "p", "r", "全市用电总量(万千瓦小时)投资", "c", 1005986.0, None, ""),
    ]
    df = spark.createDataFrame(rows, "id int, period string, region string, indicator_name string, indicator_code string, value double, growth_rate double, unit string")
    got = {r.id: (r.indicator_name, r.value, r.unit) for r in merge.rename_and_dedupe(df).collect()}
    assert got == {2: ("外商直接投资", 5.0, "万美元"), 3: ("外商直接投资", 7.0, "万美元"), 4: ("全市用电总量(亿千瓦小时)", 100.5986, "亿千瓦小时")}


def test_conclusions(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "c", 20.0), (4, "d", None)], "o int, n string, v double")
    assert insight.conclude_trend(df, "v", F.col("o")).first().trend == "flat"
    assert insight.conclude_trend(df.filter("o < 4"), "v", F.col("o")).first().trend == "up"
    top = insight.conclude_top1(df, "n", "v").first()
    assert (top.name, top.value, top.lead) == ("b", 20.0, 0.0)
    assert insight.conclude_share(df, "n", "v").first().share == 40.0
    assert insight.conclude_compare(df, "n", "v").first().gap == 50.0
    assert insight.conclude_anomaly(df, "n", "v", F.col("o")).first().name == "a"


def test_granularity_and_split(spark):
    labels = ["2021年1-12月", "2022年1-12月", "2023年1-2月"]
    df = spark.createDataFrame(list(enumerate(labels)), "o int, period string")
    kept = series.granularity_guard(df, "period", F.col("o")).collect()
    assert [r.period for r in kept] == labels[:2] and kept[0].few_points
    peaks = spark.createDataFrame([("全市", 35.0), ("a", 12.0), ("b", 10.0), ("c", 2.0)], "series string, value double")
    row = series.split_axis(peaks).first()
    assert (row.series, row.median, row.split) == ("全市", 10.0, True)
    even = series.split_axis(peaks.filter("series <> '全市'")).first()
    assert (even.series, even.median, even.split) == ("a", 2.0, True)
    assert series.split_axis(peaks.filter("series IN ('a', 'b')")).first().split is False
    no_names = spark.createDataFrame([("2021年", 1.0)], "period string, value double")
    assert series.pie_slices(no_names, "value") is None


def test_questions(spark):
    asked = {
        "外商直接投资排名": ("RANKING", "外商直接投资", "外商直接投资"), "进出口是多少": ("GENERAL", None, "进出口"),
        "出口交货值走势": ("SALES_TREND", None, "出口交货值"), "出口与进口对比": ("COMPARISON", None, "出口,进口"),
    }
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    got = {r.question: (r.intent, r.rank_metric, r.indicators) for r in questions.classify_questions(df).collect()}
    assert got == asked


def test_collapse_rounds(spark):
    turns = [("s", i, q) for i, q in enumerate(["a", " a ", "b", "a", "a  "])]
    df = spark.createDataFrame(turns, "session_id string, seq int, question string")
    got = [(r.round_no, r.question, r.asked) for r in trace.collapse_rounds(df, 2).orderBy("round_no").collect()]
    assert got == [(1, "a", 2), (2, "b", 1), (3, "a", 2)]


def test_tree_and_consistency(spark):
    nodes = spark.createDataFrame(
        [("a", "x", 1, None), ("b", "y", 2, "a"), ("b", "z", 2, "a"), ("c", "z", 2, "a"), ("d", "w", 3, "a"), ("e", "v", 4, "b")],
        "code string, name string, level int, parent_code string")
    rules = {r.rule for r in quality.tree_violations(nodes).collect()}
    assert rules == {"repeated code", "level out of range", "parent not one level up", "repeated sibling name"}
    long = long_frame(spark)
    assert quality.identity_gaps(long, lx.SECTOR_METRICS, "地区生产总值").count() == 0
    assert quality.falling_cumulatives(long).count() == 0


def test_lookup_keys_are_unique():
    for pairs in (lx.alias_pairs(), list((lx.UNIT_OF_INDICATOR | lx.UNIT_OF_PART).items()), list(lx.PUBLISHER_OF_CATEGORY.items()), lx.question_indicator_pairs()):
        keys = [k for k, _ in pairs]
        assert len(keys) == len(set(keys)) < 200


def test_renames_go_pair_by_pair(spark):
    from longtally.operators.merge import rename_and_dedupe

    rows = [
        (1, "2024年1-3月", "全市", "地区生产总值(GDP)", "x", 5.0, 1.0, ""), (2, "2024年1-3月", "全市", "生产总值(GDP)", "x", 5.0, 1.0, ""),
        (3, "2024年1-3月", "全市", "生产总值(GDP)", "x", 6.0, None, ""), (4, "2024年1-3月", "全市", "地区生产总值(GDP)", "x", 5.0, 1.0, ""),
        (5, "2024年1-6月", "全市", "地区生产总值", "x", 7.0, None, ""), (6, "2024年1-6月", "全市", "生产总值(GDP)", "x", 7.0, None, ""),
    ]
    df = spark.createDataFrame(rows, "id long, period string, region string, indicator_name string, indicator_code string, value double, growth_rate double, unit string")
    assert sorted(r["id"] for r in rename_and_dedupe(df).collect()) == [1, 3, 4, 5]


def test_trend_is_flat_where_an_end_has_no_number(spark):
    from pyspark.sql import functions as F

    from longtally.operators.insight import conclude_trend

    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 9.0), ("b", 1, 1.0), ("b", 2, 2.0)], "g string, o int, v double")
    assert {r["g"]: r["trend"] for r in conclude_trend(df, "v", F.col("o"), ["g"]).collect()} == {"a": "flat", "b": "up"}


def test_steps_of_a_skewed_key_hold_equal_counts(spark):
    from longtally.operators import merge

    # values spread over many powers of ten: steps of equal width would put most of them into one
    values = spark.range(40_000).select(F.lit("hot").alias("k"), F.exp(F.randn(7) * 4).cast("decimal(30,12)").alias("value")).distinct()
    rows = values.union(spark.createDataFrame([("small", 1), ("small", 2), (None, 3)], "k string, value int").select("k", F.col("value").cast("decimal(30,12)")))
    stepped = merge.with_steps(rows, ["k"], "value", "step").cache()
    counts = {(r.k, r.step): r["count"] for r in stepped.groupBy("k", "step").count().collect()}
    hot = [n for (k, _), n in counts.items() if k == "hot"]
    assert len(hot) >= 35 and max(hot) <= 2 * sum(hot) / len(hot)
    assert counts[("small", 0)] == 2 and counts[(None, 0)] == 1
    bounds = sorted((r.lo, r.hi) for r in stepped.where("k = 'hot'").groupBy("step").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    stepped.unpersist()


def test_charts_of_past_rounds(spark):
    t = datetime.datetime(2024, 1, 1)
    plan = '{"chartType":"bar","targetTable":"stat","metrics":["产值","增速"]}'
    steps = [
        (1, 1, 1, "PLAN", plan), (2, 1, 1, "PLAN", '{"broken'), (3, 1, 1, "EXECUTE", '{"columns":["a","b"],"rows":[{"a":"x","b":1.5},{"c":{"d":[1]},"b":null},{"a":"7"}]}'),
        (4, 1, 2, "EXECUTE", '{"columns":["a"]}'), (5, 1, 3, "EXECUTE", '{"rows":[{"a":1}]}'), (6, 1, 3, "PLAN", plan), (7, 2, 1, "EXECUTE", "null"), (8, 2, 2, "EXECUTE", None),
        (9, 3, 1, "EXECUTE", '{"columns":["a"],"rows":[' + ",".join('{"a":%d}' % i for i in range(600)) + "]}"),
    ]
    rows = spark.createDataFrame([(i, s, r, k, p, t) for i, s, r, k, p in steps], "step_id long, session_id long, round_no int, step_type string, payload string, created_at timestamp")
    charts = trace.rebuild_charts(rows)
    got = {(r.session_id, r.round_no): (r.chart_type, r.title, r.columns, r.n) for r in charts.withColumn("n", F.size("rows")).drop("rows").collect()}
    assert got == {(1, 1): ("bar", "stat「产值、增速」", ["a", "b"], 3), (1, 2): ("table", "", ["a"], 0), (3, 1): ("table", "", ["a"], 600)}
    cells = trace.chart_cells(charts)
    assert sorted((r.row, r.field, r.text, r.number) for r in cells.where("session_id = 1").collect()) == [
        (0, "a", "x", None), (0, "b", None, 1.5), (1, "c", '{"d":[1]}', None), (2, "a", "7", None)
    ]
    assert cells.where("session_id = 3").count() == 500
