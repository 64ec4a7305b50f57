"""Batch classification of questions: intent, metrics, time range and flags.

Keyword tables are small fixed lists, so they become Column expressions: a
question is read once, without a join against keywords.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import periods, text


def _words(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def hits(question: Column, words) -> Column:
    """Listed words that occur in the text, in list order."""
    return F.filter(_words(words), lambda w: F.contains(question, w))


def intent(question: Column) -> Column:
    """struct(code, confidence, keywords) of the first rule with a keyword hit."""
    return text.bind(F.lower(question), _first_intent)


def _first_intent(q: Column) -> Column:
    general = F.struct(
        F.lit(lx.GENERAL_INTENT).alias("code"), F.lit(lx.GENERAL_CONFIDENCE).alias("confidence"),
        F.array().cast("array<string>").alias("keywords"),
    )
    out = general
    for code, words in reversed(lx.INTENT_RULES.items()):
        found = hits(q, words)
        confidence = F.least(F.lit(1.0), F.round(F.lit(0.5) + F.lit(0.15) * F.size(found), 2))
        rule = F.struct(F.lit(code).alias("code"), confidence.alias("confidence"), found.alias("keywords"))
        out = F.when(text.contains_any(q, words), rule).otherwise(out)
    return out


def rank_metric(question: Column) -> Column:
    """Metric of the longest ranking keyword in the text; earlier keywords win ties."""
    ordered = sorted(lx.RANK_QUESTION_METRICS.items(), key=lambda kv: -len(kv[0]))
    return reduce(
        lambda other, kv: F.when(F.contains(question, F.lit(kv[0])), F.lit(kv[1])).otherwise(other),
        reversed(ordered), F.lit(None).cast("string"),
    )


def indicators(question: Column) -> Column:
    """Indicators named in the text, each once, in table order.

    "出口" counts alone only outside "进出口" and "出口交货值".
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in lx.question_indicator_pairs()])

    def named(q):
        found = F.filter(
            pairs, lambda p: F.when(p["k"] == "出口", q.rlike(lx.EXPORT_ALONE_RE)).otherwise(F.contains(q, p["k"]))
        )
        return F.array_distinct(F.transform(found, lambda p: p["v"]))

    return text.bind(F.lower(question), named)


def is_snapshot(question: Column) -> Column:
    """Asks for the latest figure and for nothing else."""
    return text.contains_any(question, lx.SNAPSHOT_WORDS) & ~text.contains_any(question, lx.SNAPSHOT_BLOCK_WORDS)


def classify_questions(df: DataFrame, column: str = "question") -> DataFrame:
    """Intent, confidence, rank metric, indicators, time range and shape flags per question."""
    q = F.col(column)
    out = df.withColumn("_i", intent(q))
    return out.withColumns({
        "intent": F.col("_i.code"), "confidence": F.col("_i.confidence"),
        "keywords": F.array_join("_i.keywords", ","), "rank_metric": rank_metric(q),
        "indicators": F.array_join(indicators(q), ","), "time_range": periods.time_range(q),
        "snapshot": is_snapshot(q), "by_region": text.contains_any(q, lx.REGION_WORDS),
        "trend": text.contains_any(q, lx.TREND_WORDS),
    }).drop("_i")


def industries(question: Column) -> Column:
    """Industries named in the text; a word for all of them stands for the three."""
    named = F.array_compact(F.array(*[F.when(F.contains(question, F.lit(w)), F.lit(v)) for w, v in lx.INDUSTRY_OF_WORD.items()]))
    return F.when(text.contains_any(question, lx.WHOLE_INDUSTRY_WORDS), _words(lx.SECTORS)).otherwise(named)


def _all_of(question: Column, groups) -> Column:
    return reduce(lambda a, b: a & b, [text.contains_any(question, words) for words in groups])


def _first_of(question: Column, table) -> Column:
    """Metrics of the first row of a (groups of words, metrics) table that the text meets, else null."""
    out = F.lit(None).cast("array<string>")
    for groups, metrics in reversed(table):
        out = F.when(_all_of(question, groups), _words(metrics)).otherwise(out)
    return out


def _plan(metrics: Column, dimensions, chart, time_range=None) -> Column:
    as_array = dimensions if isinstance(dimensions, Column) else _words(dimensions)
    as_text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(metrics.alias("metrics"), as_array.alias("dimensions"), as_text(chart).alias("chart"), as_text(time_range).alias("period"))


def trend_plan(question: Column, named: Column) -> Column:
    """struct(metrics, dimensions, chart, period) of a question after a course or a figure.

    ``named`` are the indicators found in it. Families of metrics come first (investment by industry,
    deposits and loans, industrial sectors, structure sets), then rankings, then named industries,
    indicators and categories; a question for the latest figure or for regions changes the shape.
    """
    asks = lambda *words: text.contains_any(question, words)
    own = industries(question)
    category = _first_of(question, [([words], metrics) for words, metrics in lx.CATEGORY_METRICS])
    by_region = text.contains_any(question, lx.REGION_WORDS)
    default = F.when(by_region, _words(["地区生产总值"])).otherwise(_words(lx.SECTORS))
    metrics = F.when(F.size(own) > 0, own).when(F.size(named) > 0, named).otherwise(F.coalesce(category, default))
    compare = text.contains_any(question, lx.SNAPSHOT_COMPARE_WORDS)
    structure = _first_of(question, lx.STRUCTURE_METRICS)
    rank = rank_metric(question)
    course = F.when(F.size(own) > 0, _words(["期间", "产业"])).otherwise(_words(["期间", "指标"]))
    return (
        F.when(_first_of(question, lx.DETAIL_METRICS).isNotNull() & asks("投资"), _plan(_words(lx.INDUSTRY_INVESTMENT_NAMES), ["期间", "行业"], "line"))
        .when(asks("存贷款"), _plan(_words(["各项存款", "各项贷款"]), ["期间", "指标"], "line"))
        .when(asks(*lx.SECTOR_QUESTION_WORDS), _plan(_words(lx.INDUSTRY_NAMES), ["期间", "行业"], "line"))
        .when(structure.isNotNull(), _plan(structure, ["期间", "指标"], "line"))
        .when(rank.isNotNull(), _plan(F.array(rank), ["区县"], "bar"))
        .when(is_snapshot(question), _plan(metrics, ["指标"], "bar", lx.LATEST_PERIOD))
        .when(by_region & compare, _plan(metrics, ["区县"], "bar"))
        .when(by_region, _plan(metrics, ["期间", "区县"], "line"))
        .otherwise(_plan(metrics, course, "line"))
    )


def structure_plan(question: Column, named: Column) -> Column:
    """The same of a question after shares: details, then named parts without their totals, then the industries."""
    asks = lambda words: text.contains_any(question, words)
    detail = _first_of(question, lx.DETAIL_METRICS)
    by_region, by_industry, trend = asks(lx.STRUCTURE_REGION_WORDS), asks(lx.STRUCTURE_INDUSTRY_WORDS), asks(lx.TREND_WORDS)
    parts = F.array_except(named, _words(lx.STRUCTURE_TOTAL_METRICS))
    metrics = F.when(F.size(parts) > 0, parts).otherwise(named)
    over = lambda *dims: F.when(trend, _words(["期间", *dims])).otherwise(_words(list(dims)))
    line_or = lambda other: F.when(trend, F.lit("line")).otherwise(other)
    own = industries(question)
    sectors = F.when(F.size(own) > 0, own).otherwise(_words(lx.SECTOR_METRICS))
    plain = _plan(_words(lx.SECTOR_METRICS), ["产业"], "pie", lx.LATEST_PERIOD)
    return (
        F.when(detail.isNotNull(), _plan(detail, ["指标"], "bar", lx.LATEST_PERIOD))
        .when(~by_industry & (F.size(named) > 0) & by_region, _plan(
            metrics, over("区县"), line_or(F.when(asks(lx.STRUCTURE_COMPARE_WORDS), F.lit("bar")).otherwise(F.lit("pie"))), lx.LATEST_PERIOD))
        .when(~by_industry & (F.size(named) > 0), _plan(metrics, over("指标"), line_or(F.lit("pie")), lx.LATEST_PERIOD))
        .when(by_region | by_industry, _plan(sectors, over("产业"), line_or(F.lit("pie")), lx.LATEST_PERIOD))
        .otherwise(plain)
    )


def question_plans(df: DataFrame, column: str = "question") -> DataFrame:
    """Metrics, dimensions, chart, fixed period and record flag per question, on top of its intent."""
    q = F.col(column)
    out = df.withColumn("_named", indicators(q)).withColumn("_code", intent(q)["code"])
    plan = F.when(F.col("_code") == "STRUCTURE", structure_plan(q, F.col("_named"))).otherwise(trend_plan(q, F.col("_named")))
    out = out.withColumn("_plan", plan)
    return out.withColumns({
        "intent": F.col("_code"), "metrics": F.array_join("_plan.metrics", "|"), "dimensions": F.array_join("_plan.dimensions", "|"),
        "chart": F.col("_plan.chart"), "period": F.col("_plan.period"),
        "about_records": text.contains_any(F.lower(q), lx.RECORD_KEYWORDS),
    }).drop("_named", "_code", "_plan")
