"""Result checks, audits and constraint reports; every check returns rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import lexicon as lx
from ..functions.periods import growth_percent


def metric_columns(df: DataFrame) -> list[str]:
    """Columns whose name says they hold numbers."""
    return [c for c in df.columns if re.search(lx.METRIC_COLUMN_RE, c)]


def time_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if re.search(lx.TIME_COLUMN_RE, c)), None)


def _number(df: DataFrame, c: str) -> Column:
    numeric = isinstance(df.schema[c].dataType, T.NumericType)
    return F.col(c).cast("double") if numeric else F.trim(F.col(c).cast("string")).try_cast("double")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: repeats inside equal keys and metrics, with the first such key as example.

    Grouping on the whole row replaces comparing the rows of a key pairwise.
    """
    metrics = metric_columns(df)
    keys = [c for c in df.columns if c not in metrics]
    text = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"), F.min(text).alias("example"))


def sanity_check(df: DataFrame, row_limit: int = lx.ROW_LIMIT_WARN, ratio: float = lx.MAGNITUDE_RATIO) -> DataFrame:
    """Warnings on a result as rows (check_name, column_name, n, detail); none means it passed.

    Two aggregates, both combined on the map side: one over all rows, one over
    grouped rows for the duplicates.
    """
    metrics, time = metric_columns(df), time_column(df)
    keys = [c for c in df.columns if c not in metrics]
    positive = lambda c: F.when(_number(df, c) > 0, _number(df, c))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    stats = [F.count(F.lit(1)).alias("_rows")]
    stats += [F.min(positive(c)).alias(f"_low_{c}") for c in metrics]
    stats += [F.max(positive(c)).alias(f"_high_{c}") for c in metrics]
    if time:
        stats.append(F.count(F.when(blank(time), 1)).alias("_blank"))
    if "growth_rate" in df.columns:
        stats.append(F.count(F.when(~blank("growth_rate"), 1)).alias("_growth"))
    one = df.agg(*stats)

    def warn(condition, name, column, n, detail):
        return F.when(condition, F.struct(
            F.lit(name).alias("check_name"), column.cast("string").alias("column_name"),
            n.cast("long").alias("n"), detail.cast("string").alias("detail")))

    none = F.lit(None).cast("string")
    filled = F.col("_rows") > 0
    checks = [warn(~filled, "empty result", none, F.col("_rows"), none)]
    if time:
        checks.append(warn(filled & (F.col("_blank") > 0), "blank time", F.lit(time), F.col("_blank"), none))
    if metrics:
        spread = lambda c: F.col(f"_high_{c}") / F.col(f"_low_{c}")
        first = F.coalesce(*[F.when(spread(c) >= ratio, F.struct(F.lit(c).alias("c"), spread(c).alias("r"))) for c in metrics])
        checks.append(warn(filled & first.isNotNull(), "magnitude", first["c"], F.round(first["r"]), none))
    if "growth_rate" in df.columns:
        checks.append(warn(filled & (F.col("_growth") == 0), "no growth", F.lit("growth_rate"), F.col("_rows"), none))
    checks.append(warn(F.col("_rows") > row_limit, "many rows", none, F.col("_rows"), none))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    out = one.select(F.inline(found))
    if not keys:
        return out
    repeated = exact_duplicates(df).filter("extra_rows > 0").select(
        F.lit("duplicates").alias("check_name"), F.lit(", ".join(keys)).alias("column_name"),
        F.col("extra_rows").alias("n"), F.col("example").alias("detail"),
    )
    return out.unionByName(repeated)


def coverage_curve(clean: DataFrame) -> DataFrame:
    """Share of the latest period's indicators that each year has."""
    year = F.substring("period", 1, 4).try_cast("int")
    rows = clean.withColumn("year", year).filter(F.col("year").isNotNull())
    universe = latest_universe(clean)
    size = universe.agg(F.count(F.lit(1))).scalar()
    hits = rows.select("year", "indicator_name").distinct().join(universe, "indicator_name", "left_semi")
    return hits.groupBy("year").agg(F.count(F.lit(1)).alias("hits")).withColumns({
        "universe": size, "coverage": F.round(F.col("hits") / size, 4)
    })


def latest_universe(clean: DataFrame) -> DataFrame:
    """Distinct indicators of the latest standard period."""
    from ..functions.periods import parse

    p = parse(F.col("period"))
    rows = clean.select("indicator_name", p.alias("p")).filter(F.col("p").isNotNull())
    key = F.struct("p.year", "p.end", "p.start")
    return rows.filter(key == rows.agg(F.max(key)).scalar()).select("indicator_name").distinct()


def leftovers(clean: DataFrame, current_year: Column | None = None) -> DataFrame:
    """Indicators without any row in the latest year: DISCONTINUED, VARIANT or NOISE.

    Trap names (same name, other meaning) are always listed.
    """
    name = F.col("indicator_name")
    year = F.substring("period", 1, 4)
    newest = clean.agg(F.max(year)).scalar() if current_year is None else current_year
    trap = name.isin(list(lx.TRAP_NAMES))
    noise = reduce(lambda a, b: a | b, [F.startswith(name, F.lit(p)) for p in lx.LEFTOVER_NOISE_PREFIXES])
    status = (
        F.when(trap, "VARIANT").when(noise | name.isin(lx.LEFTOVER_NOISE_NAMES), "NOISE").otherwise("DISCONTINUED")
    )
    per_year = clean.groupBy("indicator_name", year.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_year.groupBy("indicator_name")
        .agg(
            F.sum("n").alias("rows"), F.max("year").alias("_last"),
            F.array_join(F.sort_array(F.collect_list("year")), ",").alias("years"),
        )
        .filter(trap | (F.col("_last") < newest))
        .select("indicator_name", status.alias("status"), "rows", "years")
    )


def anchors(clean: DataFrame, spec) -> DataFrame:
    """Regression anchors: (period, region, indicator, expected, tolerance) against the table.

    The few literals go to the rows; only matches come back to the literals.
    """
    table = lx.lookup_frame(clean.sparkSession, spec, "period", "region", "indicator_name", "expected", "tolerance")
    rows = clean.select("period", "region", "indicator_name", F.col("value").alias("actual"))
    keys = ["period", "region", "indicator_name"]
    found = rows.join(F.broadcast(table.select(*keys).distinct()), keys)
    out = table.join(found, keys, "left")
    passed = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    return out.select("period", "region", "indicator_name", "expected", "actual", passed.alias("passed"))


def residue_checks(clean: DataFrame) -> DataFrame:
    """Counts that should be zero after alignment, plus key uniqueness; one pass plus one distinct."""
    name = F.col("indicator_name")
    old = [o for o, _, _, _ in lx.ALIGN_RENAMES]
    polluted = F.endswith(name, F.lit("投资")) & reduce(
        lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in ("用电总量", "商品房", "(个)", "待售面积")])
    one = clean.agg(
        F.count(F.when(name.isin(old), 1)).alias("old names"),
        F.count(F.when(polluted, 1)).alias("polluted names"),
        F.count(F.when(F.contains(name, F.lit("贸外处")), 1)).alias("sheet markers"),
        F.count(F.when(F.coalesce("unit", F.lit("")) == "", 1)).alias("blank units"),
    )
    names = ["old names", "polluted names", "sheet markers", "blank units"]
    tall = one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.lit(0).cast("long").alias("expected"), F.col(f"`{n}`").alias("actual")) for n in names
    ])))
    repeated = (
        clean.groupBy("period", "region", "indicator_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .agg(F.lit("repeated keys").alias("check_name"), F.lit(0).cast("long").alias("expected"), F.count(F.lit(1)).alias("actual"))
    )
    return tall.unionByName(repeated).withColumn("passed", F.col("actual") == F.col("expected"))


def expectation_check(results: DataFrame, expected: DataFrame, key: str, columns, tolerance: float = 0.02) -> DataFrame:
    """Per question: enough rows, and some numeric cell within the tolerance of the target.

    ``expected`` has (key, min_rows, target). Rows fold into two booleans per
    question before anything is joined back.
    """
    cells = [F.abs(F.col(c) - F.col("target")) <= tolerance for c in columns]
    any_hit = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), cells, F.lit(False))
    present = reduce(lambda a, b: a | F.col(b).isNotNull(), columns, F.lit(False))
    folded = results.join(expected, key).groupBy(key, "min_rows", "target").agg(
        F.count(F.when(present, 1)).alias("_n"), F.max(F.when(any_hit, 1).otherwise(0)).alias("_hit")
    ).withColumnsRenamed({key: "_key", "min_rows": "_rows", "target": "_target"})
    same = (F.col(key) == F.col("_key")) & (F.col("min_rows") == F.col("_rows")) & F.col("target").eqNullSafe(F.col("_target"))
    return expected.join(folded, same, "left").withColumn("n", F.coalesce("_n", F.lit(0))).select(
        key, "n", (F.col("n") >= F.col("min_rows")).alias("enough_rows"),
        (F.col("target").isNull() | F.coalesce(F.col("_hit") == 1, F.lit(False))).alias("value_found"),
    )


def falling_cumulatives(long: DataFrame, ratio_units=("%", "名", "元")) -> DataFrame:
    """Cumulative values that fall inside a year, which additive series never do."""
    series = Window.partitionBy("region", "indicator_name", "year").orderBy("end")
    rows = long.filter(F.col("value").isNotNull() & ~F.col("unit").isin(list(ratio_units)))
    return rows.withColumn("previous", F.lag("value").over(series)).filter(
        F.col("value") < F.col("previous")
    ).select("region", "indicator_name", "period", "previous", "value")


def identity_gaps(long: DataFrame, parts, total: str, tolerance: float = 0.01) -> DataFrame:
    """(period, region) where the parts do not add up to the total."""
    rows = long.filter(F.col("indicator_name").isin([*parts, total]) & F.col("value").isNotNull())
    exact = F.col("value").cast("decimal(28,4)")
    both = rows.groupBy("period", "region").agg(
        F.sum(F.when(F.col("indicator_name") != total, exact)).cast("double").alias("parts"),
        F.max(F.when(F.col("indicator_name") == total, F.col("value"))).alias("total"),
        F.countDistinct("indicator_name").alias("_n"),
    )
    return both.filter((F.col("_n") == len(parts) + 1) & (F.abs(F.col("parts") - F.col("total")) > tolerance)).drop("_n")


def growth_disagreements(long: DataFrame, tolerance: float = 0.06) -> DataFrame:
    """Stored growth that differs from this year over last year."""
    from .reports import yoy

    rows = yoy(long.filter(F.col("value").isNotNull()))
    return rows.filter(F.abs(F.col("yoy") - F.col("growth_rate")) > tolerance).select(
        "period", "region", "indicator_name", "growth_rate", "yoy"
    )


def mixed_units(df: DataFrame) -> DataFrame:
    """Indicators that appear with more than one unit."""
    units = df.select("indicator_name", F.coalesce("unit", F.lit("")).alias("unit")).distinct()
    return units.groupBy("indicator_name").agg(
        F.count(F.lit(1)).alias("units"), F.array_join(F.sort_array(F.collect_list("unit")), "|").alias("unit_list")
    ).filter("units > 1")


def tree_violations(nodes: DataFrame) -> DataFrame:
    """Broken rules of a category tree: repeated code, bad level, bad parent level, repeated sibling name."""
    def report(df, rule, column):
        return df.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("node"))

    codes = nodes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    levels = nodes.filter(~F.col("level").between(1, 3))
    parent = nodes.select(F.col("code").alias("_p"), F.col("level").alias("_l"))
    placed = nodes.join(parent, F.col("parent_code") == F.col("_p"), "left")
    wrong = placed.filter(
        ((F.col("level") == 1) & F.col("parent_code").isNotNull())
        | ((F.col("level") > 1) & (F.col("_l").isNull() | (F.col("_l") != F.col("level") - 1)))
    )
    siblings = nodes.groupBy(F.coalesce("parent_code", F.lit("")).alias("parent"), "name").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("node", F.concat_ws("/", "parent", "name"))
    return (
        report(codes, "repeated code", "code").unionByName(report(levels, "level out of range", "code"))
        .unionByName(report(wrong, "parent not one level up", "code"))
        .unionByName(report(siblings, "repeated sibling name", "node"))
    )


def blocked_deletes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes asked to be deleted that still have children, with the child count."""
    children = nodes.groupBy(F.col("parent_code").alias("code")).agg(F.count(F.lit(1)).alias("children"))
    return wanted.join(children, "code")
