"""Template aggregates on demo facts and publication records.

Every total is decimal, so partial sums combine in any order to the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def totals(df: DataFrame, by, *measures: str) -> DataFrame:
    """SUM of measures by one or more dimensions; amounts come back as doubles."""
    kinds = dict(df.dtypes)
    sums = [
        (F.sum(m).cast("double") if kinds[m].startswith("decimal") else F.sum(m)).alias(m) for m in measures
    ]
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(*sums)


def top_totals(df: DataFrame, by: str, order_by: str, *measures: str, n: int = 10) -> DataFrame:
    """The n groups with the largest total, ties by name."""
    return totals(df, by, order_by, *measures).orderBy(F.desc(order_by), by).limit(n)


def mean_rate(df: DataFrame, by: str, rate: str) -> DataFrame:
    """Plain average of a rate per cohort (approximate: not weighted by cohort size)."""
    return df.groupBy(by).agg(F.round((F.sum(rate) / F.count(rate)).cast("double"), 4).alias(rate))


def latest_detail(df: DataFrame, date: str, by: str, *measures: str, n: int = 30) -> DataFrame:
    """Totals by date and dimension, latest dates first."""
    return totals(df, [date, by], *measures).orderBy(F.desc(date), by).limit(n)


def average_amount(df: DataFrame, by, amount: str, count: str, name: str = "avg_order_amount") -> DataFrame:
    """Totals with the amount per unit of count, two digits; null where the count is zero."""
    sums = df.groupBy(*by).agg(F.sum(amount).alias("_a"), F.sum(count).alias(count))
    ratio = F.round(F.col("_a") / F.nullif(F.col(count), F.lit(0)), 2).cast("double")
    return sums.select(*by, F.col("_a").cast("double").alias(amount), count, ratio.alias(name))


def count_by(df: DataFrame, *by: Column | str, name: str = "doc_count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def month_label(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def display_unit(unit: str = "publish_unit", fallback: str = "category") -> Column:
    """Publishing unit, or the category where the unit is blank."""
    return F.coalesce(F.nullif(unit, F.lit("")), F.col(fallback))


def share_of_total(df: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """Row count and share of all rows per group.

    The grand total is a scalar subquery over the grouped counts.
    """
    counts = df.filter(F.col(by).isNotNull() & (F.col(by) != "")).groupBy(by).agg(F.count(F.lit(1)).alias("cnt"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("ratio", F.round(F.col("cnt") / total, digits))


def daily_average(df: DataFrame, date: str) -> DataFrame:
    """Rows per day between the first and last date; null when they coincide."""
    span = F.nullif(F.datediff(F.max(date), F.min(date)), F.lit(0))
    return df.filter(F.col(date).isNotNull()).agg(F.round(F.count(F.lit(1)) / span, 2).alias("avg_daily"))


def most_common(df: DataFrame, column: str, n: int = 12, name: str = "n") -> DataFrame:
    """Value counts, most frequent first, ties by value."""
    return count_by(df, column, name=name).orderBy(F.desc(name), column).limit(n)


def mode_per_group(df: DataFrame, by: str, column: str) -> DataFrame:
    """Most frequent non-blank value per group; ties go to the greatest string.

    Counting comes first, so a hot group reaches one task as a few counted values.
    """
    value = F.trim(F.col(column))
    counts = df.filter(value != "").groupBy(by, value.alias(column)).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", column)).alias("best")
    return counts.groupBy(by).agg(best).select(by, F.col(f"best.{column}").alias(column))


def distinct_profile(df: DataFrame, by, *columns: str) -> DataFrame:
    """Rows, distinct values of each column and distinct combinations per group.

    Each distinct count is its own two-step aggregate joined on the group, which
    avoids expanding the input once per column.
    """
    by = [by] if isinstance(by, str) else list(by)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    for c in columns:
        distinct = df.select(*by, c).distinct().groupBy(*by).agg(F.count(c).alias(f"n_{c}"))
        out = out.join(distinct, by)
    combos = df.select(*by, *columns).dropna(subset=list(columns)).distinct()
    combined = combos.groupBy(*by).agg(F.count(F.lit(1)).alias("n_combined"))
    return out.join(combined, by, "left").fillna(0, ["n_combined"])


def publication_statistics(records: DataFrame, since: str, stop_words, top: int = 10) -> DataFrame:
    """Total and date range, category share, years, months and topic words as one long result.

    Every part aggregates first; the parts are unioned in the store's schema.
    """
    from ..functions.text import cjk_tokens

    def part(df, name, value, metric, unit, remark=F.lit("")):
        return df.select(
            F.lit(name).alias("analysis_name"), F.lit("statistics").alias("dimension"),
            value.alias("dim_value"), metric.cast("double").alias("metric_value"),
            F.lit(unit).alias("metric_unit"), remark.alias("remark"),
        )

    span = F.concat(F.min("publish_date").cast("string"), F.lit(" ~ "), F.max("publish_date").cast("string"))
    scale = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(span, F.lit("")).alias("span"))
    by_category = share_of_total(records, "category", 6)
    by_year = count_by(
        records.filter(F.col("publish_date").isNotNull()),
        F.concat("category", F.lit("/"), F.year("publish_date").cast("string")).alias("v"), name="n",
    )
    recent = records.filter(F.col("publish_date") >= F.lit(since).cast("date"))
    by_month = count_by(recent, month_label("publish_date").alias("v"), name="n")
    words = (
        records.select(F.explode(cjk_tokens(F.col("title"))).alias("v"))
        .filter(~F.col("v").isin(list(stop_words)))
    )
    return (
        part(scale, "scale", F.lit("records"), F.col("n"), "rows", F.col("span"))
        .unionByName(part(
            by_category, "category share", F.col("category"), F.col("cnt"), "rows",
            F.format_string("%.1f%%", F.round(F.col("ratio") * 100, 1))))
        .unionByName(part(by_year, "year distribution", F.col("v"), F.col("n"), "rows"))
        .unionByName(part(by_month, "month trend", F.col("v"), F.col("n"), "rows"))
        .unionByName(part(most_common(words, "v", top), "topic words", F.col("v"), F.col("n"), "times"))
    )


def format_fingerprint(raw: DataFrame) -> DataFrame:
    """Rows, sheets, periods, indicators and period histogram per document.

    The histogram is built from counted (document, period) pairs; its length is
    bounded by the number of period labels, not by the document's rows.
    """
    profile = raw.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sheet_name").alias("sheets"),
        F.countDistinct("period").alias("periods"), F.countDistinct("indicator_name").alias("indicators"),
    )
    counted = raw.groupBy("doc_id", "period").agg(F.count(F.lit(1)).alias("c"))
    entry = F.concat("period", F.lit("="), F.col("c").cast("string"))
    histogram = counted.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(entry)), " ").alias("formats"))
    return profile.join(histogram, "doc_id")


def outcome_matrix(df: DataFrame, by: str, status: str, statuses) -> DataFrame:
    """Row count per group and status with the total; statuses are a fixed list."""
    counts = df.groupBy(by).pivot(status, list(statuses)).agg(F.count(F.lit(1)))
    cells = [F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s.lower()) for s in statuses]
    out = counts.select(by, *cells)
    return out.withColumn("total", sum((F.col(s.lower()) for s in statuses), F.lit(0).cast("long")))


def asset_overview(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows and distinct values of ``names`` per group, from one pre-aggregate instead of one distinct each."""
    cells = df.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    each = cells.select(*by, "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("of"), F.col(n).cast("string").alias("v")) for n in names])).alias("_c"))
    values = each.groupBy(*by, "_c.of", "_c.v").agg(F.sum("_n").alias("_n"))
    counts = [F.count(F.when((F.col("of") == n) & F.col("v").isNotNull(), 1)).alias(f"{n}s") for n in names]
    return values.groupBy(*by).agg(F.sum(F.when(F.col("of") == names[0], F.col("_n"))).alias("n"), *counts)
