"""Cumulative period labels: parse once, keep numbers, compare on numbers.

A label such as "2025年1-9月" means January to September of 2025. Periods of one
year nest, so they are never added up; two periods are comparable when their
start and end months agree.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .text import bind, no_space

# --- fixed values: label formats ---
FULL_RE = r"^(\d{4})\s*年\s*(\d{1,2})\s*[-－]\s*(\d{1,2})\s*月(累计)?$"
CROSS_RE = r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*[-－]\s*(\d{4})\s*年\s*(\d{1,2})\s*月$"
YEAR_RE = r"^(\d{4})\s*年$"
CUMULATIVE_RE = r"^(\d{1,2})\s*[-－]\s*(\d{1,2})\s*月(累计)?$"
MONTH_END_RE = r"^(\d{1,2})\s*月末$"
STANDARD_RE = r"^\d{4}年\d{1,2}-\d{1,2}月$"


def _int(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def label(year: Column, start: Column, end: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("年"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("月"))


def parse(c: Column, default_year: Column | None = None) -> Column:
    """Label to struct(year, start, end, kind); null where the format is unknown.

    ``kind`` is ``cumulative``, ``month_end`` or ``year``. Labels without a year
    take ``default_year`` (the year of their document).
    """
    year = F.lit(None).cast("int") if default_year is None else default_year.cast("int")
    c = F.trim(c)

    def period(y, s, e, kind):
        return F.struct(y.alias("year"), s.alias("start"), e.alias("end"), F.lit(kind).alias("kind"))

    return (
        F.when(c.rlike(FULL_RE), period(_int(c, FULL_RE, 1), _int(c, FULL_RE, 2), _int(c, FULL_RE, 3), "cumulative"))
        .when(
            c.rlike(CUMULATIVE_RE),
            period(year, _int(c, CUMULATIVE_RE, 1), _int(c, CUMULATIVE_RE, 2), "cumulative"),
        )
        .when(c.rlike(MONTH_END_RE), period(year, F.lit(1), _int(c, MONTH_END_RE, 1), "month_end"))
        .when(c.rlike(YEAR_RE), period(_int(c, YEAR_RE, 1), F.lit(1), F.lit(12), "year"))
    )


def standard_label(c: Column, default_year: Column, accept_year_only: bool = False) -> Column:
    """"YYYY年a-b月" for known formats, else null.

    Month-end labels become January-to-month periods. Year-only labels are
    unknown unless ``accept_year_only``; they then keep their own text.
    """
    return completed_label(*label_parts(c, accept_year_only), default_year)


def label_parts(c: Column, accept_year_only: bool = False) -> tuple[Column, Column]:
    """What a label alone decides of ``standard_label``: the whole label, or its months where the year is missing."""
    full = r"^(\d{4})年(\d{1,2})-(\d{1,2})月$"
    running = r"^(\d{1,2})-(\d{1,2})月累计$"
    month_end = r"^(\d{1,2})月末$"
    months = lambda start, end: F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit("月"))
    own = F.when(c.rlike(full), label(_int(c, full, 1), _int(c, full, 2), _int(c, full, 3)))
    rest = (
        F.when(c.rlike(running), months(_int(c, running, 1), _int(c, running, 2)))
        .when(c.rlike(month_end), months(F.lit(1), _int(c, month_end, 1)))
    )
    return (own.when(c.rlike(r"^\d{4}年$"), c) if accept_year_only else own), rest


def completed_label(own: Column, rest: Column, default_year: Column) -> Column:
    return F.coalesce(own, F.concat(default_year.cast("int").cast("string"), F.lit("年"), rest))


def extraction_label(c: Column, year: Column) -> Column:
    """Period cell of a sheet header, completed with the year when it has none."""
    s = no_space(F.coalesce(c, F.lit("")))
    known = r"^(20\d{2})?年?(\d{1,2}(?:-\d{1,2})?月)?$"
    y, months = F.regexp_extract(s, known, 1), F.regexp_extract(s, known, 2)
    year_label = F.concat(year.cast("string"), F.lit("年"))
    return (
        F.when(~s.rlike(known), s)
        .when((y != "") & s.contains("年"), s)
        .when(y != "", F.concat(y, F.lit("年"), months))
        .when(months != "", F.concat(year_label, months))
        .otherwise(year_label)
    )


def year_from_title(title: Column, doc_date: Column) -> Column:
    """First "20xx年" of the title, else the year of the document date."""
    return F.coalesce(_int(title, r"(20\d{2})年", 1), F.year(doc_date))


def period_from_title(title: Column) -> Column:
    months = r"(20\d{2})年(\d{1,2})-(\d{1,2})月"
    part = lambda i: F.regexp_extract(title, months, i)
    return (
        F.when(title.rlike(months), F.concat(part(1), F.lit("年"), part(2), F.lit("-"), part(3), F.lit("月")))
        .when(title.rlike(r"20\d{2}年"), F.concat(F.regexp_extract(title, r"(20\d{2})年", 1), F.lit("年")))
        .otherwise(F.lit(""))
    )


def is_standard(c: Column) -> Column:
    return c.rlike(STANDARD_RE)


def axis_label(c: Column) -> Column:
    """Display label of a period on a chart axis; unknown text is kept."""
    c = F.trim(c)
    month = F.lit("月")
    text = lambda p, i: F.regexp_extract(c, p, i)
    num = lambda p, i: _int(c, p, i).cast("string")
    return (
        F.when(
            c.rlike(FULL_RE),
            F.concat(text(FULL_RE, 1), F.lit("年"), num(FULL_RE, 2), F.lit("月-"), num(FULL_RE, 3), month, text(FULL_RE, 4)),
        )
        .when(
            c.rlike(CROSS_RE),
            F.concat(
                text(CROSS_RE, 1), F.lit("年"), num(CROSS_RE, 2), F.lit("月-"),
                text(CROSS_RE, 3), F.lit("年"), num(CROSS_RE, 4), month,
            ),
        )
        .when(
            c.rlike(CUMULATIVE_RE),
            F.concat(num(CUMULATIVE_RE, 1), F.lit("月-"), num(CUMULATIVE_RE, 2), month, text(CUMULATIVE_RE, 3)),
        )
        .when(c.rlike(MONTH_END_RE), F.concat(num(MONTH_END_RE, 1), F.lit("月末")))
        .otherwise(c)
    )


def axis_key(c: Column) -> Column:
    """Sort key struct(key, tie): time first, then label class; unknown text last."""
    c = F.trim(c)

    def end_month(p, a, b):
        start, end = _int(c, p, a), _int(c, p, b)
        return F.when(end < start, end + 12).otherwise(end)

    def key(k, tie):
        return F.struct(k.cast("long").alias("key"), F.lit(tie).alias("tie"))

    return (
        F.when(c.rlike(FULL_RE), key(_int(c, FULL_RE, 1) * 100 + end_month(FULL_RE, 2, 3), 1))
        .when(c.rlike(CROSS_RE), key(_int(c, CROSS_RE, 3) * 100 + _int(c, CROSS_RE, 4), 1))
        .when(c.rlike(YEAR_RE), key(_int(c, YEAR_RE, 1) * 100 + 12, 0))
        .when(c.rlike(CUMULATIVE_RE), key(end_month(CUMULATIVE_RE, 1, 2), 2))
        .when(c.rlike(MONTH_END_RE), key(_int(c, MONTH_END_RE, 1), 2))
        .otherwise(key(F.lit(9223372036854775807), 3))
    )


def granularity(c: Column) -> Column:
    """Length of a cumulative period in months; null where it cannot be told."""
    c = F.trim(c)

    def months(p, a, b):
        start, end = _int(c, p, a), _int(c, p, b)
        return F.when(end < start, end + 12).otherwise(end) - start + 1

    return (
        F.when(c.rlike(FULL_RE), months(FULL_RE, 2, 3))
        .when(c.rlike(CUMULATIVE_RE), months(CUMULATIVE_RE, 1, 2))
        .when(c.rlike(YEAR_RE), F.lit(12))
    )


def _chinese_number(text: Column) -> Column:
    """Arabic or Chinese numeral (1-99) to int; 0 where it is not one."""
    return bind(text, _numeral)


def _numeral(c: Column) -> Column:
    digit = F.lit(None).cast("int")
    for char, n in lx.CHINESE_DIGITS.items():
        digit = F.when(c == char, F.lit(n)).otherwise(digit)

    def value_of(pos):
        out = F.lit(None).cast("int")
        for char, n in lx.CHINESE_DIGITS.items():
            out = F.when(F.substring(c, pos, 1) == char, F.lit(n)).otherwise(out)
        return out

    two = F.length(c) == 2
    return (
        F.when(c.rlike(r"^[0-9]+$"), F.coalesce(c.try_cast("int"), F.lit(0)))
        .when(digit.isNotNull(), digit)
        .when(two & (F.substring(c, 2, 1) == "十"), F.coalesce(value_of(1) * 10, F.lit(0)))
        .when(two & (F.substring(c, 1, 1) == "十"), F.lit(10) + F.coalesce(value_of(2), F.lit(0)))
        .otherwise(F.lit(0))
    )


def time_range(c: Column) -> Column:
    """First time-range phrase as "近N单位" or "YYYY年"; null without one."""
    found = F.struct(
        _chinese_number(F.regexp_extract(c, lx.TIME_RANGE_RE, 1)).alias("number"),
        F.regexp_extract(c, lx.TIME_RANGE_RE, 2).alias("raw"),
    )

    def phrase(p):
        number, raw = p["number"], p["raw"]
        unit = (
            F.when(raw == "个月", F.lit("月")).when(raw == "星期", F.lit("周")).when(raw == "日", F.lit("天")).otherwise(raw)
        )
        return (
            F.when((raw == "") | (number <= 0), F.lit(None).cast("string"))
            .when((unit == "年") & number.between(1000, 2999), F.concat(number.cast("string"), F.lit("年")))
            .otherwise(F.concat(F.lit("近"), number.cast("string"), unit))
        )

    return bind(found, phrase)


def growth_percent(current: Column, previous: Column) -> Column:
    """Change against the previous value in percent, two digits; null on zero or null."""
    return F.round((current - previous) / F.nullif(previous, F.lit(0.0)) * 100, 2)
