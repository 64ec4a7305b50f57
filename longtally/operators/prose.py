"""Indicator rows from running text.

Anchors are "增长 X%" and "下降 X%"; the eighty characters before an anchor name
the indicator and its value. One regular expression with a bounded look-behind
returns every window of a text, so texts are read whole and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import text

_N = lx.PROSE_LOOKBACK
_ANCHOR = r"(增长|下降)(?:了)?\s*(-?\d+(?:\.\d+)?)\s*%"
# the look-ahead comes first, so the look-behind is tried at anchors only
_WINDOWED = r"(?=增长|下降)(?<=(^.{0,%d}|.{%d}))" % (_N - 1, _N) + _ANCHOR
_AMOUNT = lx.PROSE_NUMBER_RE + r"\s*" + lx.PROSE_UNIT_RE
_GENERIC = lx.PROSE_GENERIC_RE + _AMOUNT


def anchors(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per anchor: window before it, direction, percentage and position."""
    carried = [c for c in texts.columns if c != column]
    flat = texts.select(*carried, text.squash(F.col(column)).alias("_flat"))
    group = lambda i: F.regexp_extract_all(F.col("_flat"), F.lit(_WINDOWED), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("window"), group(0).alias("anchor"))
    found = flat.select(*carried, F.posexplode(zipped).alias("position", "a"))
    return found.select(
        *carried, "position", "a.window", F.substring("a.anchor", 1, 2).alias("verb"),
        F.regexp_extract("a.anchor", r"(-?\d+(?:\.\d+)?)", 1).alias("percent"),
    )


def _known_name(window: Column) -> Column:
    """Indicator of the last listed pattern that occurs, null when none does."""
    out = F.lit(None).cast("string")
    for pattern, name in lx.PROSE_NAME_RULES:
        out = F.when(window.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def named_values(found: DataFrame) -> DataFrame:
    """Name, value and unit for each window; windows without a usable name are dropped."""
    window = F.col("window")
    amount = F.try_element_at(F.regexp_extract_all(window, F.lit(_AMOUNT), F.lit(0)), F.lit(-1))
    rows = found.withColumns({
        "_known": _known_name(window),
        "_amount": F.when(window.rlike(_AMOUNT), amount),
        "_generic": F.regexp_extract(window, _GENERIC, 0),
    })
    known = F.col("_known").isNotNull() & F.col("_amount").isNotNull()
    other = F.regexp_replace(F.regexp_extract("_generic", _GENERIC, 1), r"[，。、,：:]+$", "")
    usable = (F.length(other) >= 2) & ~other.rlike(lx.PROSE_STOP_RE)
    source = F.when(known, F.col("_amount")).when(usable, F.regexp_extract("_generic", _AMOUNT + "$", 0))
    rows = rows.withColumns({"indicator_name": F.when(known, F.col("_known")).when(usable, other), "_source": source})
    return rows.withColumns({
        "value": text.to_number(F.regexp_extract("_source", _AMOUNT, 1)), "unit": F.regexp_extract("_source", _AMOUNT, 2),
    }).filter(F.col("indicator_name").isNotNull()).drop("_known", "_amount", "_generic", "_source")


def extract_indicators(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Rows (indicator, value, unit, growth) per text; the first hit of a name counts.

    Rises are read before falls, each in text order.
    """
    growth = F.col("percent").cast("double")
    falls = F.col("verb") == "下降"
    rows = named_values(anchors(texts, column)).withColumn("growth_rate", F.when(falls, -growth).otherwise(growth))
    code = text.no_space(F.col("indicator_name"))
    order = F.struct(falls.alias("a"), F.col("position").alias("b"))
    carried = [c for c in texts.columns if c not in (key, column)]
    first = F.min_by(F.struct(*carried, "indicator_name", "value", "unit", "growth_rate"), order)
    return rows.groupBy(key, code.alias("indicator_code")).agg(first.alias("f")).select(key, "indicator_code", "f.*")
