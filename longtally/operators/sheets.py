"""Sheet grids (cells) to indicator rows.

A grid is a long frame (doc_id, doc_title, doc_date, sheet, row, col, text).
Three layouts are read: region tables, four-column indicator tables and
three-column growth tables. Headers are at most the first twelve filled rows, so
everything decided per sheet comes from a bounded slice, limited before the
shuffle; the data cells are then joined with one row of decisions per sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions import periods, text

SHEET = ["doc_id", "sheet"]
_MONTHS_CELL = rf"^(?:20\d{{2}})?年?{text.BLANK}*\d{{1,2}}-?\d*月"


def filled_cells(cells: DataFrame) -> DataFrame:
    """Non-empty cells of the sheets that hold data."""
    blank_prefix = rf"^{text.BLANK}*(?:{'|'.join(lx.SKIPPED_SHEET_PREFIXES)})"
    # Tests that end at the first character; filters on trimmed text would trim every cell twice.
    out = cells.filter(F.col("text").rlike(rf"[^\s{text.OTHER_BLANKS}]") & ~F.col("sheet").rlike(blank_prefix))
    return out.withColumn("text", text.trim_blanks(F.col("text")))


def header_cells(cells: DataFrame) -> DataFrame:
    """Cells of the first twelve filled rows with ``index`` and ``is_header``."""
    by_row = Window.partitionBy(*SHEET).orderBy("row")
    head = cells.withColumn("index", F.dense_rank().over(by_row)).filter(F.col("index") <= lx.HEADER_ROWS)
    one_row = Window.partitionBy(*SHEET, "row").orderBy("col").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    rest = text.no_space(F.array_join(F.collect_list(F.when(F.col("col") >= 1, F.col("text"))).over(one_row), ""))
    axis = F.max(F.when(F.col("col") == 0, text.no_space(F.col("text")))).over(one_row)
    words = sorted({*lx.HEADER_WORDS, *lx.RANK_WORDS, *lx.GROWTH_WORDS})
    is_header = F.coalesce(axis.isin(lx.AXIS_WORDS), F.lit(False)) | rest.rlike("|".join(words))
    return head.withColumn("is_header", is_header)


def header_columns(header: Column) -> Column:
    """Array of header columns: joined header, own year, role and whether cumulative.

    ``header`` is the sheet's sorted array of header cells; a column of the sheet is
    one element, so all of this is array work without a shuffle.
    """
    columns = F.array_distinct(F.transform(F.filter(header, lambda x: x["col"] >= 1), lambda x: x["col"]))
    with_year = r"20\d{2}年"

    def joined(c):
        texts = F.transform(F.filter(header, lambda x: x["col"] == c), lambda x: text.no_space(x["text"]))
        years = F.filter(texts, lambda t: t.rlike(with_year))
        return F.struct(
            c.alias("col"), F.array_join(texts, "").alias("header"),
            F.regexp_extract(F.get(years, F.lit(0)), r"(20\d{2})年", 1).alias("year"),
        )

    def judged(x):
        h = x["header"]
        role = (
            F.when(h.rlike("|".join(lx.RANK_WORDS)), "rank")
            .when(h.rlike("|".join(lx.GROWTH_WORDS)) & ~F.contains(h, F.lit("额")), "growth")
            .otherwise("value")
        )
        return F.struct(x["col"].alias("col"), h.alias("header"), x["year"].alias("year"), role.alias("role"),
                        h.rlike("累计|本年").alias("cumulative"))

    return F.transform(F.transform(columns, joined), judged)


def sheet_layout(cells: DataFrame) -> DataFrame:
    """Decisions per sheet: title, period, value/growth/rank columns, unit, first data row.

    One shuffle: the header slice is gathered per sheet (at most twelve rows), the
    rest is array expressions on that slice.
    """
    head = header_cells(cells)
    col, row, is_header = F.col("col"), F.col("row"), F.col("is_header")
    gathered = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.struct("row", "col", "text"))))
    facts = head.groupBy(*SHEET).agg(
        F.min("doc_title").alias("doc_title"), F.min("doc_date").alias("doc_date"),
        F.min_by("text", F.when(col == 0, row)).alias("title"),
        F.max(F.when(is_header, row)).alias("last_header"),
        gathered(is_header).alias("_header"), gathered(F.col("index") <= lx.UNIT_ROWS).alias("_first"),
    )
    words = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " ")
    matrix = text.no_space(words(F.col("_header"))).rlike("|".join(lx.MATRIX_WORDS))
    out = facts.filter(F.col("last_header").isNotNull() & ~matrix)
    out = out.withColumn("_columns", header_columns(F.col("_header")))
    stated_cell = F.filter("_header", lambda x: (x["col"] >= 1) & x["text"].rlike(_MONTHS_CELL))
    smallest = lambda keep: F.array_min(F.transform(F.filter("_columns", keep), lambda x: x["col"]))
    is_value = lambda x: x["role"] == "value"
    out = out.withColumns({
        "_p": F.get(stated_cell, F.lit(0)),
        "value_col": F.coalesce(smallest(lambda x: is_value(x) & x["cumulative"]), smallest(is_value)),
        "growth_col": smallest(lambda x: x["role"] == "growth"),
        "rank_col": smallest(lambda x: x["role"] == "rank"),
        "_units": words(F.col("_first")),
    })
    column = lambda c: F.get(F.filter("_columns", lambda x: x["col"] == c), F.lit(0))
    year = periods.year_from_title(F.col("doc_title"), F.col("doc_date")).cast("string")
    own_year = F.regexp_extract(F.col("_p.text"), r"^(20\d{2})", 1)
    blank = F.lit("")
    out = out.withColumns({
        "_value_header": column(F.col("value_col"))["header"], "_year": year,
        "_p_year": F.coalesce(F.nullif(own_year, blank), F.nullif(column(F.col("_p.col"))["year"], blank), year),
    })
    from_title = r"^(20\d{2})年(\d{1,2})月"
    title = text.trim_blanks(F.col("doc_title"))
    fallback = F.when(
        title.rlike(from_title),
        F.concat(F.regexp_extract(title, from_title, 1), F.lit("年1-"), F.regexp_extract(title, from_title, 2), F.lit("月")),
    ).otherwise(F.concat("_year", F.lit("年")))
    bracket = F.nullif(text.paren_unit(F.col("_value_header")), blank)
    stated_unit = F.nullif(F.regexp_extract("_units", rf"单位[：:]{text.BLANK}*([\x{{4e00}}-\x{{9fa5}}%a-zA-Z]+)", 1), blank)
    stated = periods.extraction_label(F.col("_p.text"), F.col("_p_year"))
    return out.select(
        *SHEET, "title", F.when(F.col("_p").isNotNull(), stated).otherwise(fallback).alias("period"),
        "value_col", "growth_col", "rank_col", "last_header", F.coalesce(bracket, stated_unit, blank).alias("unit"),
    )


def indicator_rows(cells: DataFrame) -> DataFrame:
    """Indicator rows of all sheets: name, region, period, value, unit and growth.

    Region tables take the sheet title as indicator and give ranks rows of their
    own; other tables take the first column as indicator of the total region.
    """
    cells = filled_cells(cells)
    sheet_name = F.coalesce(F.nullif(text.clean_title_numbering(F.col("title")), F.lit("")), F.lit("统计指标"))
    layout = sheet_layout(cells).withColumn("_sheet_name", sheet_name)  # once per sheet, not per row
    col = F.col("col")
    number = lambda c: F.max(F.when(col == F.col(c), text.to_number(F.col("text"))))
    rows = (
        cells.select(*SHEET, "row", "col", "text").join(layout, SHEET)
        .filter((F.col("row") > F.col("last_header")) & (
            (col == 0) | (col == F.col("value_col")) | (col == F.col("growth_col")) | (col == F.col("rank_col"))))
        .groupBy(*SHEET, "row", "_sheet_name", "period", "unit")
        .agg(
            F.max(F.when(col == 0, F.col("text"))).alias("axis"),
            number("value_col").alias("value"), number("growth_col").alias("growth_rate"), number("rank_col").alias("rank"),
        )
        .filter(F.col("axis").isNotNull())
    )
    regions = lx.lookup_frame(cells.sparkSession, lx.REGION_AXIS, "_axis", "_region")
    rows = rows.join(F.broadcast(regions), text.no_space(F.col("axis")) == F.col("_axis"), "left")
    in_region = F.col("_region").isNotNull()
    name = F.when(in_region, F.col("_sheet_name")).otherwise(text.clean_title_numbering(F.col("axis")))
    nothing = F.lit(None).cast("double")

    def record(indicator: Column, value: Column, unit: Column, growth: Column) -> Column:
        return F.struct(indicator.alias("indicator_name"), value.alias("value"), unit.alias("unit"), growth.alias("growth_rate"))

    own = F.when(
        F.col("value").isNotNull() | F.col("growth_rate").isNotNull(),
        record(name, F.col("value"), F.when(F.col("value").isNotNull(), F.col("unit")), F.col("growth_rate")),
    )
    rank = F.when(
        in_region & F.col("rank").isNotNull(),
        record(F.concat("_sheet_name", F.lit(lx.RANK_SUFFIX)), F.col("rank"), F.lit("名"), nothing),
    )
    return rows.select(
        "doc_id", F.col("sheet").alias("sheet_name"), "row", "period",
        F.coalesce("_region", F.lit(lx.TOTAL_REGION)).alias("region"),
        F.inline(F.filter(F.array(own, rank), lambda x: x.isNotNull())),
    )
