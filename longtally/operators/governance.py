"""Name, region, unit and period governance of the raw long table.

Per-row rules are Column expressions and broadcast lookups of fixed tables, so
the raw rows stream through without a shuffle; only document-level and
sheet-level facts need an aggregate, and it is joined back on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import periods, text
from .aggregate import mode_per_group


def _lookup(df: DataFrame, key: Column, rows, out: str) -> DataFrame:
    """Left join of a fixed (key, value) table; ``out`` is null where nothing matched."""
    table = lx.lookup_frame(df.sparkSession, rows, "_k", out)
    return df.join(F.broadcast(table), key == F.col("_k"), "left").drop("_k")


def normalise_region(df: DataFrame, column: str = "region") -> DataFrame:
    """Blank-free region with its short or old name replaced by the clean name."""
    bare = text.no_space(F.col(column))
    out = _lookup(df.withColumn(column, bare), F.col(column), lx.REGION_CLEAN, "_region")
    return out.withColumn(column, F.coalesce("_region", column)).drop("_region")


def canonicalise(df: DataFrame, column: str, canonical: str = "canonical", status: str = "status") -> DataFrame:
    """Resolve a name: manual table, official name or alias, wrapper and verb stripping.

    ``status`` is ``keep`` (the cleaned name is the result), ``remap`` (an official
    name was found) or ``noise`` (a sentence; the result is '').
    """
    aliases = lx.alias_pairs()
    raw = text.trim_blanks(F.col(column))
    unwrapped = text.strip_wrapper(raw)
    deverbed = text.strip_wrapper(text.strip_verbs(raw))
    key = lambda c: text.strip_rank(text.normalise_name(c))
    out = _lookup(df, raw, lx.MANUAL_NAMES, "_manual")
    out = _lookup(out, key(raw), aliases, "_direct")
    out = _lookup(out, key(unwrapped), aliases, "_unwrapped")
    out = _lookup(out, key(deverbed), aliases, "_deverbed")
    kept = lambda hit, c: F.when(F.col(hit) == text.normalise_name(c), F.lit("keep")).otherwise(F.lit("remap"))

    def decide(manual, direct, unwrap, deverb, nothing, cleaned):
        return (
            F.when(raw == "", nothing)
            .when(F.col("_manual").isNotNull(), manual)
            .when(F.col("_direct").isNotNull(), direct)
            .when(F.col("_unwrapped").isNotNull(), unwrap)
            .when(text.is_noise_sentence(raw) & F.col("_deverbed").isNotNull(), deverb)
            .when(text.is_noise_sentence(raw), nothing)
            .otherwise(cleaned)
        )

    return out.withColumns({
        canonical: decide(F.col("_manual"), F.col("_direct"), F.col("_unwrapped"), F.col("_deverbed"), F.lit(""), text.normalise_name(raw)),
        status: decide(F.lit("remap"), kept("_direct", raw), kept("_unwrapped", unwrapped), F.lit("remap"), F.lit("noise"), F.lit("keep")),
    }).drop("_manual", "_direct", "_unwrapped", "_deverbed")


def canonicalise_indicator(df: DataFrame, column: str, canonical: str = "canonical", status: str = "status") -> DataFrame:
    """``canonicalise`` with the rank suffix kept and a trailing unit bracket retried."""
    name = F.col(column)
    is_rank = F.endswith(name, F.lit(lx.RANK_SUFFIX))
    has_unit = ~is_rank & name.rlike(lx.NAME_UNIT_TAIL_RE)
    base = (
        F.when(is_rank, F.regexp_replace(name, lx.RANK_SUFFIX + "$", ""))
        .when(has_unit, F.regexp_replace(name, lx.NAME_UNIT_TAIL_RE, ""))
        .otherwise(name)
    )
    out = canonicalise(df.withColumn("_base", base), "_base", "_b_name", "_b_status")
    out = canonicalise(out, column, "_f_name", "_f_status")
    found = F.col("_b_name") != ""
    ranked = is_rank & found
    retried = has_unit & found & (F.col("_b_status") != "noise")
    return out.withColumns({
        canonical: F.when(ranked, F.concat("_b_name", F.lit(lx.RANK_SUFFIX)))
        .when(is_rank, text.normalise_name(name)).when(retried, F.col("_b_name")).otherwise(F.col("_f_name")),
        status: F.when(ranked, "remap").when(is_rank, "keep").when(retried, F.col("_b_status")).otherwise(F.col("_f_status")),
    }).drop("_base", "_b_name", "_b_status", "_f_name", "_f_status")


def remap_audit(df: DataFrame, column: str = "indicator_name") -> DataFrame:
    """Every distinct name with its canonical name, status and row count."""
    names = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return canonicalise(names, column)


def alias_dictionary(audit: DataFrame, column: str = "indicator_name") -> DataFrame:
    """Accepted spellings per canonical name, one row per spelling, from the audited distinct names."""
    return audit.filter(F.col("canonical") != "").select("canonical", F.col(column).alias("alias"), "rows")


def _trade_in_dollars() -> Column:
    name = F.col("indicator_name")
    trade = F.contains(name, F.lit("出口")) | F.contains(name, F.lit("进口"))
    dollars = F.contains(name, F.lit("万美元")) | (text.trim_blanks(F.coalesce("unit", F.lit(""))) == "万美元")
    return trade & dollars


def usd_documents(raw: DataFrame) -> DataFrame:
    """Documents that publish trade figures in US dollars."""
    return raw.filter(_trade_in_dollars()).select("doc_id").distinct()


def sheet_major(raw: DataFrame) -> DataFrame:
    """(document, sheet) -> its only ordinary indicator name, where there is just one."""
    rules = name_rules(raw.select("sheet_name", "indicator_name").distinct())
    facts = _sheet_facts(raw.join(rules, ["sheet_name", "indicator_name"]))
    return facts.filter(F.col("major").isNotNull()).select("doc_id", "sheet_name", "major")


def _sheet_facts(rows: DataFrame) -> DataFrame:
    """Per (document, sheet): its only ordinary name, if there is one, and whether it trades in dollars.

    "Only one" is min == max, so no set of names is ever collected.
    """
    ordinary = F.col("block_name").isNull() & F.col("row_region").isNull() & ~F.col("is_rank")
    own = F.when(ordinary, F.col("ind"))
    facts = rows.groupBy("doc_id", "sheet_name").agg(
        F.min(own).alias("ind"), F.max(own).alias("_last"),
        F.min(F.when(ordinary, F.col("ind_canonical"))).alias("_name"),
        F.max(F.when(_trade_in_dollars(), 1).otherwise(0)).alias("_dollars"),
    )
    single = F.col("ind") == F.col("_last")
    return facts.select(
        "doc_id", "sheet_name", F.when(single, F.col("ind")).alias("major"), F.when(single, F.col("_name")).alias("_major"), "_dollars"
    )


def _map_of(pairs: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


def name_rules(names: DataFrame) -> DataFrame:
    """Everything that follows from a (sheet, name) pair, worked out once per pair.

    The regular expressions and alias lookups run on distinct pairs; rows then
    pick the result up with one join.
    """
    sheet, name, ind = F.col("sheet_name"), F.col("indicator_name"), F.col("ind")
    out = names.withColumn("ind", text.normalise_name(name))
    invest = sheet.isin(lx.INVEST_SHEETS) & ~F.contains(ind, F.lit("投资")) & ~ind.isin(lx.INVEST_KEEP)
    town = F.regexp_replace(ind, "^按地区分[:：]城镇$", "城镇")
    retail = sheet.isin(lx.RETAIL_SHEETS)
    named = (
        F.when(invest, F.concat(ind, F.lit("投资")))
        .when(retail & town.isin(lx.RETAIL_NAMES) & ~F.contains(town, F.lit("零售额")), F.concat(town, F.lit("零售额")))
        .when(retail, town)
        .otherwise(ind)
    )
    out = canonicalise_indicator(out.withColumn("_named", named), "_named", "_canon", "_status")
    out = canonicalise(out, "ind", "_ind_canon", "_ind_status")
    noise_kept = F.when(
        (F.col("_status") == "noise") & (F.col("_canon") == ""), F.regexp_replace("_named", r"^其中[:：]\s*", "")
    ).otherwise(F.col("_canon"))
    city = sheet.isin(list(lx.CITY_SHEETS))
    return out.select(
        "sheet_name", "indicator_name", "ind",
        F.endswith(name, F.lit(lx.RANK_SUFFIX)).alias("is_rank"),
        F.when(city, _map_of(lx.CITY_SHEETS, sheet)).alias("city_name"),
        F.when(sheet.isin(list(lx.BALANCE_SHEETS)), _map_of(lx.BALANCE_SHEETS, sheet)).alias("balance_name"),
        F.when(ind.isin(lx.ECONOMIC_BLOCKS), ind).alias("block_name"),
        F.when(ind.isin(list(lx.REGION_ROW)), _map_of(lx.REGION_ROW, ind)).alias("row_region"),
        F.coalesce(F.nullif("_ind_canon", F.lit("")), ind).alias("ind_canonical"),
        F.concat(ind, F.lit("("), sheet, F.lit(")")).alias("marked"),
        noise_kept.alias("soft_name"),
        (F.col("_status") == "noise").alias("is_noise"),
        ((noise_kept == "") | noise_kept.isin(lx.POLLUTED_NAMES)).alias("is_polluted"),
        F.contains(name, F.lit("万美元")).alias("says_usd"),
        (~F.contains(name, F.lit("地方")) & F.contains(name, F.lit("一般公共预算收入"))).alias("whole_budget"),
    )


def label_rules(raw: DataFrame, accept_year_only: bool = False) -> DataFrame:
    """Period, region and unit labels of the rows (kind, label) with what their text alone decides.

    ``own`` is the clean label, ``rest`` the months of a period that takes its document's year. The patterns run
    on distinct labels; one pass finds those of all three columns, folded on the map side.
    """
    kinds = ["period", "region", "unit"]
    found = raw.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in kinds])))
    own, rest = periods.label_parts(F.col("label"), accept_year_only)
    clean = (
        F.when(F.col("kind") == "period", own).when(F.col("kind") == "region", text.no_space(F.col("label")))
        .otherwise(text.trim_blanks(F.col("label")))
    )
    rest = F.when(F.col("kind") == "period", rest)
    return found.filter(F.col("label").isNotNull()).distinct().select("kind", "label", clean.alias("own"), rest.alias("rest"))


def standardise(
    raw: DataFrame, docs: DataFrame, rules: DataFrame | None = None, accept_year_only: bool = False, labels: DataFrame | None = None
) -> DataFrame:
    """All row rules in one frame: kept rows have ``drop_reason`` null.

    Output keeps the source name as ``source_name`` and lists what was done in
    ``note``. Sheet semantics come first, then period and region, then the name,
    then currency, caliber and unit scale. ``rules`` and ``labels`` may be stored
    ``name_rules`` and ``label_rules`` tables (``labels`` made with the same
    ``accept_year_only``), whose known size lets Spark decide on broadcasting them.
    No pattern runs on a row: a filter on the result would run it again.
    """
    if rules is None:
        rules = name_rules(raw.select("sheet_name", "indicator_name").distinct())
    if labels is None:
        labels = label_rules(raw, accept_year_only)
    # null-safe: a row without a name or a sheet is kept and gets its reason below
    named = rules.withColumnsRenamed({"sheet_name": "_sheet", "indicator_name": "_raw_name"})
    rows = raw.join(
        named, F.col("sheet_name").eqNullSafe(F.col("_sheet")) & F.col("indicator_name").eqNullSafe(F.col("_raw_name")), "left"
    ).drop("_sheet", "_raw_name")
    # sheet and document facts meet on the small (document, sheet) table, so the rows
    # themselves are shuffled once
    sheets = _sheet_facts(rows).drop("major")
    usd = sheets.groupBy("doc_id").agg(F.max("_dollars").alias("_doc_dollars"))
    dated = docs.select("doc_id", F.year("doc_date").alias("_year"))
    facts = sheets.join(usd, "doc_id").join(dated, "doc_id", "left").select(
        "doc_id", "sheet_name", "_major", (F.col("_doc_dollars") == 1).alias("_usd"), "_year"
    )
    rows = rows.join(facts, ["doc_id", "sheet_name"], "left")
    for kind, columns in (("period", ["_own", "_rest"]), ("region", ["_bare"]), ("unit", ["_trimmed"])):
        values = [F.col(c).alias(to) for c, to in zip(["own", "rest"], columns)]
        one = labels.filter(F.col("kind") == kind).select(F.col("label").alias("_label"), *values)
        rows = rows.join(one, F.col(kind) == F.col("_label"), "left").drop("_label")
    bare, trimmed = F.col("_bare"), F.coalesce("_trimmed", F.lit(""))
    ind, major = F.col("ind"), F.col("_major")
    mode = (
        F.when(F.col("city_name").isNotNull(), "city sheet")
        .when(F.col("balance_name").isNotNull(), "balance sheet")
        .when(F.col("block_name").isNotNull(), F.when(major.isNotNull(), "block row").otherwise("block row without major"))
        .when((bare == lx.TOTAL_REGION) & F.col("row_region").isNotNull(), "region row")
    )
    rows = rows.withColumn("_mode", mode)
    is_mode = lambda *modes: F.coalesce(F.col("_mode").isin(*modes), F.lit(False))
    balance = is_mode("balance sheet")
    rows = rows.withColumns({
        "_fixed": F.when(F.col("_mode").isNotNull(), F.coalesce("city_name", "balance_name", "_major", "marked")),
        "_region": F.when(is_mode("city sheet", "block row") | (balance & (ind == "城步县")), ind)
        .when(is_mode("region row"), F.col("row_region")).otherwise(bare),
        "_unit": F.when(balance, F.lit("亿元")).otherwise(trimmed),
        "_period": periods.completed_label(F.col("_own"), F.col("_rest"), F.col("_year")),
    })
    rows = _lookup(rows, F.col("_region"), lx.REGION_CLEAN, "_clean_region")

    # trade figures in dollars stay apart from the yuan series, whole-budget names of
    # one year belong to the total-revenue series
    free = F.col("_mode").isNull()
    plain_name = F.coalesce("_fixed", "soft_name")
    in_dollars = [f"{n}（万美元）" for n in lx.TRADE_NAMES]
    own_dollars = trimmed == "万美元"
    usd = (free | is_mode("region row")) & plain_name.isin(lx.TRADE_NAMES + in_dollars) & (
        F.coalesce("_usd", F.lit(False)) | F.col("says_usd") | own_dollars
    )
    budget = free & F.col("whole_budget") & plain_name.isin("一般公共预算收入", "一般公共预算收入" + lx.RANK_SUFFIX)
    rows = rows.withColumns({"_usd_split": usd, "_budget": budget, "_plain": plain_name})
    rows = rows.withColumn(
        "_name",
        F.when(F.col("_usd_split") & F.col("_plain").isin(lx.TRADE_NAMES), F.concat("_plain", F.lit("（万美元）")))
        .when(F.col("_budget"), F.replace(F.col("_plain"), F.lit("一般公共预算收入"), F.lit("财政总收入")))
        .otherwise(F.col("_plain")),
    )
    unit = F.when(F.col("_usd_split"), F.lit("万美元")).otherwise(F.col("_unit"))
    scalable = F.col("_name").isin(lx.WAN_TO_YI_NAMES)
    scaled = F.coalesce((F.col("unit") == "万元") & scalable & F.col("value").isNotNull(), F.lit(False))
    reason = (
        F.when(ind == "", "empty name").when(F.col("_period").isNull(), "period unknown")
        .when(free & F.col("is_polluted"), "polluted name")
    )
    tags = F.array(
        F.col("_mode"), F.when(free & F.col("is_noise"), "noise kept"), F.when(F.col("_usd_split"), "dollar split"),
        F.when(F.col("_budget"), "whole-budget caliber"), F.when(scaled, "scaled to 亿元"),
    )
    return rows.select(
        "id", "doc_id", F.col("_period").alias("period"), F.coalesce("_clean_region", "_region").alias("region"),
        F.col("_name").alias("indicator_name"), F.col("indicator_name").alias("source_name"),
        F.when(scaled, F.col("value") / 10000.0).otherwise(F.col("value")).alias("value"),
        F.when(scaled | (scalable & (unit == "")), F.lit("亿元")).otherwise(unit).alias("unit"),
        F.when(~balance, F.col("growth_rate")).alias("growth_rate"),
        "sheet_name", "source_type", "confidence", F.array_join(tags, ";").alias("note"), reason.alias("drop_reason"),
    )


def split_standardised(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped side of ``standardise``."""
    kept = rows.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    return kept, rows.filter(F.col("drop_reason").isNotNull())


def drop_polluted(df: DataFrame, column: str = "indicator_name") -> DataFrame:
    """Remove rows whose indicator name is a region, city or total label."""
    table = lx.lookup_frame(df.sparkSession, [(n,) for n in lx.POLLUTED_NAMES], "_polluted")
    return df.join(F.broadcast(table), text.no_space(F.col(column)) == F.col("_polluted"), "left_anti")


def recalibrate(df: DataFrame) -> DataFrame:
    """Variant names to the latest name, one unit per series, suspect values left alone."""
    name, value = F.col("indicator_name"), F.col("value")
    out = _lookup(df, name, lx.VARIANT_NAMES, "_new")
    out = _lookup(out, name, lx.VARIANT_UNITS, "_new_unit")
    out = out.withColumn("_name", F.coalesce("_new", "indicator_name"))
    out = _lookup(out, F.col("_name"), lx.RECALIBER_UNITS, "_rule_unit")
    value = F.when(name.isin(lx.VARIANT_SCALED), value / 10000.0).otherwise(value)
    value = F.when(F.col("_name").isin(lx.RECALIBER_SCALED), value / 10000.0).otherwise(value)
    suspect = F.coalesce((F.col("_name") == lx.SUSPECT_NAME) & (value > lx.SUSPECT_LIMIT), F.lit(False))
    unit = F.when(suspect, F.coalesce("_new_unit", "unit")).otherwise(F.coalesce("_rule_unit", "_new_unit", "unit"))
    action = (
        F.when(suspect, "suspect value").when(F.col("_new").isNotNull(), "renamed")
        .when(F.col("_rule_unit").isNotNull(), "unit set").otherwise("unchanged")
    )
    return out.withColumns({
        "value": value, "unit": unit, "indicator_name": F.col("_name"), "action": action,
        "renamed_from": F.when(F.col("_new").isNotNull(), name),
    }).drop("_new", "_new_unit", "_name", "_rule_unit")


def repair_region_in_name(df: DataFrame) -> DataFrame:
    """"区域(45贸外处4)" read as an indicator -> region plus indicator, unit 万元."""
    name = F.col("indicator_name")
    marker = F.lit(None).cast("string")
    for sheet_mark, indicator in lx.REGION_IN_NAME.items():
        marker = F.when(F.contains(name, F.lit(f"({sheet_mark})")), indicator).otherwise(marker)
    out = df.withColumn("_ind", marker)
    hit = F.col("_ind").isNotNull()
    return out.withColumns({
        "region": F.when(hit, F.regexp_extract(name, r"^([^(]*)\(", 1)).otherwise(F.col("region")),
        "unit": F.when(hit, "万元").otherwise(F.col("unit")),
        "indicator_code": F.when(hit, F.col("_ind")).otherwise(F.col("indicator_code")),
        "indicator_name": F.coalesce("_ind", "indicator_name"),
    }).drop("_ind")


def complete_units(df: DataFrame) -> DataFrame:
    """Fill blank units only: growth-only rows %, ranks 名, then the indicator's own unit."""
    blank = F.coalesce("unit", F.lit("")) == ""
    out = _lookup(df, F.col("indicator_name"), lx.UNIT_OF_INDICATOR | lx.UNIT_OF_PART, "_known")
    filled = (
        F.when(~blank, F.col("unit"))
        .when(F.col("value").isNull() & F.col("growth_rate").isNotNull(), "%")
        .when(F.contains(F.col("indicator_name"), F.lit(lx.RANK_SUFFIX)), "名")
        .otherwise(F.coalesce("_known", "unit"))
    )
    source = (
        F.when(~blank, "own").when(F.col("value").isNull() & F.col("growth_rate").isNotNull(), "growth only")
        .when(F.contains(F.col("indicator_name"), F.lit(lx.RANK_SUFFIX)), "rank")
        .when(F.col("_known").isNotNull(), "indicator").otherwise("missing")
    )
    return out.withColumns({"unit": filled, "unit_source": source}).drop("_known")


def complete_units_from_data(df: DataFrame) -> DataFrame:
    """Fill blank units from the bracket in the name, then the indicator's mode, then name rules.

    The mode table is joined without a hint: its size is that of the name list.
    """
    own = F.nullif(text.trim_blanks(F.coalesce("unit", F.lit(""))), F.lit(""))
    modes = mode_per_group(df, "indicator_name", "unit").withColumnRenamed("unit", "_mode")
    out = df.join(modes, "indicator_name", "left")
    bracket = F.nullif(text.paren_unit(F.col("indicator_name")), F.lit(""))
    ruled = F.nullif(text.unit_by_name(F.col("indicator_name")), F.lit(""))
    source = (
        F.when(own.isNotNull(), "own").when(bracket.isNotNull(), "bracket")
        .when(F.col("_mode").isNotNull(), "mode").when(ruled.isNotNull(), "rule").otherwise("missing")
    )
    return out.withColumns({
        "unit_source": source, "unit": F.coalesce(own, bracket, F.col("_mode"), ruled)
    }).drop("_mode")


def with_derived_totals(long: DataFrame, totals: dict | None = None, region: str = lx.TOTAL_REGION) -> DataFrame:
    """Totals missing at a period = sum of the parts present there, with growth on the year before.

    Returns only the derived rows. Parts are added per period in one aggregate;
    existing totals remove periods through an anti join.
    """
    totals = lx.DERIVED_TOTALS if totals is None else totals
    pairs = [(part, total, unit, i) for total, (parts, unit) in totals.items() for i, part in enumerate(parts)]
    table = lx.lookup_frame(long.sparkSession, pairs, "_part", "_total", "_unit", "_i")
    here = long.filter((F.col("region") == region) & F.col("value").isNotNull())
    sums = (
        here.join(F.broadcast(table), F.col("indicator_name") == F.col("_part"))
        .groupBy("year", "start", "end", "period", "region", F.col("_total").alias("indicator_name"), F.col("_unit").alias("unit"))
        .agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"),
             F.max(F.when(F.col("_i") == 0, 1).otherwise(0)).alias("_lead"))
        .filter("_lead = 1").drop("_lead")
    )
    known = here.filter(F.col("indicator_name").isin(list(totals))).select(
        "year", "start", "end", "region", "indicator_name", "value"
    )
    derived = sums.join(known, ["year", "start", "end", "region", "indicator_name"], "left_anti")
    before = known.select(
        (F.col("year") + 1).alias("year"), "start", "end", "region", "indicator_name", F.col("value").alias("_before")
    )
    return derived.join(before, ["year", "start", "end", "region", "indicator_name"], "left").select(
        "period", "region", "indicator_name", "value", "unit",
        periods.growth_percent(F.col("value"), F.col("_before")).alias("growth_rate"),
    )
