from longtally import lexicon as lx
from longtally.sources import bridge as b
from .base import in_list, with_
from .governed import on_rows

SQL: dict[str, str] = {}
T = lx.TOTAL_REGION
SEC = in_list(lx.SECTOR_METRICS)
V = "v AS (SELECT * FROM long WHERE value IS NOT NULL)"
TREND = """CASE WHEN "first" IS NULL OR "last" IS NULL THEN 'flat' WHEN "last" > "first" * 1.05::DOUBLE THEN 'up' WHEN "last" < "first" * 0.95::DOUBLE THEN 'down' ELSE 'flat' END AS trend"""

SQL["conclude_trend"] = with_("long", f"""
, y AS (SELECT * FROM long WHERE "end" = (SELECT "end" FROM long ORDER BY year DESC, "end" DESC LIMIT 1))
SELECT *, {TREND} FROM (SELECT region, indicator_name, count(*) AS points, first(value ORDER BY year) AS "first", last(value ORDER BY year) AS "last" FROM y GROUP BY 1, 2)""")
SQL["conclude_trend_overall"] = with_("long", f"""
, s AS (SELECT *, year * 100 + "end" AS k FROM long)
SELECT *, {TREND} FROM (SELECT region, indicator_name, count(*) AS points, first(value ORDER BY k) AS "first", last(value ORDER BY k) AS "last" FROM s GROUP BY 1, 2)""")
SQL["conclude_top1"] = with_("long", f"""
, {V}, r AS (SELECT *, row_number() OVER w AS rn, lead(value) OVER w AS nxt FROM v WHERE region <> '{T}'
 WINDOW w AS (PARTITION BY period, indicator_name ORDER BY value DESC, region))
SELECT period, indicator_name, region AS name, value, round(value - nxt, 4) AS lead FROM r WHERE rn = 1""")
SQL["conclude_top1_overall"] = with_("raw", """
, r AS (SELECT indicator_name, value, row_number() OVER w AS rn, lead(value) OVER w AS nxt FROM raw WHERE value IS NOT NULL
 WINDOW w AS (ORDER BY value DESC, indicator_name))
SELECT indicator_name AS name, value, round(value - nxt, 4) AS lead FROM r WHERE rn = 1""")
SQL["conclude_share"] = with_("long", f"""
, {V} SELECT period, region, arg_max(indicator_name, {{'v': value, 'n': indicator_name}}) AS name, max(value) AS value,
 CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total,
 round(max(value) * 100 / CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 2) AS share FROM v WHERE indicator_name IN {SEC} GROUP BY 1, 2""")
SQL["conclude_compare"] = with_("long", f"""
, {V} SELECT period, indicator_name, arg_max(region, {{'v': value, 'n': region}}) AS high_name, max(value) AS high,
 arg_min(region, {{'v': value, 'n': region}}) AS low_name, min(value) AS low,
 round(CASE WHEN greatest(abs(max(value)), abs(min(value))) = 0 THEN 0 ELSE abs(max(value) - min(value)) / greatest(abs(max(value)), abs(min(value))) * 100 END, 2) AS gap
FROM v WHERE region <> '{T}' GROUP BY 1, 2 HAVING count(*) >= 2""")


def _anomaly(src: str, name: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
, m AS (SELECT *, CAST(sum(CAST(value AS DECIMAL(28,6))) OVER ({part}) AS DOUBLE) / count(*) OVER ({part}) AS mean FROM {src})
, r AS (SELECT *, row_number() OVER ({part} ORDER BY round(abs(value - mean), 6) DESC, {name}) AS rn FROM m)
SELECT {keys}{name} AS name, value, round(mean, 4) AS mean, round(abs(value - mean), 4) AS deviation FROM r WHERE rn = 1"""


SQL["conclude_anomaly"] = with_("long", f", {V}, z AS (SELECT * FROM v WHERE region <> '{T}' AND indicator_name IN {SEC})"
                                + _anomaly("z", "region", "period, indicator_name"))
SQL["conclude_anomaly_overall"] = with_("raw", ", z AS (SELECT * FROM raw WHERE value IS NOT NULL)" + _anomaly("z", "id", ""))
SQL["conclude_range"] = with_("raw", """
SELECT sheet_name, count(*) AS n, min(floor(value)) AS low, max(floor(value)) AS high,
 concat(CAST(min(floor(value)) AS BIGINT), ' ~ ', CAST(max(floor(value)) AS BIGINT)) AS range_text FROM raw GROUP BY 1""")
SQL["conclude_profile"] = with_("user_facts", """
SELECT age_group, arg_max(city, {'v': a, 'c': city}) AS name, CAST(max(a) AS BIGINT) AS value FROM (
 SELECT age_group, city, sum(active_user_count) AS a FROM user_facts GROUP BY 1, 2) GROUP BY 1""")
SQL["conclude_records"] = with_("records", "SELECT count(*) AS n, count(DISTINCT category) AS names FROM records")
SQL["row_name_and_number"] = with_("raw", """
SELECT id, coalesce(unit, period) AS name, coalesce(try_cast(sheet_name AS DOUBLE), growth_rate, value) AS number FROM raw""")

_FULL = r"^(\d{4})年(\d{1,2})-(\d{1,2})月$"


def _key(p: str) -> str:
    x = lambda r, g: f"CAST(regexp_extract({p}, '{r}', {g}) AS BIGINT)"
    return f"""CASE WHEN regexp_matches({p}, '{_FULL}') THEN {x(_FULL, 1)} * 100 + {x(_FULL, 3)}
 WHEN regexp_matches({p}, '^\\d{{4}}年$') THEN CAST(left({p}, 4) AS BIGINT) * 100 + 12
 WHEN regexp_matches({p}, '^1-\\d+月累计$') THEN {x('-([0-9]+)', 1)} WHEN {p} LIKE '%月末' THEN {x('^([0-9]+)', 1)} ELSE 9223372036854775807 END"""


def _tie(p: str) -> str:
    return f"CASE WHEN regexp_matches({p}, '{_FULL}') THEN 1 WHEN regexp_matches({p}, '^\\d{{4}}年$') THEN 0 WHEN {p} LIKE '第%' THEN 3 ELSE 2 END"


def _label(p: str) -> str:
    x = lambda r, g: f"CAST(regexp_extract({p}, '{r}', {g}) AS INT)"
    return f"""CASE WHEN regexp_matches({p}, '{_FULL}') THEN concat({x(_FULL, 1)}, '年', {x(_FULL, 2)}, '月-', {x(_FULL, 3)}, '月')
 WHEN {p} LIKE '1-%月累计' THEN concat('1月-', {x('-([0-9]+)', 1)}, '月累计') ELSE {p} END"""


SQL["axis_order"] = with_(["raw", "long"], f"""
SELECT period AS raw, {_label("period")} AS label, CAST(row_number() OVER (ORDER BY {_key("period")}, {_tie("period")}, period) AS INT) AS position
FROM (SELECT period FROM raw UNION SELECT period FROM long)""")
_TREND_ROWS = f"""
, g AS (SELECT * FROM long WHERE indicator_name = '地区生产总值' AND region <> '{T}' AND (value IS NOT NULL OR growth_rate IS NOT NULL))
, t AS (SELECT * FROM g WHERE "end" = (SELECT "end" FROM g ORDER BY year DESC, "end" DESC LIMIT 1))"""
SQL["chart_series"] = with_("long", _TREND_ROWS + f"""
SELECT region AS series, CAST(dense_rank() OVER (ORDER BY year) AS INT) AS position, {_label("period")} AS label, value FROM t""")
SQL["growth_overlay"] = with_("long", _TREND_ROWS + f"""
SELECT '增速（%）·' || region AS series, CAST(dense_rank() OVER (ORDER BY year) AS INT) AS position, {_label("period")} AS label, growth_rate AS value
FROM t WHERE growth_rate IS NOT NULL""")


def _gran(p: str) -> str:
    return f"""CASE WHEN regexp_matches({p}, '^(\\d{{4}}年)?\\d+-\\d+月(累计)?$') THEN
 CAST(regexp_extract({p}, '-([0-9]+)月', 1) AS INT) - CAST(regexp_extract({p}, '([0-9]+)-', 1) AS INT) + 1
 WHEN regexp_matches({p}, '^\\d{{4}}年$') THEN 12 END"""


SQL["granularity_guard"] = on_rows(f"""
, k AS (SELECT *, {_gran("period")} AS g FROM kept)
, best AS (SELECT g FROM k WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, min(id) LIMIT 1)
, f AS (SELECT id, period, g FROM k WHERE g = (SELECT g FROM best))
SELECT id, period, g AS granularity, (SELECT count(DISTINCT period) FROM f) AS points, (SELECT count(DISTINCT period) FROM f) < 3 AS few_points FROM f""")
SQL["period_granularity"] = with_("raw", f"SELECT period, {_gran('period')} AS months, count(*) AS n FROM raw GROUP BY 1, 2")
_PEAK = """
, p AS (SELECT region AS series, max(value) AS peak FROM long WHERE indicator_name = '地区生产总值' GROUP BY 1)"""
SQL["visible_series"] = with_("long", _PEAK + f"""
SELECT series, peak, series = '{T}' OR row_number() OVER (ORDER BY series = '{T}' DESC, peak DESC, series) <= 8 AS shown FROM p""")
SQL["dual_axis_split"] = with_("long", _PEAK + f"""
, l AS (SELECT list(peak ORDER BY peak DESC) AS ps FROM p), m AS (SELECT ps[1 + len(ps[2:]) // 2 + 1] AS median FROM l)
SELECT series, peak, median, peak / median >= 5 OR (series = '{T}' AND peak / median >= 3) AS split FROM p, m ORDER BY peak DESC LIMIT 1""")
SQL["pie_slices"] = with_("long", f"""
SELECT indicator_name AS name, value FROM long WHERE region = '{T}' AND indicator_name IN {SEC} AND (year, "end") = (
 SELECT (year, "end") FROM long WHERE region = '{T}' AND indicator_name IN {SEC} ORDER BY year DESC, "end" DESC LIMIT 1)""")
SQL["first_unit"] = with_("raw", "SELECT unit FROM raw WHERE coalesce(unit, '') <> '' ORDER BY id LIMIT 1")
SQL["shortened_texts"] = "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS short FROM documents"
SQL["plain_numbers"] = """
SELECT CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS printed, count(*) AS n
FROM (SELECT (o_orderkey % 1000) / 8.0::DOUBLE AS v FROM orders) GROUP BY 1"""
