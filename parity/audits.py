from longtally import lexicon as lx
from .base import in_list, quote, values, with_
from .governed import on_clean, on_rows

SQL: dict[str, str] = {}
T = lx.TOTAL_REGION
RANK = lx.RANK_SUFFIX

_UNIVERSE = """
, pp AS (SELECT *, CAST(regexp_extract(period, '^(\\d{4})年', 1) AS INT) AS yr, CAST(regexp_extract(period, '-(\\d+)月$', 1) AS INT) AS em FROM merged)
, uni AS (SELECT DISTINCT indicator_name FROM pp WHERE (yr, em) = (SELECT (yr, em) FROM pp ORDER BY yr DESC, em DESC LIMIT 1))
"""
SQL["coverage_curve"] = on_clean(_UNIVERSE + """
SELECT yr AS year, count(DISTINCT indicator_name) AS hits, (SELECT count(*) FROM uni) AS universe,
 round(count(DISTINCT indicator_name)::DOUBLE / (SELECT count(*) FROM uni), 4) AS coverage
FROM pp WHERE indicator_name IN (SELECT indicator_name FROM uni) GROUP BY 1""")
SQL["leftovers"] = on_clean(f"""
, cc AS (SELECT *, substr(period, 1, 4) AS y FROM merged)
SELECT indicator_name, CASE WHEN indicator_name IN {in_list(lx.TRAP_NAMES)} THEN 'VARIANT'
 WHEN regexp_matches(indicator_name, '^(总计中：|其中：|其中:)') OR indicator_name IN {in_list(lx.LEFTOVER_NOISE_NAMES)} THEN 'NOISE' ELSE 'DISCONTINUED' END AS status,
 count(*) AS rows, string_agg(DISTINCT y, ',' ORDER BY y) AS years
FROM cc GROUP BY 1 HAVING max(y) < (SELECT max(y) FROM cc) OR indicator_name IN {in_list(lx.TRAP_NAMES)}""")
SQL["latest_universe_in_years"] = on_clean(_UNIVERSE + """
SELECT DISTINCT substr(period, 1, 4) AS year, indicator_name FROM merged WHERE indicator_name IN (SELECT indicator_name FROM uni)""")
SQL["not_in_latest_year"] = with_("raw", """
SELECT region, indicator_name FROM raw EXCEPT SELECT region, indicator_name FROM raw WHERE period LIKE '2001年1-9%'""")
SQL["in_both_years"] = with_("raw", """
SELECT region, indicator_name FROM raw WHERE period LIKE '1997年%' INTERSECT SELECT region, indicator_name FROM raw WHERE period LIKE '2000年%'""")


def _sanity(src: str, keys: str, concat: str, metrics) -> str:
    spread = "\n".join(
        f"WHEN max(CASE WHEN {m} > 0 THEN {m} END) / min(CASE WHEN {m} > 0 THEN {m} END) >= 5000 THEN " for m in metrics)
    names = "CASE " + " ".join(
        f"WHEN max(CASE WHEN {m} > 0 THEN {m} END) / min(CASE WHEN {m} > 0 THEN {m} END) >= 5000 THEN '{m}'" for m in metrics) + " END"
    sizes = "CASE " + " ".join(
        f"WHEN max(CASE WHEN {m} > 0 THEN {m} END) / min(CASE WHEN {m} > 0 THEN {m} END) >= 5000 THEN round(max(CASE WHEN {m} > 0 THEN {m} END) / min(CASE WHEN {m} > 0 THEN {m} END))"
        for m in metrics) + " END"
    return f"""
, src AS ({src})
, agg AS (SELECT count(*) AS n, count(CASE WHEN coalesce(trim(period), '') = '' THEN 1 END) AS blank, count(growth_rate) AS g, {names} AS mc, {sizes} AS ms FROM src)
, dup AS (SELECT CAST(sum(c - 1) AS BIGINT) AS extra, min({concat}) AS ex FROM (SELECT *, count(*) AS c FROM src GROUP BY ALL HAVING count(*) > 1))
SELECT 'empty result' AS check_name, NULL AS column_name, n, NULL AS detail FROM agg WHERE n = 0
UNION ALL SELECT 'blank time', 'period', blank, NULL FROM agg WHERE n > 0 AND blank > 0
UNION ALL SELECT 'magnitude', mc, CAST(ms AS BIGINT), NULL FROM agg WHERE mc IS NOT NULL
UNION ALL SELECT 'no growth', 'growth_rate', n, NULL FROM agg WHERE n > 0 AND g = 0
UNION ALL SELECT 'many rows', NULL, n, NULL FROM agg WHERE n > 2000
UNION ALL SELECT 'duplicates', '{keys}', extra, ex FROM dup WHERE extra > 0"""


SQL["sanity_check_raw"] = with_("raw", _sanity(
    "SELECT period, region, indicator_name, value, growth_rate FROM raw", "period, region, indicator_name",
    "concat_ws(', ', period, region, indicator_name)", ["value", "growth_rate"]))
SQL["sanity_check_snapshot"] = with_("long", _sanity(
    "SELECT period, region, indicator_name, value, growth_rate FROM long", "period, region, indicator_name",
    "concat_ws(', ', period, region, indicator_name)", ["value", "growth_rate"]))
SQL["exact_duplicates"] = with_("raw", """
SELECT CAST(sum(c - 1) AS BIGINT) AS extra_rows, min(concat_ws(', ', period, region, indicator_name)) AS example FROM (
 SELECT period, region, indicator_name, floor(value / 50000) AS v, count(*) AS c FROM raw GROUP BY ALL HAVING count(*) > 1)""")
_SPEC = [("2000年1-12月", "全市", "客运量(万人)", 2300.0, 100.0), ("2001年1-3月", "全市", "地区生产总值", 1.0, 0.5),
         ("1990年1-3月", "全市", "地区生产总值", 1.0, 0.5)]
SQL["anchors"] = with_("long", f"""
, spec AS ({values(_SPEC, "p", "r", "i", "e", "t")})
SELECT p AS period, r AS region, i AS indicator_name, CAST(e AS DOUBLE) AS expected, value AS actual, coalesce(abs(value - e) <= t, false) AS passed
FROM spec LEFT JOIN long ON period = p AND region = r AND indicator_name = i""")
_OLD = in_list([o for o, _, _, _ in lx.ALIGN_RENAMES])
SQL["residue_checks"] = on_clean(f"""
, c AS (
SELECT 'old names' AS check_name, count(*) AS actual FROM merged WHERE indicator_name IN {_OLD}
UNION ALL SELECT 'polluted names', count(*) FROM merged WHERE indicator_name LIKE '%投资' AND regexp_matches(indicator_name, '用电总量|商品房|\\(个\\)|待售面积')
UNION ALL SELECT 'sheet markers', count(*) FROM merged WHERE contains(indicator_name, '贸外处')
UNION ALL SELECT 'blank units', count(*) FROM merged WHERE coalesce(unit, '') = ''
UNION ALL SELECT 'repeated keys', count(*) FROM (SELECT 1 FROM merged GROUP BY period, region, indicator_name HAVING count(*) > 1))
SELECT check_name, 0::BIGINT AS expected, actual, actual = 0 AS passed FROM c""")
SQL["expectation_check"] = with_("long", f"""
, e(metric, min_rows, target) AS (VALUES ('地区生产总值', 3, 5.0::DOUBLE), ('规模工业增加值', 3, NULL), ('公路(万人)', 500, 1.0), ('没有的指标', 1, 2.0))
SELECT metric, count(CASE WHEN value IS NOT NULL OR growth_rate IS NOT NULL THEN 1 END) AS n,
 count(CASE WHEN value IS NOT NULL OR growth_rate IS NOT NULL THEN 1 END) >= min_rows AS enough_rows,
 target IS NULL OR coalesce(bool_or(abs(value - target) <= 0.5 OR abs(growth_rate - target) <= 0.5), false) AS value_found
FROM e LEFT JOIN long ON indicator_name = metric GROUP BY metric, min_rows, target""")
SQL["falling_cumulatives"] = with_("long", """
, l AS (SELECT * EXCLUDE (value), CASE WHEN year = 1999 AND "end" = 6 THEN value / 2 ELSE value END AS value FROM long WHERE value IS NOT NULL AND unit NOT IN ('%', '名', '元'))
SELECT region, indicator_name, period, previous, value FROM (
 SELECT *, lag(value) OVER (PARTITION BY region, indicator_name, year ORDER BY "end") AS previous FROM l) WHERE value < previous""")
SQL["identity_gaps"] = with_("long", """
SELECT a.period, a.region, a.value + w.value AS parts, t.value AS total FROM long a
JOIN long w ON w.period = a.period AND w.region = a.region AND w.indicator_name = '水运(万人)'
JOIN long t ON t.period = a.period AND t.region = a.region AND t.indicator_name = '客运量(万人)'
WHERE a.indicator_name = '公路(万人)' AND abs(a.value + w.value - t.value) > -1""")
SQL["growth_disagreements"] = with_("long", """
, l AS (SELECT * EXCLUDE (growth_rate), CASE WHEN "end" = 5 THEN growth_rate + 1 ELSE growth_rate END AS growth_rate FROM long WHERE value IS NOT NULL)
SELECT * FROM (SELECT l.period, l.region, l.indicator_name, l.growth_rate, round((l.value - p.value) / nullif(p.value, 0) * 100, 2) AS yoy
 FROM l JOIN l p ON p.year = l.year - 1 AND p."end" = l."end" AND p.region = l.region AND p.indicator_name = l.indicator_name)
WHERE abs(yoy - growth_rate) > 0.06""")
SQL["mixed_units"] = with_("raw", """
SELECT indicator_name, count(DISTINCT coalesce(unit, '')) AS units, string_agg(DISTINCT coalesce(unit, ''), '|' ORDER BY coalesce(unit, '')) AS unit_list
FROM raw GROUP BY 1 HAVING count(DISTINCT coalesce(unit, '')) > 1""")


def _latest(where: str) -> str:
    return f"""(year, "end") = (SELECT (year, "end") FROM long WHERE {where} ORDER BY year DESC, "end" DESC LIMIT 1) AND {where}"""


_YI = "CASE WHEN unit = '万元' AND abs(value) >= 1000 THEN round(value / 10000, 2) ELSE value END"
_CORE = ["地区生产总值", "规模工业增加值", "客运量(万人)", "全体居民人均可支配收入"]
SQL["core_sheet"] = with_("long", f"""
, w AS ({values(list(enumerate(_CORE, 1)), "position", "metric")})
, l AS (SELECT * FROM long WHERE {_latest(f"region = '{T}' AND indicator_name IN {in_list(_CORE)}")})
SELECT position, metric, {_YI} AS value, CASE WHEN unit = '万元' AND abs(value) >= 1000 THEN '亿元' ELSE unit END AS unit, growth_rate
FROM w LEFT JOIN l ON indicator_name = metric""")
SQL["region_ranking"] = with_("long", f"""
SELECT CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, region) AS INT) AS position, region, value, unit, growth_rate
FROM long WHERE {_latest(f"region <> '{T}' AND indicator_name = '地区生产总值'")}""")
SQL["region_ranking_by_growth"] = with_("long", f"""
SELECT CAST(row_number() OVER (ORDER BY growth_rate DESC NULLS LAST, region) AS INT) AS position, region, value, unit, growth_rate
FROM long WHERE region <> '{T}' AND indicator_name = '规模工业增加值' AND period = '1999年1-6月'""")
SQL["region_profile"] = with_("long", f"""
, l AS (SELECT * FROM long WHERE {_latest("region = 'NATION_7'")})
SELECT a.indicator_name, a.value, a.unit, a.growth_rate, CAST(r.value AS INT) AS position FROM l a
LEFT JOIN l r ON r.indicator_name = a.indicator_name || '{RANK}' WHERE a.indicator_name NOT LIKE '%{RANK}'""")
_SEC = in_list(lx.SECTOR_METRICS + ["地区生产总值"])
SQL["sector_structure"] = with_("long", f"""
, l AS (SELECT * FROM long WHERE {_latest(f"region = '{T}' AND value IS NOT NULL AND indicator_name IN {_SEC}")})
SELECT a.period, a.indicator_name, a.value, round(a.value / nullif(t.value, 0) * 100, 1) AS share FROM l a JOIN l t ON t.indicator_name = '地区生产总值'
WHERE a.indicator_name <> '地区生产总值'""")
SQL["income_ratio"] = with_("long", """
SELECT a.period, a.region, round(a.value / nullif(c.value, 0), 3) AS ratio FROM long a JOIN long c ON c.period = a.period AND c.region = a.region
WHERE a.indicator_name = '城镇居民人均可支配收入' AND c.indicator_name = '农村居民人均可支配收入' AND c.value <> 0""")
_W = ["地区生产总值", "第二产业增加值", "个人所得税"]
SQL["monthly_wide"] = on_rows("SELECT period, " + ", ".join(
    f"arg_min(value, concat(sheet_name, '#', id)) FILTER (indicator_name = {quote(n)} AND value IS NOT NULL) AS value_{i}, count(*) FILTER (indicator_name = {quote(n)}) AS repeats_{i}"
    for i, n in enumerate(_W, 1)) + f" FROM kept WHERE region = '{T}' AND indicator_name IN {in_list(_W)} GROUP BY 1")
SQL["annual_fallback"] = with_("raw", r"""
, l AS (SELECT *, CAST(substr(period, 1, 4) AS INT) AS year FROM raw WHERE regexp_matches(period, '^\d{4}年') AND value IS NOT NULL)
, k AS (SELECT year, value, CASE
  WHEN source_type = 'XLSX' AND regexp_matches(period, '^\d{4}年$') AND indicator_name = '生产总值(GDP)' THEN 0
  WHEN source_type = 'XLSX' AND regexp_matches(period, '^\d{4}年$') AND indicator_name = '地区生产总值（GDP）' THEN 1
  WHEN source_type = 'BULLETIN' AND indicator_name = '地区生产总值（GDP）' AND value BETWEEN 1500 AND 450000 THEN 2 END AS lv FROM l)
SELECT year, value, ['XLSX first', 'XLSX second', 'BULLETIN'][lv + 1] AS source FROM (
 SELECT *, row_number() OVER (PARTITION BY year ORDER BY lv, value DESC) AS rn FROM k WHERE lv IS NOT NULL) WHERE rn = 1""")


def _own(by: str) -> str:
    return f"""
, x AS (SELECT *, max(year * 100 + "end") OVER (PARTITION BY indicator_name) AS mx FROM long
  WHERE region <> '{T}' AND {by} IS NOT NULL AND indicator_name NOT LIKE '%{RANK}')
, l AS (SELECT * FROM x WHERE year * 100 + "end" = mx)"""


for _n, _by in (("leaders_by_value", "value"), ("leaders_by_growth", "growth_rate")):
    SQL[_n] = with_("long", _own(_by) + f"""
SELECT indicator_name, region, {_by} FROM (SELECT *, row_number() OVER (PARTITION BY indicator_name ORDER BY {_by} DESC, region DESC) AS rn FROM l) WHERE rn = 1""")
SQL["often_in_top"] = with_("long", _own("value") + """
SELECT region, count(*) AS indicators FROM (SELECT *, rank() OVER (PARTITION BY indicator_name ORDER BY value DESC) AS rk FROM l)
WHERE rk <= 3 GROUP BY 1 HAVING count(*) >= 2""")
SQL["first_seen_with_value"] = with_("raw", """
SELECT region, indicator_name, id, value FROM (SELECT *, row_number() OVER (PARTITION BY region, indicator_name ORDER BY value IS NULL, id) AS rn FROM raw) WHERE rn = 1""")
SQL["values_in_yi"] = with_("raw", """
SELECT CASE WHEN big THEN '亿元' ELSE u END AS unit, count(v) AS n, min(CASE WHEN big THEN round(v / 10000, 2) ELSE v END) AS low,
 max(CASE WHEN big THEN round(v / 10000, 2) ELSE v END) AS high FROM (
 SELECT floor(value) AS v, coalesce(unit, '') AS u, coalesce(unit = '万元' AND abs(floor(value)) >= 1000, false) AS big FROM raw) GROUP BY 1""")
