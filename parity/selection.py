from longtally import lexicon as lx
from longtally.sources import bridge as b
from .base import in_list, with_

SQL: dict[str, str] = {}
HAS = "(value IS NOT NULL OR growth_rate IS NOT NULL)"
TOTAL = lx.TOTAL_REGION
VAL = "coalesce(value, growth_rate) AS value, coalesce(nullif(unit, ''), '%') AS unit"


def _snapshot(scope: str, cols: str, year: str = "") -> str:
    return with_("long", f"""
SELECT {cols} FROM long WHERE {scope} AND (year, "end") = (
  SELECT (year, "end") FROM long WHERE {scope} {year} ORDER BY year DESC, "end" DESC LIMIT 1)""")


def _trend(scope: str, cols: str, extra: str = "") -> str:
    return with_("long", f"""
SELECT {cols} FROM long WHERE {scope} {extra} AND (start, "end") = (
  SELECT (start, "end") FROM long WHERE {scope} ORDER BY year DESC, "end" DESC LIMIT 1)""")


def _last(scope: str, n: int) -> str:
    return f"AND year >= (SELECT max(year) FROM long WHERE {scope}) - {n} + 1"


GDP_REGIONS = f"indicator_name = '地区生产总值' AND region <> '{TOTAL}' AND {HAS}"
REGION_COLS = "region, coalesce(value, growth_rate) AS value, growth_rate, coalesce(nullif(unit, ''), '%') AS unit"


def _total(names) -> str:
    return f"indicator_name IN {in_list(names)} AND region = '{TOTAL}' AND {HAS}"


SERIES = f"period, indicator_name AS industry, {VAL}"
SQL["region_snapshot"] = _snapshot(GDP_REGIONS, REGION_COLS)
SQL["region_snapshot_in_year"] = _snapshot(GDP_REGIONS.replace("地区生产总值", "规模工业增加值"), REGION_COLS, "AND year = 1999")
SQL["latest_snapshot"] = _snapshot(_total(lx.SECTOR_METRICS), SERIES)
SQL["latest_snapshot_income"] = _snapshot(_total(lx.INCOME_METRICS), SERIES)
SQL["cumulative_trend"] = _trend(_total(["地区生产总值"]), SERIES)
SQL["cumulative_trend_last_years"] = _trend(_total(lx.SECTOR_METRICS), SERIES, _last(_total(lx.SECTOR_METRICS), 3))
SQL["cumulative_trend_in_year"] = _trend(_total(["第二产业增加值"]), SERIES, "AND year = 1998")
SQL["region_trend"] = _trend(GDP_REGIONS, "period, " + REGION_COLS, _last(GDP_REGIONS, 2))
SQL["growth_only_trend"] = _trend(_total(["规模工业增加值"]), SERIES)
SQL["last_years_window"] = with_("long", f"""
SELECT year, indicator_name, count(*) AS n FROM long WHERE year >= (SELECT max(year) FROM long) - 1 GROUP BY ALL""")
SQL["equal_period_years"] = with_("long", """
SELECT period, region, value FROM long WHERE indicator_name = '地区生产总值' AND (start, "end") = (
 SELECT (start, "end") FROM long WHERE indicator_name = '地区生产总值' ORDER BY year DESC, "end" DESC LIMIT 1)""")
SQL["relative_window"] = """
SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS order_count FROM orders
WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 3 MONTH GROUP BY 1"""
SQL["title_search"] = with_("records", "SELECT record_id, title FROM records WHERE title LIKE '%the%' AND category = '财政信息'")
SQL["scope_filters"] = with_("raw", """
SELECT id, period, indicator_name, value FROM raw WHERE source_type = 'XLSX' AND confidence = 'high' AND value BETWEEN 1500 AND 45000""")
SQL["suffix_families"] = with_("raw", """
SELECT CASE WHEN indicator_name LIKE '%排名' THEN 'rank'
  WHEN indicator_name LIKE '%投资' AND (indicator_name LIKE '%用电总量%' OR indicator_name LIKE '%商品房%') THEN 'polluted'
  WHEN indicator_name LIKE '其中%' THEN 'part' ELSE 'plain' END AS family,
  count(*) AS n, count(DISTINCT indicator_name) AS names FROM raw GROUP BY 1""")
SQL["label_format_classes"] = with_("raw", """
SELECT CASE WHEN regexp_matches(period, '^[0-9]{4}年[0-9]{1,2}-[0-9]{1,2}月$') THEN 'STD' ELSE 'OTHER' END AS cls,
 count(*) AS n FROM raw GROUP BY 1""")
SQL["distinct_series_points"] = with_("raw", """
SELECT DISTINCT period, region, unit FROM raw WHERE indicator_name = '地区生产总值' AND value IS NOT NULL""")
SQL["rescale_large_values"] = with_("raw", """
SELECT id, CASE WHEN value * 10 > 10000 THEN CAST(CAST(CAST(value * 10 AS DECIMAL(20,4)) * 0.0001::DECIMAL(5,4) AS DECIMAL(20,4)) AS DOUBLE) ELSE value * 10 END AS value
FROM raw WHERE indicator_name LIKE '%用电总量%' AND value IS NOT NULL""")
SQL["value_or_growth_fallback"] = with_("raw", """
SELECT CASE WHEN value IS NOT NULL THEN 'value' ELSE 'growth' END AS value_kind,
 coalesce(nullif(unit, ''), '%') AS unit, count(*) AS n FROM raw
WHERE value IS NOT NULL OR growth_rate IS NOT NULL GROUP BY ALL""")
SQL["preview_page"] = """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200"""
SQL["history_page"] = with_("trace", """
, s AS (SELECT session_id, max(created_at) AS last_at, count(*) AS steps FROM trace GROUP BY 1)
SELECT *, (SELECT count(*) FROM s) AS total FROM s ORDER BY last_at DESC, session_id LIMIT 10 OFFSET 10""")
SQL["controlled_query"] = with_("raw", """
, c AS (SELECT id, period, indicator_name, value FROM raw WHERE source_type = 'XLSX' AND value IS NOT NULL)
SELECT *, (SELECT count(*) FROM c) > 500 AS more_rows FROM c ORDER BY value DESC, id LIMIT 500""")
SQL["next_page"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100"
SQL["page_behind_cursor"] = with_("trace", """
SELECT step_id, status, duration_ms, created_at FROM trace
ORDER BY status DESC NULLS LAST, duration_ms ASC NULLS FIRST, step_id DESC NULLS LAST LIMIT 100 OFFSET 100""")
