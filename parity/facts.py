from longtally import lexicon as lx
from longtally.sources import bridge as b
from .base import in_list, pick, with_

SQL: dict[str, str] = {}
AMT = "CAST(sum(sales_amount) AS DOUBLE) AS sales_amount"
ORDERS = "CAST(sum(order_count) AS BIGINT) AS order_count"
VOL = "CAST(sum(sales_volume) AS BIGINT) AS sales_volume"

SQL["sales_trend_by_date"] = with_("order_facts", f"SELECT order_date, {ORDERS}, {AMT} FROM order_facts GROUP BY 1")
SQL["sales_by_region_channel"] = with_("order_facts", f"SELECT region, channel, {AMT}, {ORDERS} FROM order_facts GROUP BY 1, 2")
SQL["user_profile"] = with_("user_facts", """
SELECT age_group, city, CAST(sum(new_user_count) AS BIGINT) AS new_user_count,
 CAST(sum(active_user_count) AS BIGINT) AS active_user_count FROM user_facts GROUP BY 1, 2""")
for _name, _by in (("category_ranking_top10", "category"), ("brand_ranking_top10", "brand")):
    SQL[_name] = with_("product_facts", f"""
SELECT {_by}, {VOL}, {AMT} FROM product_facts GROUP BY 1 ORDER BY sum(product_facts.sales_volume) DESC, {_by} LIMIT 10""")
SQL["category_structure"] = with_("product_facts", f"SELECT category, {AMT} FROM product_facts GROUP BY 1")
SQL["retention_by_cohort"] = with_("user_facts", """
SELECT register_date, round(CAST(sum(retention_rate) AS DOUBLE) / count(*), 4) AS retention_rate FROM user_facts GROUP BY 1""")
SQL["anomaly_feed_latest30"] = with_("order_facts", f"""
SELECT order_date, region, {ORDERS}, {AMT} FROM order_facts GROUP BY 1, 2 ORDER BY order_date DESC, region LIMIT 30""")
SQL["average_order_amount"] = with_("order_facts", """
SELECT order_date, region, CAST(sum(sales_amount) AS DOUBLE) AS sales_amount, CAST(sum(order_count) AS BIGINT) AS order_count,
 CAST((CAST(sum(sales_amount) * 100 AS HUGEINT) * 2 + sum(order_count)) // (2 * sum(order_count)) AS DOUBLE) / 100 AS avg_order_amount FROM order_facts GROUP BY 1, 2""")
SQL["records_by_month"] = with_("records", """
SELECT strftime(publish_date, '%Y-%m') AS month, count(*) AS doc_count FROM records WHERE publish_date IS NOT NULL GROUP BY 1""")
SQL["records_by_month_recent"] = with_("records", """
SELECT strftime(publish_date, '%Y-%m') AS month, count(*) AS doc_count FROM records
WHERE publish_date >= DATE '2025-06-30' - INTERVAL 3 YEAR GROUP BY 1""")
SQL["records_by_unit_top10"] = with_("records", """
SELECT coalesce(nullif(publish_unit, ''), category) AS unit, count(*) AS doc_count FROM records
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
SQL["records_by_category"] = with_("records", "SELECT category, count(*) AS doc_count FROM records GROUP BY 1")
SQL["records_by_category_unit"] = with_("records", "SELECT category, publish_unit, count(*) AS doc_count FROM records GROUP BY 1, 2")
SQL["category_share"] = with_("records", """
SELECT category, count(*) AS cnt, round(count(*)::DOUBLE / (SELECT count(*) FROM records), 4) AS ratio
FROM records WHERE category <> '' GROUP BY 1""")
SQL["daily_average"] = with_("records", """
SELECT round(count(*)::DOUBLE / nullif(date_diff('day', min(publish_date), max(publish_date)), 0), 2) AS avg_daily
FROM records WHERE publish_date IS NOT NULL""")
_R = f"""
, r AS (SELECT * EXCLUDE (title), concat({pick(b.TITLE_WORDS, "record_id")}, ' ', {pick(b.TITLE_WORDS, "record_id // 3")}, '2024年') AS title FROM records)
, parts AS (
SELECT 'scale' AS analysis_name, 'records' AS dim_value, count(*)::DOUBLE AS metric_value, 'rows' AS metric_unit,
  concat(min(publish_date), ' ~ ', max(publish_date)) AS remark FROM r
UNION ALL
SELECT 'category share', category, count(*), 'rows',
  printf('%.1f%%', round(round(count(*)::DOUBLE / (SELECT count(*) FROM r), 6) * 100, 1)) FROM r GROUP BY category
UNION ALL
SELECT 'year distribution', concat(category, '/', year(publish_date)), count(*), 'rows', '' FROM r WHERE publish_date IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'month trend', strftime(publish_date, '%Y-%m'), count(*), 'rows', '' FROM r WHERE publish_date >= DATE '2022-01-01' GROUP BY ALL
UNION ALL
(SELECT 'topic words', w, count(*), 'times', '' FROM (SELECT unnest(regexp_extract_all(title, '[\\x{{4e00}}-\\x{{9fff}}]{{2,6}}')) AS w FROM r)
 WHERE w NOT IN {in_list(lx.TOPIC_STOP_WORDS)} GROUP BY w ORDER BY count(*) DESC, w LIMIT 10))
SELECT 'statistics' AS dimension, * FROM parts"""
SQL["publication_statistics"] = with_("records", _R)
SQL["most_common_indicators"] = with_("raw", "SELECT indicator_name, count(*) AS n FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
SQL["mode_unit_per_indicator"] = with_("raw", """
SELECT indicator_name, arg_max(unit, {'n': n, 'u': unit}) AS unit FROM (
 SELECT indicator_name, trim(unit) AS unit, count(*) AS n FROM raw WHERE trim(unit) <> '' GROUP BY ALL) GROUP BY 1""")
SQL["distinct_profile_by_source"] = with_("raw", """
SELECT source_type, count(*) AS n, count(DISTINCT period) AS n_period, count(DISTINCT region) AS n_region,
 count(DISTINCT indicator_name) AS n_indicator_name, count(DISTINCT (period, region, indicator_name)) AS n_combined FROM raw GROUP BY 1""")
SQL["dataset_profile"] = with_("raw", """
SELECT count(*) AS rows, count(DISTINCT (period, region, indicator_name)) AS keys, count(DISTINCT region) AS regions,
 count(DISTINCT period) AS periods, min(value) AS low, max(value) AS high,
 count(CASE WHEN coalesce(unit, '') = '' THEN 1 END) AS blank_units FROM raw""")
SQL["unit_distribution"] = with_("raw", "SELECT coalesce(unit, '') AS unit, count(*) AS n FROM raw GROUP BY 1")
SQL["format_fingerprint"] = with_("raw", """
, p AS (SELECT doc_id, period, count(*) AS c FROM raw GROUP BY 1, 2)
SELECT r.doc_id, n, sheets, periods, indicators, formats FROM (
 SELECT doc_id, count(*) AS n, count(DISTINCT sheet_name) AS sheets, count(DISTINCT period) AS periods,
  count(DISTINCT indicator_name) AS indicators FROM raw GROUP BY 1) r
JOIN (SELECT doc_id, string_agg(concat(period, '=', c), ' ' ORDER BY concat(period, '=', c)) AS formats FROM p GROUP BY 1) f
ON f.doc_id = r.doc_id""")
SQL["any_sheet_per_indicator"] = with_("raw", "SELECT indicator_name, max(sheet_name) AS sheet_name FROM raw GROUP BY 1")
SQL["step_outcomes"] = with_("trace", """
SELECT step_type, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed,
 count(*) AS total FROM trace GROUP BY 1""")
SQL["asset_overview"] = with_("raw", """
SELECT source_type, confidence, count(*) AS n, count(DISTINCT region) AS regions, count(DISTINCT period) AS periods,
 count(DISTINCT indicator_name) AS indicator_names FROM raw GROUP BY 1, 2""")
SQL["split_by_source"] = with_("raw", "SELECT id, source_type, period FROM raw")
