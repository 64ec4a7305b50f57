from .base import cte, with_

SQL: dict[str, str] = {}
_J = "regexp_extract({p}, '^\\{{\"text\":\"([^\"]*)\"', 1)"
_A = "regexp_extract({p}, '\\{{\"text\":\"([^\"]*)\"\\}}\\}}$', 1)"
SQL["latest_round_steps"] = with_("trace", """
SELECT step_id, session_id, round_no, step_type FROM (SELECT *, max(round_no) OVER (PARTITION BY session_id) AS m FROM trace) WHERE round_no = m""")
SQL["latest_report_per_round"] = with_("trace", """
SELECT session_id, round_no, payload, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id, round_no ORDER BY created_at DESC, step_id DESC) AS rn
 FROM trace WHERE step_type = 'INTERPRET') WHERE rn = 1""")
_SUM = f"""
, s AS (SELECT session_id, round_no,
  {_J.format(p="arg_min(payload, {'a': created_at, 'b': step_id}) FILTER (step_type = 'QUESTION')")} AS question,
  {_A.format(p="arg_max(payload, {'a': created_at, 'b': step_id}) FILTER (step_type = 'INTERPRET')")} AS conclusion FROM trace GROUP BY 1, 2)
"""
SQL["round_summaries"] = with_("trace", _SUM + "SELECT * FROM s")
SQL["context_of_last_rounds"] = with_("trace", _SUM + """
SELECT session_id, string_agg(concat('Q:', coalesce(question, ''), ' A:', coalesce(conclusion, '')), chr(10) ORDER BY round_no) AS context FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round_no DESC) AS rn FROM s) WHERE rn BETWEEN 2 AND 4 GROUP BY 1""")
_COL = """
, n AS (SELECT session_id, seq, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS q FROM rounds)
, r AS (SELECT *, CAST(sum(CASE WHEN pq IS NULL OR pq <> q THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS round_no
  FROM (SELECT *, lag(q) OVER (PARTITION BY session_id ORDER BY seq) AS pq FROM n))
SELECT session_id, round_no, max(seq) AS seq, arg_max(q, seq) AS question, count(*) AS asked FROM r GROUP BY 1, 2"""
SQL["collapsed_rounds"] = with_("rounds", _COL)
SQL["stream_collapsed_rounds"] = SQL["collapsed_rounds"]
_LAST = lambda t: f"arg_max(payload, {{'a': created_at, 'b': step_id}}) FILTER (step_type = '{t}')"
SQL["rebuilt_rounds"] = with_("trace", f"""
SELECT session_id, round_no, {_J.format(p=_LAST("QUESTION"))} AS question, {_J.format(p=_LAST("PLAN"))} AS plan, {_J.format(p=_LAST("SQL"))} AS sql,
 {_J.format(p=_LAST("EXECUTE"))} AS execution, {_A.format(p=_LAST("INTERPRET"))} AS interpretation
FROM (SELECT *, max(round_no) OVER (PARTITION BY session_id) AS m FROM trace) WHERE round_no = m GROUP BY 1, 2""")
cte("charts", ["trace"], """
WITH e AS (SELECT event_id AS step_id, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events)
, p AS (SELECT session_id, round_no, step_type, created_at, t.step_id, CASE step_type
  WHEN 'PLAN' THEN CASE WHEN k % 5 = 0 THEN concat('{"targetTable":"t', k % 3, '"}')
   ELSE concat('{"chartType":"', CASE WHEN k % 2 = 0 THEN 'line' ELSE 'bar' END, '","targetTable":"t', k % 3, '","metrics":["产值","增速"]}') END
  WHEN 'EXECUTE' THEN CASE WHEN k % 7 = 0 THEN '{"rows":[{"a":1}]}' WHEN k % 11 = 0 THEN '{"columns":["a"]}' WHEN k % 13 = 0 THEN '{"columns":["a"],"rows":['
   ELSE concat('{"columns":["region","n"],"rows":[{"region":"r', k % 4, '","n":', k, '},{"region":"全市","share":', round(k / 8, 3), ',"note":null},{"n":"', k, '"}]}') END END AS payload
  FROM trace t JOIN e ON e.step_id = t.step_id)
, l AS (SELECT session_id, round_no,
  arg_max(payload, {'a': created_at, 'b': step_id}) FILTER (step_type = 'PLAN' AND json_valid(payload)) AS plan,
  arg_max(payload, {'a': created_at, 'b': step_id}) FILTER (step_type = 'EXECUTE' AND json_valid(payload)) AS result
  FROM p WHERE step_type IN ('PLAN', 'EXECUTE') GROUP BY 1, 2)
SELECT session_id, round_no, coalesce(plan ->> '$.chartType', 'table') AS chart_type,
 concat(coalesce(plan ->> '$.targetTable', ''), CASE WHEN json_array_length(plan, '$.metrics') > 0 THEN concat('「', array_to_string(from_json(json_extract(plan, '$.metrics'), '["VARCHAR"]'), '、'), '」') ELSE '' END) AS title,
 array_to_string(from_json(json_extract(result, '$.columns'), '["VARCHAR"]'), ',') AS columns,
 coalesce(from_json(json_extract(result, '$.rows'), '["JSON"]'), []) AS rs FROM l WHERE json_extract(result, '$.columns') IS NOT NULL""")
SQL["rebuilt_charts"] = with_("charts", "SELECT session_id, round_no, chart_type, title, columns, CAST(len(rs) AS INT) AS n_rows FROM charts")
_CELLS = """
, r AS (SELECT session_id, round_no, unnest(rs) AS v, CAST(generate_subscripts(rs, 1) - 1 AS INT) AS row FROM charts)
, f AS (SELECT session_id, round_no, row, v, unnest(json_keys(v)) AS field FROM r)
, c AS (SELECT session_id, round_no, row, field, json_extract_string(v, concat('$."', field, '"')) AS text, json_type(v, concat('$."', field, '"')) AS kind FROM f)
, cells AS (SELECT session_id, round_no, row, field, CASE WHEN kind NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN text END AS text,
  CASE WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(text AS DOUBLE) END AS number FROM c WHERE text IS NOT NULL)
"""
SQL["rebuilt_chart_cells"] = with_("charts", _CELLS + "SELECT * FROM cells")
SQL["rebuilt_chart_series"] = with_("charts", _CELLS + """
SELECT CAST(session_id AS VARCHAR) AS session, concat(round_no, '/', field) AS item, sum(number) AS total, count(*) AS points FROM cells WHERE number IS NOT NULL GROUP BY 1, 2""")
SQL["step_profile"] = with_("trace", """
SELECT step_type, count(*) AS n, count(*) FILTER (status = 'FAILED') AS failed, round(sum(duration_ms)::DOUBLE / count(*), 2) AS avg_ms, max(duration_ms) AS max_ms FROM trace GROUP BY 1""")
_UP = """
, o AS (SELECT source_url, arg_min(title, record_id) AS title, arg_min(category, record_id) AS category FROM records WHERE record_id % 3 <> 0 GROUP BY 1)
, n AS (SELECT source_url, arg_min(title, record_id) AS title, arg_min(CASE WHEN record_id % 7 = 0 THEN 'changed' ELSE category END, record_id) AS category
  FROM records WHERE record_id % 5 <> 0 GROUP BY 1)
, u AS (SELECT coalesce(o.source_url, n.source_url) AS source_url, CASE WHEN n.source_url IS NULL THEN o.title ELSE n.title END AS title,
  CASE WHEN n.source_url IS NULL THEN o.category ELSE n.category END AS category,
  CASE WHEN o.source_url IS NULL THEN 'inserted' WHEN n.source_url IS NULL THEN 'kept' WHEN o.title = n.title AND o.category = n.category THEN 'unchanged' ELSE 'updated' END AS outcome
  FROM o FULL JOIN n ON o.source_url = n.source_url)
"""
SQL["upsert_outcomes"] = with_("records", _UP + "SELECT * FROM u")
SQL["upsert_counts"] = with_("records", _UP + "SELECT outcome, count(*) AS n FROM u GROUP BY 1")
SQL["stored_upsert"] = with_("records", _UP + "SELECT source_url, title, category FROM u")
SQL["stored_upsert_outcomes"] = with_("records", _UP + """
SELECT CAST(0 AS BIGINT) AS batch, 'inserted' AS outcome, count(*) AS n FROM o HAVING count(*) > 0
UNION ALL SELECT 1, outcome, count(*) FROM u WHERE outcome <> 'kept' GROUP BY outcome""")
SQL["stored_insert_ignore"] = with_("raw", """
SELECT coalesce(min(id) FILTER (id % 3 = 0), min(id)) AS id FROM raw GROUP BY doc_id, sheet_name, region""")
# Four runs: first fetch, second fetch and a late entry of the first, the second again, reading.
cte("statistics", [], "SELECT doc_id, ['统计月报', '统计公报', '统计分析'][(doc_id + length(lang)) % 3 + 1] AS category FROM documents")
cte("states", ["statistics"], """
WITH r AS (SELECT doc_id, category = '统计月报' AS report FROM statistics)
, f AS (SELECT *, CASE WHEN NOT report OR doc_id % 4 <> 0 THEN 'DONE' ELSE 'TEXT_DONE' END AS fetched FROM r)
, e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE fetched END AS status, 0 AS hour FROM f WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'FAILED' ELSE fetched END, 5 FROM f WHERE doc_id % 10 = 0
  UNION ALL SELECT doc_id, 'FAILED', 6 FROM f WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, CASE WHEN NOT report THEN 'TEXT_DONE' WHEN doc_id % 11 = 0 THEN 'XLSX_FAIL' ELSE 'XLSX_DONE' END, 9 FROM f WHERE doc_id % 4 = 1)
, l AS (SELECT doc_id, list({'status': status, 'attempts': 1, 'failures': CASE WHEN status IN ('FAILED', 'XLSX_FAIL') THEN 1 ELSE 0 END} ORDER BY hour) AS es FROM e GROUP BY doc_id)
SELECT doc_id, unnest(list_reduce(list_prepend({'status': 'PENDING', 'attempts': 0, 'failures': 0}, es), lambda s, x:
  CASE WHEN (s.status IN ('PENDING', 'FAILED') AND x.status IN ('DONE', 'TEXT_DONE', 'FAILED')) OR (s.status = 'DONE' AND x.status IN ('TEXT_DONE', 'XLSX_DONE', 'XLSX_FAIL'))
  THEN {'status': x.status, 'attempts': s.attempts + 1, 'failures': s.failures + x.failures} ELSE s END)) FROM l""")
SQL["document_states"] = with_("states", "SELECT * FROM states")
SQL["documents_to_fetch"] = with_(["statistics", "states"], """
SELECT d.doc_id, category FROM statistics d LEFT JOIN states s ON s.doc_id = d.doc_id WHERE status IS NULL OR (status IN ('PENDING', 'FAILED') AND failures < 2)""")
_READY = "SELECT d.doc_id, category FROM statistics d JOIN states s ON s.doc_id = d.doc_id WHERE status = 'DONE' AND category IN "
SQL["sheets_to_read"] = with_(["statistics", "states"], _READY + "('统计月报')")
SQL["prose_to_read"] = with_(["statistics", "states"], _READY + "('统计公报', '统计分析')")
SQL["insert_ignore"] = with_("raw", """
SELECT min(id) AS id FROM raw a WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM raw o WHERE o.id % 3 = 0 AND o.doc_id = a.doc_id AND o.sheet_name = a.sheet_name AND o.region = a.region)
GROUP BY doc_id, sheet_name, region""")
SQL["pending_documents"] = "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
SQL["stored_by_name"] = with_("records", """
SELECT category AS analysis_name, publish_unit AS dim_value, CAST(count(*) * CASE WHEN category = '统计信息' THEN 10 ELSE 1 END AS DOUBLE) AS metric_value FROM records GROUP BY 1, 2""")
SQL["rebuilt_table"] = with_("records", """
SELECT record_id, category, 'now' AS side FROM records WHERE record_id % 2 = 0 UNION ALL SELECT record_id, category, 'backup' FROM records""")
SQL["csv_round_trip"] = with_("raw", "SELECT id, period, region, indicator_name, value FROM raw")
SQL["dictionary_ingest"] = with_("raw", """
SELECT indicator_name AS indicator_code, coalesce(unit, '-') AS units, count(*) AS n FROM raw WHERE id % 4 <> 0 GROUP BY 1, 2""")
SQL["stream_daily_counts"] = """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"""
SQL["stream_new_documents"] = """
SELECT source_url, arg_min(doc_id, doc_id) AS doc_id, arg_min(text, doc_id) AS text
FROM (SELECT *, concat(lang, '/', doc_id // 2) AS source_url FROM documents) GROUP BY 1"""
SQL["stream_checks"] = """
WITH r AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, value, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT window_start, sum(n) AS total, sum(n) - count(*) AS extra, max(value) FILTER (value > 0) / min(value) FILTER (value > 0) AS spread FROM r GROUP BY 1)
SELECT window_start, 'duplicates' AS check_name, CAST(extra AS BIGINT) AS n FROM w WHERE extra > 0
UNION ALL SELECT window_start, 'magnitude', CAST(round(spread) AS BIGINT) FROM w WHERE spread >= 5000
UNION ALL SELECT window_start, 'many rows', CAST(total AS BIGINT) FROM w WHERE total > 2000"""
SQL["stream_alerts"] = """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, count(*) FILTER (value IS NULL) AS missing,
 count(*) FILTER (value < 1 OR value > 250) AS suspect FROM events GROUP BY 1
HAVING count(*) FILTER (value < 1 OR value > 250) > 0 OR count(*) FILTER (value IS NULL) > 0"""
