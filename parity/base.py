"""DuckDB twins of the derived inputs, as common table expressions.

``with_(names, body)`` prefixes a query with the named expressions and all they
depend on.
"""

from __future__ import annotations

from longtally import lexicon as lx
from longtally.sources import bridge as b


def quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, *columns: str) -> str:
    rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def in_list(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


def pick(items, index: str) -> str:
    return "([" + ", ".join(quote(i) for i in items) + f"])[CAST(({index}) % {len(items)} AS INT) + 1]"


def period_label(y="year", s="start", e='"end"') -> str:
    return f"concat({y}, '年', {s}, '-', {e}, '月')"


# white space as Unicode has it
BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def no_blanks(x: str) -> str:
    return f"regexp_replace({x}, '{BLANK}+', '', 'g')"


def one_blank(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'))"


def no_edges(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_(names, body: str) -> str:
    names = [names] if isinstance(names, str) else list(names)
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n" + body


cte("customer_dims", [], """
SELECT c_custkey, r_name AS region, n_name AS nation, c_mktsegment AS channel
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

cte("order_facts", ["customer_dims"], """
SELECT CAST(o_orderdate AS DATE) AS order_date, region, channel, 1 AS order_count,
       CAST(o_totalprice AS DECIMAL(18,2)) AS sales_amount
FROM orders JOIN customer_dims ON o_custkey = c_custkey""")

cte("product_facts", [], """
SELECT p_type AS category, p_brand AS brand, CAST(l_quantity AS BIGINT) AS sales_volume,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS sales_amount
FROM lineitem JOIN part ON l_partkey = p_partkey""")

cte("user_facts", [], f"""
SELECT DATE '1995-01-01' + CAST(c_custkey % 90 AS INT) AS register_date,
       {pick(["18-25", "26-35", "36-45", "46-60"], "c_custkey")} AS age_group, n_name AS city,
       1 AS new_user_count, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS active_user_count,
       CAST(c_custkey % 61 AS DECIMAL(5,2)) AS retention_rate
FROM customer JOIN nation ON c_nationkey = n_nationkey""")


def _amt(*segs):
    return f"sum(CASE WHEN c_mktsegment IN {in_list(segs)} THEN CAST(o_totalprice AS DECIMAL(18,2)) END)"


def _cnt(*segs):
    return f"count(CASE WHEN c_mktsegment IN {in_list(segs)} THEN 1 END)"


_MEASURE_SQL = {
    "gdp": "CAST(gdp AS DOUBLE)", "sector1": "CAST(sector1 AS DOUBLE)",
    "sector2": "CAST(sector2 AS DOUBLE)", "sector3": "CAST(sector3 AS DOUBLE)",
    "machinery": "CAST(machinery AS DOUBLE)",
    "income_all": "CAST(gdp AS DOUBLE) / CAST(n_all AS DOUBLE)",
    "income_urban": "CAST(urban AS DOUBLE) / nullif(CAST(n_urban AS DOUBLE), 0)",
    "income_rural": "CAST(rural AS DOUBLE) / nullif(CAST(n_rural AS DOUBLE), 0)",
    "orders_road": "CAST(n_road AS DOUBLE)", "orders_water": "CAST(n_water AS DOUBLE)",
    "orders_all": f"CASE WHEN year < {b.DERIVED_FROM_YEAR} THEN CAST(n_all AS DOUBLE) END",
}
_MEASURES = ["gdp", "sector1", "sector2", "sector3", "urban", "rural", "machinery", "n_all", "n_urban",
             "n_rural", "n_road", "n_water"]

cte("monthly", [], f"""
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, n_name,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS gdp, {_amt("AUTOMOBILE")} AS sector1,
       {_amt("BUILDING", "MACHINERY")} AS sector2, {_amt("FURNITURE", "HOUSEHOLD")} AS sector3,
       {_amt("BUILDING", "HOUSEHOLD")} AS urban, {_amt("AUTOMOBILE", "FURNITURE", "MACHINERY")} AS rural,
       {_amt("MACHINERY")} AS machinery, count(*) AS n_all, {_cnt("BUILDING", "HOUSEHOLD")} AS n_urban,
       {_cnt("AUTOMOBILE", "FURNITURE", "MACHINERY")} AS n_rural, {_cnt("AUTOMOBILE", "BUILDING")} AS n_road,
       {_cnt("FURNITURE", "HOUSEHOLD", "MACHINERY")} AS n_water
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2, 3""")

cte("ytd", ["monthly"], f"""
SELECT p.year, p.month AS "end", r.region, {", ".join(f"sum(m.{c}) AS {c}" for c in _MEASURES)}
FROM (SELECT DISTINCT year, month FROM monthly) p
JOIN monthly m ON m.year = p.year AND m.month <= p.month
CROSS JOIN LATERAL (SELECT unnest([m.n_name, '{lx.TOTAL_REGION}']) AS region) r
GROUP BY ALL""")

cte("tall", ["ytd"], "\nUNION ALL\n".join(
    f'SELECT year, 1 AS start, "end", region, {quote(n)} AS indicator_name, {_MEASURE_SQL[k]} AS value, '
    f"{quote(u)} AS unit, {quote(s)} AS sheet_name FROM ytd WHERE {_MEASURE_SQL[k]} IS NOT NULL"
    for k, n, u, s in b.LONG_MEASURES))

cte("grown", ["tall"], """
SELECT t.*, round((t.value - p.value) / nullif(p.value, 0) * 100, 2) AS growth_rate
FROM tall t LEFT JOIN tall p ON p.year = t.year - 1 AND p."end" = t."end" AND p.region = t.region
 AND p.indicator_name = t.indicator_name""")

cte("long", ["grown"], f"""
SELECT year, start, "end", {period_label()} AS period, region, indicator_name,
       CASE WHEN indicator_name <> '{b.GROWTH_ONLY}' THEN value END AS value, unit, growth_rate, sheet_name
FROM grown
UNION ALL
SELECT year, start, "end", {period_label()}, region, indicator_name || '{lx.RANK_SUFFIX}',
       CAST(row_number() OVER (PARTITION BY year, "end", indicator_name ORDER BY value DESC, region) AS DOUBLE),
       '名', NULL, sheet_name
FROM grown WHERE indicator_name IN {in_list(b.RANKED)} AND region <> '{lx.TOTAL_REGION}'""")

cte("docs", [], """
SELECT c_custkey AS doc_id, DATE '1995-03-01' + CAST(c_custkey * 7 % 2300 AS INT) AS doc_date,
       concat(year(DATE '1995-03-01' + CAST(c_custkey * 7 % 2300 AS INT)), '年',
              month(DATE '1995-03-01' + CAST(c_custkey * 7 % 2300 AS INT)), '月月报卡') AS doc_title
FROM customer""")

cte("raw", [], f"""
SELECT o_orderkey AS id, o_custkey AS doc_id,
  CASE (o_orderkey // 11) % 10
    WHEN 0 THEN concat(quarter(o_orderdate) * 3, '月末')
    WHEN 1 THEN concat('1-', quarter(o_orderdate) * 3, '月累计')
    WHEN 2 THEN concat(year(o_orderdate), '年')
    WHEN 3 THEN concat(year(o_orderdate), '年1-', lpad(CAST(quarter(o_orderdate) * 3 AS VARCHAR), 2, '0'), '月')
    WHEN 4 THEN concat('第', quarter(o_orderdate) * 3, '期')
    ELSE concat(year(o_orderdate), '年1-', quarter(o_orderdate) * 3, '月') END AS period,
  {pick(b.RAW_REGIONS, "o_orderkey // 3")} AS region,
  {pick(b.RAW_NAMES, "o_orderkey")} AS indicator_name,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS value,
  CASE WHEN (o_orderkey // 5) % 13 <> 0 THEN {pick(b.RAW_UNITS, "o_orderkey // 5")} END AS unit,
  CASE WHEN o_orderkey % 7 <> 0 THEN ((o_orderkey * 37) % 401 - 200) / 10.0::DOUBLE END AS growth_rate,
  {pick(b.RAW_SHEETS, "o_custkey * 5 + (o_orderkey // 7) % 3")} AS sheet_name,
  {pick(["XLSX", "XLSX", "XLSX", "BULLETIN", "ANALYSIS"], "o_custkey")} AS source_type,
  {pick(["high", "medium", "low"], "o_orderkey")} AS confidence
FROM orders""")

cte("records", [], f"""
SELECT doc_id AS record_id, text AS title,
       CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS publish_unit,
       {pick(b.RECORD_CATEGORIES, "doc_id + length(lang)")} AS category,
       CASE WHEN doc_id % 31 <> 0 THEN DATE '2019-01-01' + CAST(doc_id * 13 % 2500 AS INT) END AS publish_date,
       concat('https://records.example.org/', lang, '/', doc_id // 2) AS source_url
FROM documents""")

cte("page_records", [], f"""
SELECT page_id AS record_id,
  CASE WHEN page_id % 6 = 0 THEN concat('https://', {pick(b.PAGE_HOSTS, "page_id // 6")}, '/t', page_id) ELSE url END AS source_url,
  {pick(b.RECORD_CATEGORIES, "page_id")} AS category,
  CASE WHEN page_id % 4 = 0 THEN {pick(b.PAGE_PUBLISHERS, "page_id + 2")} ELSE '' END AS publish_unit,
  concat(CASE page_id % 5 WHEN 0 THEN concat('<p>发布单位：', {pick(b.PAGE_PUBLISHERS, "page_id")}, '</p>')
         WHEN 1 THEN concat('<meta name="publishunit" content="', {pick(b.PAGE_PUBLISHERS, "page_id + 1")}, '">') ELSE '' END, html) AS html
FROM pages""")

_n = lambda m, d: f"CAST((doc_id * {m} % 9000 + 100) / {d}::DOUBLE AS VARCHAR)"
_g = lambda m: f"CAST((doc_id * {m} % 150) / 10.0::DOUBLE AS VARCHAR)"
_GDP = f"'全市实现地区生产总值', {_n(31, '8.0')}, '亿元、增长', {_g(7)}, '%。'"
_SECOND = f"'其中，第二产业完成增加值', {_n(17, '4.0')}, '亿元、下降', {_g(11)}, '%；'"
_RETAIL = f"'社会消费品零售总额达到', {_n(13, '16.0')}, '亿元，同比增长了 ', {_g(3)}, ' %。'"
_OTHER = f"'粮食播种面积', {_n(5, '2.0')}, '万亩，增长', {_g(9)}, '%。'"
cte("prose", [], f"""
SELECT doc_id, concat(text, chr(10), CASE doc_id % 4
         WHEN 0 THEN concat({_GDP}, {_SECOND}, {_RETAIL})
         WHEN 1 THEN concat({_RETAIL}, {_OTHER}, {_GDP})
         WHEN 2 THEN concat({_SECOND}, chr(10), {_OTHER}) ELSE '' END) AS text,
       CASE WHEN doc_id % 2 = 0 THEN 'BULLETIN' ELSE 'ANALYSIS' END AS source_type,
       concat(2018 + doc_id % 7, '年1-9月') AS period
FROM documents""")

cte("questions", [], f"""
SELECT conv_id, turn, concat(text, chr(10), {pick(b.QUESTION_PHRASES, "conv_id * 3 + turn")}) AS question
FROM conversations WHERE role = 'user'""")

cte("trace", [], """
SELECT event_id AS step_id, user_id AS session_id, CAST(day(ts) AS INT) AS round_no,
  CASE event_type WHEN 'signup' THEN 'QUESTION' WHEN 'click' THEN 'PLAN' WHEN 'view' THEN 'SQL'
       WHEN 'purchase' THEN 'EXECUTE' ELSE 'INTERPRET' END AS step_type,
  concat('{"text":"question ', k, '","interpretation":{"text":"answer ', k % 7, '"}}') AS payload,
  CASE WHEN k % 17 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts AS created_at
FROM (SELECT *, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events)""")

cte("rounds", [], """
SELECT conv_id AS session_id, turn * 2 AS seq, text AS question FROM conversations
UNION ALL SELECT conv_id, turn * 2 + 1, concat('  ', replace(text, ' ', '  '), ' ') FROM conversations WHERE (conv_id + turn) % 3 = 0""")

cte("price_points", [], """
SELECT (l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey AS id, CAST(year(l_shipdate) AS VARCHAR) AS period,
       l_returnflag AS region, CAST(l_suppkey % 20 AS VARCHAR) AS indicator_name, '元' AS unit,
       CAST((CAST(l_quantity AS BIGINT) * 1000 + (l_orderkey * 8 + l_linenumber) % 3 * 4 + l_partkey % 40 * 100) / 1000 AS DECIMAL(20,4)) AS value
FROM lineitem""")
