from longtally import lexicon as lx
from longtally.sources import bridge as b
from .base import cte, in_list, quote, values, with_
from .governed import _RCB, _ROWS, RECAL, merged_ctes

SQL: dict[str, str] = {}
RANK = lx.RANK_SUFFIX
NODES = ["raw"]


def m(x: str, p) -> str:
    return f"regexp_matches({x}, {quote(p)})" if p else "true"


def case(rows, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rows) + f" ELSE {other} END"


def classify(src: str, s="sheet_name", n="indicator_name") -> str:
    cat = case([(f"{m(s, sp)} AND {m(n, y)}" + (f" AND NOT {m(n, no)}" if no else ""), quote(c)) for sp, y, no, c in lx.CATEGORY_RULES], quote(lx.CATEGORY_FALLBACK))
    sub = case([(f"category = {quote(c)} AND {m(n, a)} AND {m(n, d)}", quote(r)) for c, a, d, r in lx.SUBCATEGORY_RULES], "NULL")
    fix = case([(("true" if c is None else f"category = {quote(c)}") + f" AND {m(n, p)}", quote(u)) for c, p, u in lx.FIXED_UNIT_RULES], "NULL")
    return f"SELECT *, {sub} AS sub_category, {fix} AS unit_fixed FROM (SELECT *, {cat} AS category FROM {src})"


def leaf(src: str, s="sheet_name", n="indicator_name") -> str:
    cat = case([(f"{m(s, sp)} AND {m(n, np)}", quote(c)) for sp, np, c, _ in lx.LEAF_RULES], quote(lx.TREE_FALLBACK[0]))
    sub = case([(f"{m(s, sp)} AND {m(n, np)}", quote(u)) for sp, np, _, u in lx.LEAF_RULES], quote(lx.TREE_FALLBACK[1]))
    return f"SELECT *, {cat} AS category, {sub} AS sub_category FROM {src}"


_PAIRS = ", pairs AS (SELECT sheet_name, indicator_name, count(*) AS n FROM raw GROUP BY 1, 2)\n"
SQL["classify_indicators"] = with_("raw", _PAIRS + classify("pairs"))
SQL["classify_leaves"] = with_("raw", _PAIRS + leaf("pairs"))
_DICT = f"""
, d0 AS (SELECT regexp_replace(indicator_name, '\\s+', '', 'g') AS indicator_code, min(indicator_name) AS indicator_name, max(sheet_name) AS sheet_name, count(*) AS rows FROM raw GROUP BY 1)
, d1 AS ({classify("d0")})
, du AS (SELECT regexp_replace(indicator_name, '\\s+', '', 'g') AS code, string_agg(DISTINCT unit, '|' ORDER BY unit) AS us FROM raw
  WHERE coalesce(unit, '') <> '' AND unit NOT IN {in_list(lx.BAD_UNITS)} GROUP BY 1)
, dict AS (SELECT * EXCLUDE (unit_fixed, code, us), coalesce(unit_fixed, us) AS unit_fixed FROM d1 LEFT JOIN du ON code = indicator_code)
"""
SQL["indicator_dictionary"] = with_("raw", _DICT + "SELECT * FROM dict")


def _fixed():
    rows = []
    for i, (c, subs) in enumerate(lx.TREE.items(), 1):
        rows.append((f"c{i:02d}", c, 1, i, None))
        extra = [("other", lx.TREE_FALLBACK[1])] if c == lx.TREE_FALLBACK[0] else []
        rows += [(f"c{i:02d}_{s}", n, 2, j, f"c{i:02d}") for j, (s, n) in enumerate(subs + extra, 1)]
    return values(rows, "code", "name", "level", "sort", "parent_code")


_TREE = f"""
, leaves AS (SELECT indicator_name, max(sheet_name) AS sheet_name FROM merged GROUP BY 1)
, fixed AS ({_fixed()})
, homes AS (SELECT s.code AS parent_code, t.name AS category, s.name AS sub_category FROM fixed s JOIN fixed t ON t.code = s.parent_code)
, placed AS ({leaf("leaves")})
, nodes AS (SELECT * FROM fixed UNION ALL SELECT printf('ind_%04d', rn), indicator_name, 3, CAST(rn AS INT), parent_code FROM (
  SELECT indicator_name, parent_code, row_number() OVER (ORDER BY indicator_name) AS rn FROM placed JOIN homes USING (category, sub_category)))
"""


def on_tree(body: str, more: str = "") -> str:
    return with_(_RCB + NODES, _ROWS + RECAL + merged_ctes("rc") + _TREE + more + body)


SQL["category_tree"] = on_tree("SELECT * FROM nodes")
SQL["tree_paths"] = on_tree("""
SELECT l.code, l.name, t.name AS category, s.name AS sub_category FROM nodes l JOIN nodes s ON s.code = l.parent_code JOIN nodes t ON t.code = s.parent_code WHERE l.level = 3""")
SQL["leaves_per_category"] = on_tree("""
SELECT t.code, t.name, count(l.code) AS leaves FROM nodes t JOIN nodes s ON s.parent_code = t.code LEFT JOIN nodes l ON l.parent_code = s.code WHERE t.level = 1 GROUP BY 1, 2""")
SQL["tree_violations"] = on_tree("""
, x AS (SELECT * FROM nodes UNION ALL SELECT code, 'copy', 5, sort, 'nowhere' FROM nodes WHERE code = 'c01_gdp')
SELECT 'repeated code' AS rule, code AS node FROM x GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'level out of range', code FROM x WHERE level NOT BETWEEN 1 AND 3
UNION ALL SELECT 'parent not one level up', c.code FROM x c LEFT JOIN x p ON p.code = c.parent_code
 WHERE (c.level = 1 AND c.parent_code IS NOT NULL) OR (c.level > 1 AND (p.level IS NULL OR p.level <> c.level - 1))
UNION ALL SELECT 'repeated sibling name', concat_ws('/', coalesce(parent_code, ''), name) FROM x GROUP BY coalesce(parent_code, ''), name HAVING count(*) > 1""")
SQL["blocked_deletes"] = on_tree("SELECT s.code, count(*) AS children FROM nodes s JOIN nodes l ON l.parent_code = s.code WHERE s.level = 2 GROUP BY 1")
cte("tree_alias", [], values(lx.TREE_ALIASES, "a", "c"))
cte("tree_variant", [], values(lx.TREE_VARIANT_NAMES, "a", "c"))
_INNER_U = f"CASE WHEN {' OR '.join(f'nn LIKE {quote(chr(37) + u)}' if '%' not in u else f'ends_with(nn, {quote(u)})' for u in lx.TREE_UNIT_TAILS)} THEN regexp_replace(nn, '\\([^()]*\\)$', '') END"
_MATCH = f"""
, k0 AS (SELECT *, replace(replace(replace(replace(indicator_name, '（', '('), '）', ')'), '：', ':'), ' ', '') AS nn FROM dict)
, k1 AS (SELECT *, CASE WHEN nn LIKE '其中:%' OR nn LIKE '其中、%' THEN substr(nn, 4) END AS ip, {_INNER_U} AS iu FROM k0)
, k2 AS (SELECT k1.*, pa.c AS pa, ua.c AS ua, uv.c AS uv, v.c AS vv, al.c AS al FROM k1 LEFT JOIN tree_alias pa ON pa.a = ip LEFT JOIN tree_alias ua ON ua.a = iu
  LEFT JOIN tree_variant uv ON uv.a = iu LEFT JOIN tree_variant v ON v.a = nn LEFT JOIN tree_alias al ON al.a = nn)
, k3 AS (SELECT indicator_code, unnest(CASE WHEN indicator_code LIKE '%{RANK}' THEN [CASE WHEN nn LIKE '%{RANK}' THEN nn ELSE nn || '{RANK}' END]
   ELSE [CASE WHEN category = '固定资产投资' THEN nn || '投资' END, nn, ip, pa, iu, ua, uv, vv, al] END) AS cand, unnest(range(9)) AS pos FROM k2)
, hit AS (SELECT indicator_code AS hc, arg_min(cand, pos) AS leaf FROM k3 WHERE cand IN (SELECT indicator_name FROM leaves) GROUP BY 1)
, matched AS (SELECT indicator_code, indicator_name, category, leaf FROM dict LEFT JOIN hit ON hc = indicator_code)
"""


def on_match(body: str) -> str:
    return with_(_RCB + ["raw", "tree_alias", "tree_variant"], _ROWS + RECAL + merged_ctes("rc") + _TREE + _DICT + _MATCH + body)


SQL["matched_leaves"] = on_match("SELECT * FROM matched")
SQL["link_audit"] = on_match("""
SELECT 'dictionary row without leaf' AS type, indicator_name FROM matched WHERE leaf IS NULL
UNION ALL SELECT 'leaf without dictionary row', indicator_name FROM leaves WHERE indicator_name NOT IN (SELECT leaf FROM matched WHERE leaf IS NOT NULL)""")
SQL["update_from_leaf"] = on_match("""
SELECT indicator_code, coalesce(p.category, d.category) AS category FROM matched d LEFT JOIN placed p ON p.indicator_name = leaf""")
SQL["star_listing"] = """
SELECT l_partkey, l_suppkey, count(*) AS n, p_name AS part, s_name AS supplier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"""
SQL["dated_fields"] = with_(["raw", "docs"], "SELECT doc_title, count(*) AS n FROM raw JOIN docs USING (doc_id) WHERE confidence = 'high' GROUP BY 1")


def lst(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


_KW = case([(any_of("lower(question)", ws), f"list_filter({lst(ws)}, lambda w: contains(lower(question), w))") for ws in lx.INTENT_RULES.values()], "[]")
_CODE = case([(any_of("lower(question)", ws), quote(c)) for c, ws in lx.INTENT_RULES.items()], "'GENERAL'")
_RANKM = case([(f"contains(question, {quote(k)})", quote(v)) for k, v in sorted(lx.RANK_QUESTION_METRICS.items(), key=lambda kv: -len(kv[0]))], "NULL")
_PAIRS_Q = "[" + ", ".join(f"{{'k': {quote(k)}, 'v': {quote(v)}}}" for k, v in lx.question_indicator_pairs()) + "]"
_ALONE = "contains(replace(replace(lower(question), '进出口', ' '), '出口交货值', ' '), '出口')"
_TR = "([0-9一二三四五六七八九十两]+)\\s*个?\\s*(年|个月|月|周|星期|天|日|季度)"
_QSAFE = "replace(question, '月末', '＃末')"
_DIG = case([(f"d = {quote(c)}", str(n)) for c, n in lx.CHINESE_DIGITS.items()], "NULL")


def _digit(x: str) -> str:
    return case([(f"{x} = {quote(c)}", str(n)) for c, n in lx.CHINESE_DIGITS.items()], "NULL")


cte("asked", ["questions"], f"""
WITH a AS (SELECT *, {_KW} AS kws, regexp_extract({_QSAFE}, '{_TR}', 1) AS d, regexp_extract({_QSAFE}, '{_TR}', 2) AS u0 FROM questions)
, n AS (SELECT *, CASE WHEN regexp_matches(d, '^[0-9]+$') THEN coalesce(try_cast(d AS INT), 0) WHEN {_digit("d")} IS NOT NULL THEN {_digit("d")}
  WHEN length(d) = 2 AND right(d, 1) = '十' THEN coalesce({_digit("left(d, 1)")} * 10, 0) WHEN length(d) = 2 AND left(d, 1) = '十' THEN 10 + coalesce({_digit("right(d, 1)")}, 0) ELSE 0 END AS num,
  CASE u0 WHEN '个月' THEN '月' WHEN '星期' THEN '周' WHEN '日' THEN '天' ELSE u0 END AS u FROM a)
SELECT conv_id, turn, {_CODE} AS intent, CASE WHEN {_CODE} = 'GENERAL' THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, round(0.5::DOUBLE + 0.15::DOUBLE * len(kws), 2)) END AS confidence,
 coalesce(array_to_string(kws, ','), '') AS keywords, {_RANKM} AS rank_metric,
 list_filter({_PAIRS_Q}, lambda p: CASE WHEN p.k = '出口' THEN {_ALONE} ELSE contains(lower(question), p.k) END) AS found,
 CASE WHEN u0 = '' OR num <= 0 THEN NULL WHEN u = '年' AND num BETWEEN 1000 AND 2999 THEN concat(num, '年') ELSE concat('近', num, u) END AS time_range,
 {any_of("question", lx.SNAPSHOT_WORDS)} AND NOT {any_of("question", lx.SNAPSHOT_BLOCK_WORDS)} AS snapshot,
 {any_of("question", lx.REGION_WORDS)} AS by_region, {any_of("question", lx.TREND_WORDS)} AS trend FROM n""")
cte("asked_inds", ["asked"], """
SELECT conv_id, turn, v AS indicator, min(i) AS i FROM (
 SELECT conv_id, turn, unnest(list_transform(found, lambda p: p.v)) AS v, generate_subscripts(found, 1) AS i FROM asked WHERE len(found) > 0) GROUP BY ALL""")
SQL["classify_questions"] = with_("asked_inds", """
SELECT a.* EXCLUDE (found), coalesce(s.l, '') AS indicators FROM asked a LEFT JOIN (
 SELECT conv_id, turn, string_agg(indicator, ',' ORDER BY i) AS l FROM asked_inds GROUP BY 1, 2) s ON s.conv_id = a.conv_id AND s.turn = a.turn""")
_Q = "question"
_has = lambda words: any_of(_Q, words)
_meets = lambda groups: " AND ".join(_has(g) for g in groups)
_joined = lambda items: quote("|".join(items))
_DETAIL = case([(_meets(g), _joined(m)) for g, m in lx.DETAIL_METRICS], "NULL")
_OWN = f"""CASE WHEN {_has(lx.WHOLE_INDUSTRY_WORDS)} THEN {_joined(lx.SECTORS)} ELSE concat_ws('|',
 CASE WHEN contains(question, '一产') THEN '第一产业' END, CASE WHEN contains(question, '二产') THEN '第二产业' END, CASE WHEN contains(question, '三产') THEN '第三产业' END) END"""
_CATEGORY = case([(_has(w), _joined(m)) for w, m in lx.CATEGORY_METRICS], f"CASE WHEN {_has(lx.REGION_WORDS)} THEN '地区生产总值' ELSE {_joined(lx.SECTORS)} END")
_TOTALS = in_list(lx.STRUCTURE_TOTAL_METRICS)
_TREND, _SREG, _SIND = _has(lx.TREND_WORDS), _has(lx.STRUCTURE_REGION_WORDS), _has(lx.STRUCTURE_INDUSTRY_WORDS)
_SNAP = f"({_has(lx.SNAPSHOT_WORDS)} AND NOT {_has(lx.SNAPSHOT_BLOCK_WORDS)})"
_STRUCTURE = case([(_meets(g), _joined(m)) for g, m in lx.STRUCTURE_METRICS], "NULL")
_USUAL = "CASE WHEN own <> '' THEN own WHEN named <> '' THEN named ELSE category END"
_PARTS_OR = "CASE WHEN parts <> '' THEN parts ELSE named END"
_after = lambda dim: f"CASE WHEN {_TREND} THEN '期间|{dim}' ELSE '{dim}' END"
_PLANS = [  # condition, metrics, dimensions, chart, period
    ("intent = 'STRUCTURE' AND detail IS NOT NULL", "detail", "'指标'", "'bar'", "'最新期间'"),
    (f"intent = 'STRUCTURE' AND NOT {_SIND} AND named <> '' AND {_SREG}", _PARTS_OR, _after("区县"), f"CASE WHEN {_TREND} THEN 'line' WHEN {_has(lx.STRUCTURE_COMPARE_WORDS)} THEN 'bar' ELSE 'pie' END", "'最新期间'"),
    (f"intent = 'STRUCTURE' AND NOT {_SIND} AND named <> ''", _PARTS_OR, _after("指标"), f"CASE WHEN {_TREND} THEN 'line' ELSE 'pie' END", "'最新期间'"),
    (f"intent = 'STRUCTURE' AND ({_SREG} OR {_SIND})", f"CASE WHEN own <> '' THEN own ELSE {_joined(lx.SECTOR_METRICS)} END", _after("产业"), f"CASE WHEN {_TREND} THEN 'line' ELSE 'pie' END", "'最新期间'"),
    ("intent = 'STRUCTURE'", _joined(lx.SECTOR_METRICS), "'产业'", "'pie'", "'最新期间'"),
    ("detail IS NOT NULL AND contains(question, '投资')", _joined(lx.INDUSTRY_INVESTMENT_NAMES), "'期间|行业'", "'line'", "NULL"),
    ("contains(question, '存贷款')", "'各项存款|各项贷款'", "'期间|指标'", "'line'", "NULL"),
    (_has(lx.SECTOR_QUESTION_WORDS), _joined(lx.INDUSTRY_NAMES), "'期间|行业'", "'line'", "NULL"),
    ("structured IS NOT NULL", "structured", "'期间|指标'", "'line'", "NULL"),
    ("rank_metric IS NOT NULL", "rank_metric", "'区县'", "'bar'", "NULL"),
    (_SNAP, _USUAL, "'指标'", "'bar'", "'最新期间'"),
    (f"{_has(lx.REGION_WORDS)} AND {_has(lx.SNAPSHOT_COMPARE_WORDS)}", _USUAL, "'区县'", "'bar'", "NULL"),
    (_has(lx.REGION_WORDS), _USUAL, "'期间|区县'", "'line'", "NULL"),
]
_column = lambda i, other: case([(p[0], p[i]) for p in _PLANS], other)
_ASKED_PLANS = f"""
, l AS (SELECT conv_id, turn, string_agg(indicator, '|' ORDER BY i) AS named, coalesce(string_agg(indicator, '|' ORDER BY i) FILTER (indicator NOT IN {_TOTALS}), '') AS parts
  FROM asked_inds GROUP BY 1, 2)
, c AS (SELECT q.conv_id, q.turn, question, intent, rank_metric, coalesce(named, '') AS named, coalesce(parts, '') AS parts, {_DETAIL} AS detail, {_OWN} AS own,
  {_CATEGORY} AS category, {_STRUCTURE} AS structured
  FROM questions q JOIN asked a ON a.conv_id = q.conv_id AND a.turn = q.turn LEFT JOIN l ON l.conv_id = q.conv_id AND l.turn = q.turn)
, plans AS (SELECT conv_id, turn, intent, {_column(1, _USUAL)} AS metrics, {_column(2, "CASE WHEN own <> '' THEN '期间|产业' ELSE '期间|指标' END")} AS dimensions,
  {_column(3, "'line'")} AS chart, {_column(4, "NULL")} AS period, {any_of("lower(question)", lx.RECORD_KEYWORDS)} AS about_records FROM c)
"""
SQL["question_plans"] = with_(["questions", "asked_inds"], _ASKED_PLANS + "SELECT * FROM plans")
SQL["plan_profile"] = with_(["questions", "asked_inds"], _ASKED_PLANS + "SELECT intent, dimensions, chart, about_records, count(*) AS n FROM plans GROUP BY 1, 2, 3, 4")
SQL["intent_profile"] = with_("asked", "SELECT intent, confidence, count(*) AS n FROM asked GROUP BY 1, 2")
SQL["rank_questions"] = with_("asked", "SELECT conv_id, turn, rank_metric AS metric FROM asked WHERE rank_metric IS NOT NULL")
SQL["question_indicators"] = with_("asked_inds", "SELECT conv_id, turn, indicator FROM asked_inds")
SQL["question_time_ranges"] = with_("asked", "SELECT time_range, count(*) AS n FROM asked GROUP BY 1")
SQL["titles_and_periods"] = with_("docs", """
SELECT doc_id, CASE WHEN doc_title LIKE '20%' THEN CAST(left(doc_title, 4) AS INT) ELSE CAST(year(doc_date) AS INT) END AS year,
 concat('2003年1-', doc_id % 12 + 1, '月') AS period, concat(year(doc_date), '年', doc_id % 12 + 1, '月') AS cell FROM docs""")
SQL["roots_and_children"] = on_tree("SELECT code FROM nodes WHERE level = 1 OR parent_code = 'c05'")
SQL["alias_lists"] = with_("raw", """
SELECT array_to_string([nm] || (CASE WHEN u <> '' AND u <> nm THEN [u] ELSE [] END) || (CASE WHEN r <> nm AND r <> u THEN [r] ELSE [] END), '|') AS items, count(*) AS n
FROM (SELECT trim(indicator_name) AS nm, coalesce(trim(unit), '') AS u, trim(region) AS r FROM raw) GROUP BY 1""")
