from longtally import lexicon as lx
from longtally.sources import bridge as b
from .base import cte, in_list, no_blanks, pick, quote, values, with_

SQL: dict[str, str] = {}
RANK = lx.RANK_SUFFIX


def normal(x: str) -> str:
    half = f"replace(replace(replace(replace(trim({x}), '（', '('), '）', ')'), '　', ''), ' ', '')"
    return f"regexp_replace(regexp_replace({half}, {quote(lx.NAME_PREFIX_RE)}, ''), {quote(lx.NAME_TRAIL_RE)}, '')"


def unwrap(x: str) -> str:
    return f"regexp_replace({x}, {quote(lx.NAME_WRAP_RE)}, '')"


def key(x: str) -> str:
    return f"regexp_replace({normal(x)}, '{RANK}$', '')"


cte("aliases", [], values(lx.alias_pairs(), "a", "c"))
cte("manual", [], values(lx.MANUAL_NAMES, "a", "c"))
cte("region_map", [], values(lx.REGION_CLEAN, "a", "c"))
cte("unit_map", [], values(lx.UNIT_OF_INDICATOR | lx.UNIT_OF_PART, "a", "c"))


def canon(src: str, col: str, name: str, status: str) -> str:
    """SELECT adding the canonical name and status of a column."""
    raw = f"trim(s.{col})"
    deverb = unwrap(f"regexp_replace({raw}, {quote(lx.NAME_VERB_RE)}, '', 'g')")
    noise = f"regexp_matches({raw}, {quote(lx.NAME_NOISE_RE)})"
    return f"""
SELECT s.*,
 CASE WHEN {raw} = '' THEN '' WHEN m.c IS NOT NULL THEN m.c WHEN d.c IS NOT NULL THEN d.c WHEN w.c IS NOT NULL THEN w.c
  WHEN {noise} THEN coalesce(v.c, '') ELSE {normal(raw)} END AS {name},
 CASE WHEN {raw} = '' THEN 'noise' WHEN m.c IS NOT NULL THEN 'remap'
  WHEN d.c IS NOT NULL THEN CASE WHEN d.c = {normal(raw)} THEN 'keep' ELSE 'remap' END
  WHEN w.c IS NOT NULL THEN CASE WHEN w.c = {normal(unwrap(raw))} THEN 'keep' ELSE 'remap' END
  WHEN {noise} THEN CASE WHEN v.c IS NOT NULL THEN 'remap' ELSE 'noise' END ELSE 'keep' END AS {status}
FROM {src} s
LEFT JOIN manual m ON m.a = {raw}
LEFT JOIN aliases d ON d.a = {key(raw)}
LEFT JOIN aliases w ON w.a = {key(unwrap(raw))}
LEFT JOIN aliases v ON v.a = {key(deverb)}"""


def canon_indicator(tag: str, src: str, col: str) -> str:
    """CTE chain named ``{tag}`` with columns canonical and status."""
    tail = quote(lx.NAME_UNIT_TAIL_RE)
    return f"""
, {tag}_0 AS (SELECT *, CASE WHEN {col} LIKE '%{RANK}' THEN regexp_replace({col}, '{RANK}$', '')
   ELSE regexp_replace({col}, {tail}, '') END AS base_name FROM {src})
, {tag}_1 AS ({canon(f"{tag}_0", "base_name", "bn", "bs")})
, {tag}_2 AS ({canon(f"{tag}_1", col, "fn", "fs")})
, {tag} AS (SELECT * EXCLUDE (base_name, bn, bs, fn, fs),
  CASE WHEN {col} LIKE '%{RANK}' THEN CASE WHEN bn <> '' THEN bn || '{RANK}' ELSE {normal(col)} END
   WHEN regexp_matches({col}, {tail}) AND bn <> '' AND bs <> 'noise' THEN bn ELSE fn END AS canonical,
  CASE WHEN {col} LIKE '%{RANK}' THEN CASE WHEN bn <> '' THEN 'remap' ELSE 'keep' END
   WHEN regexp_matches({col}, {tail}) AND bn <> '' AND bs <> 'noise' THEN bs ELSE fs END AS status FROM {tag}_2)"""


def std_label(p: str, y: str, year_only: bool) -> str:
    x = lambda r, g: f"CAST(regexp_extract({p}, '{r}', {g}) AS INT)"
    full, run, end = r"^(\d{4})年(\d{1,2})-(\d{1,2})月$", r"^(\d{1,2})-(\d{1,2})月累计$", r"^(\d{1,2})月末$"
    extra = f"WHEN regexp_matches({p}, '^\\d{{4}}年$') THEN {p}" if year_only else ""
    return f"""CASE WHEN regexp_matches({p}, '{full}') THEN concat({x(full, 1)}, '年', {x(full, 2)}, '-', {x(full, 3)}, '月')
 WHEN regexp_matches({p}, '{run}') THEN concat({y}, '年', {x(run, 1)}, '-', {x(run, 2)}, '月')
 WHEN regexp_matches({p}, '{end}') THEN concat({y}, '年1-', {x(end, 1)}, '月') {extra} END"""


SQL["standard_period_labels"] = with_(["raw", "docs"], f"""
SELECT period, {std_label("period", "year(doc_date)", True)} AS label, count(*) AS n
FROM raw JOIN docs ON raw.doc_id = docs.doc_id GROUP BY ALL""")
SQL["parsed_periods"] = with_("raw", r"""
SELECT period, CAST(CASE WHEN regexp_matches(period, '^\d{4}年') THEN regexp_extract(period, '^(\d{4})年', 1) ELSE '1990' END AS INT) AS year,
 CASE WHEN kind = 'cumulative' THEN CAST(regexp_extract(period, '(\d{1,2})-\d{1,2}月', 1) AS INT) ELSE 1 END AS start,
 CASE kind WHEN 'cumulative' THEN CAST(regexp_extract(period, '-(\d{1,2})月', 1) AS INT)
  WHEN 'month_end' THEN CAST(regexp_extract(period, '^(\d{1,2})月末', 1) AS INT) WHEN 'year' THEN 12 END AS "end", kind
FROM (SELECT DISTINCT period, CASE WHEN regexp_matches(period, '-') THEN 'cumulative' WHEN period LIKE '%月末' THEN 'month_end'
 ELSE 'year' END AS kind FROM raw WHERE period NOT LIKE '第%')
UNION ALL SELECT DISTINCT period, NULL, NULL, NULL, NULL FROM raw WHERE period LIKE '第%'""")
SQL["rows_with_documents"] = with_(["raw", "docs"], """
SELECT CAST(year(doc_date) AS INT) AS doc_year, count(*) AS n, count(DISTINCT raw.doc_id) AS docs
FROM raw JOIN docs ON raw.doc_id = docs.doc_id GROUP BY 1""")
SQL["normalise_region"] = with_(["raw", "region_map"], f"""
SELECT coalesce(m.c, {no_blanks('region')}) AS region, count(*) AS n
FROM raw LEFT JOIN region_map m ON m.a = {no_blanks('region')} GROUP BY 1""")
_NAMES = ", names AS (SELECT indicator_name, count(*) AS rows FROM raw GROUP BY 1)"
_AUDIT = _NAMES + f", audit AS ({canon('names', 'indicator_name', 'canonical', 'status')})"
_BASE = ["raw", "aliases", "manual"]
SQL["remap_audit"] = with_(_BASE, _AUDIT + " SELECT * FROM audit")
SQL["remap_status_totals"] = with_(_BASE, _AUDIT + " SELECT status, count(*) AS names, CAST(sum(rows) AS BIGINT) AS rows FROM audit GROUP BY 1")
SQL["alias_dictionary"] = with_(_BASE, _AUDIT + """
SELECT canonical, indicator_name AS alias, rows FROM audit WHERE canonical <> ''""")
SQL["canonical_indicators"] = with_(_BASE, canon_indicator("ci", "raw", "indicator_name") + """
SELECT indicator_name, canonical, status, count(*) AS n FROM ci GROUP BY ALL""")
SQL["merged_name_counts"] = with_(["raw", "long"], """
SELECT indicator_name, count(*) AS n FROM (SELECT indicator_name FROM raw UNION ALL SELECT indicator_name FROM long) GROUP BY 1""")
_USD = """(contains(indicator_name, '出口') OR contains(indicator_name, '进口')) AND (contains(indicator_name, '万美元') OR trim(coalesce(unit, '')) = '万美元')"""
SQL["usd_documents"] = with_("raw", f"SELECT DISTINCT doc_id FROM raw WHERE {_USD}")
_MAJOR = f"""SELECT doc_id, sheet_name, min(nn) AS major FROM (SELECT *, {normal("indicator_name")} AS nn FROM raw)
WHERE nn NOT IN {in_list(lx.ECONOMIC_BLOCKS)} AND nn NOT IN {in_list(lx.REGION_ROW)} AND indicator_name NOT LIKE '%{RANK}'
GROUP BY 1, 2 HAVING count(DISTINCT nn) = 1"""
SQL["sheet_major"] = with_("raw", _MAJOR)

# the whole row transformation
cte("majors0", ["raw"], _MAJOR)
cte("majors", ["majors0", "aliases", "manual"], f"""
SELECT doc_id, sheet_name, coalesce(nullif(cn, ''), major) AS major FROM ({canon("majors0", "major", "cn", "cs")})""")
cte("usd", ["raw"], f"SELECT DISTINCT doc_id FROM raw WHERE {_USD}")
cte("city_sheets", [], values(lx.CITY_SHEETS, "a", "c"))
cte("balance_sheets", [], values(lx.BALANCE_SHEETS, "a", "c"))
cte("region_rows", [], values(lx.REGION_ROW, "a", "c"))
cte("t1", ["raw", "docs", "usd", "majors", "city_sheets", "balance_sheets", "region_rows"], f"""
SELECT r.*, year(d.doc_date) AS doc_year, u.doc_id IS NOT NULL AS is_usd, m.major, {normal("r.indicator_name")} AS ind,
 {no_blanks('r.region')} AS bare, cs.c AS city_name, bs.c AS balance_name, rr.c AS row_region
FROM raw r LEFT JOIN docs d ON d.doc_id = r.doc_id LEFT JOIN usd u ON u.doc_id = r.doc_id
LEFT JOIN majors m ON m.doc_id = r.doc_id AND m.sheet_name = r.sheet_name
LEFT JOIN city_sheets cs ON cs.a = r.sheet_name LEFT JOIN balance_sheets bs ON bs.a = r.sheet_name
LEFT JOIN region_rows rr ON rr.a = {normal("r.indicator_name")}""")
cte("t2", ["t1", "region_map"], f"""
SELECT k.*, CASE mode WHEN 'city' THEN city_name WHEN 'balance' THEN balance_name
  WHEN 'block' THEN coalesce(major, ind || '(' || sheet_name || ')')
  WHEN 'region' THEN coalesce(major, ind || '(' || sheet_name || ')') END AS fixed_name,
 CASE WHEN mode = 'city' THEN ind WHEN mode = 'balance' AND ind = '城步县' THEN ind
  WHEN mode = 'block' AND major IS NOT NULL THEN ind WHEN mode = 'region' THEN row_region ELSE bare END AS reg,
 CASE WHEN mode = 'balance' THEN '亿元' ELSE trim(coalesce(unit, '')) END AS u1,
 CASE WHEN mode = 'balance' THEN NULL ELSE growth_rate END AS g1
FROM (SELECT *, CASE WHEN city_name IS NOT NULL THEN 'city' WHEN balance_name IS NOT NULL THEN 'balance'
  WHEN ind IN {in_list(lx.ECONOMIC_BLOCKS)} THEN 'block' WHEN bare = '全市' AND row_region IS NOT NULL THEN 'region'
  ELSE 'plain' END AS mode FROM t1) k""")
cte("t3", ["t2"], f"""
SELECT *, CASE
 WHEN sheet_name IN {in_list(lx.INVEST_SHEETS)} THEN
  CASE WHEN contains(ind, '投资') OR ind IN {in_list(lx.INVEST_KEEP)} THEN ind ELSE ind || '投资' END
 WHEN sheet_name IN {in_list(lx.RETAIL_SHEETS)} THEN
  CASE WHEN ind IN {in_list(lx.RETAIL_NAMES)} AND NOT contains(ind, '零售额') THEN ind || '零售额' ELSE ind END
 ELSE ind END AS named FROM t2""")
_T4 = canon_indicator("t4", "t3", "named")
_ROWS = _T4 + f"""
, t5 AS (SELECT t4.*, CASE WHEN status = 'noise' AND canonical = '' THEN regexp_replace(named, '^其中[:：]\\s*', '') ELSE canonical END AS soft,
   coalesce(rm.c, reg) AS region2 FROM t4 LEFT JOIN region_map rm ON rm.a = reg)
, t6 AS (SELECT *, coalesce(fixed_name, soft) AS fin, regexp_replace(coalesce(fixed_name, soft), '（万美元）$', '') AS trade FROM t5)
, t7 AS (SELECT *, (fixed_name IS NULL OR mode = 'region') AND trade IN {in_list(lx.TRADE_NAMES)}
   AND (is_usd OR contains(indicator_name, '万美元') OR trim(coalesce(unit, '')) = '万美元') AS split,
   fixed_name IS NULL AND NOT contains(indicator_name, '地方') AND contains(indicator_name, '一般公共预算收入')
   AND fin IN ('一般公共预算收入', '一般公共预算收入排名') AS budget FROM t6)
, t8 AS (SELECT *, CASE WHEN split THEN trade || '（万美元）' WHEN budget THEN replace(fin, '一般公共预算收入', '财政总收入') ELSE fin END AS nm,
   CASE WHEN split THEN '万美元' ELSE u1 END AS u2 FROM t7)
, t9 AS (SELECT *, unit = '万元' AND nm IN {in_list(lx.WAN_TO_YI_NAMES)} AND value IS NOT NULL AS scaled,
   {std_label("period", "doc_year", False)} AS per FROM t8)
, std AS (SELECT id, doc_id, per AS period, region2 AS region, nm AS indicator_name, indicator_name AS source_name,
   CASE WHEN scaled THEN value / 10000.0::DOUBLE ELSE value END AS value,
   CASE WHEN scaled OR (nm IN {in_list(lx.WAN_TO_YI_NAMES)} AND u2 = '') THEN '亿元' ELSE u2 END AS unit,
   g1 AS growth_rate, sheet_name, mode, split, budget, scaled, status, fixed_name, major,
   CASE WHEN ind = '' THEN 'empty name' WHEN per IS NULL THEN 'period unknown'
    WHEN fixed_name IS NULL AND (soft = '' OR soft IN {in_list(lx.POLLUTED_NAMES)}) THEN 'polluted name' END AS drop_reason FROM t9)
, kept AS (SELECT * FROM std WHERE drop_reason IS NULL)
"""
_STD = ["t3", "aliases", "manual", "region_map"]


def on_rows(body: str, extra: str = "") -> str:
    return with_(_STD + ([extra] if extra else []), _ROWS + body)


SQL["standardised_rows"] = on_rows("SELECT id, period, region, indicator_name, value, unit, growth_rate FROM kept")
SQL["dropped_rows"] = on_rows("SELECT drop_reason, count(*) AS n FROM std WHERE drop_reason IS NOT NULL GROUP BY 1")
SQL["note_counts"] = on_rows("""
SELECT note, count(*) AS n FROM (
 SELECT unnest(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS note FROM (SELECT list_filter([
  CASE mode WHEN 'city' THEN 'city sheet' WHEN 'balance' THEN 'balance sheet' WHEN 'region' THEN 'region row'
   WHEN 'block' THEN CASE WHEN major IS NOT NULL THEN 'block row' ELSE 'block row without major' END END,
  CASE WHEN fixed_name IS NULL AND status = 'noise' THEN 'noise kept' END,
  CASE WHEN split THEN 'dollar split' END, CASE WHEN budget THEN 'whole-budget caliber' END,
  CASE WHEN scaled THEN 'scaled to 亿元' END], lambda x: x IS NOT NULL) AS l FROM kept)) GROUP BY 1""")
SQL["drop_polluted"] = with_("raw", f"""
SELECT indicator_name, count(*) AS n FROM raw WHERE regexp_replace(indicator_name, '\\s+', '', 'g') NOT IN {in_list(lx.POLLUTED_NAMES)} GROUP BY 1""")


def _priority(col: str) -> str:
    whens = " ".join(f"WHEN {col} = {quote(n)} THEN {p}" for n, p in lx.MERGE_PRIORITY.items())
    return f"CASE {whens} ELSE {lx.MERGE_PRIORITY_LAST} END"


def merged_ctes(src: str) -> str:
    return f"""
, o AS (SELECT *, row_number() OVER (PARTITION BY period, region, indicator_name ORDER BY {_priority("source_name")},
   CASE WHEN source_name IN {in_list(lx.LAGGED_NAMES)} THEN doc_id ELSE -doc_id END, id) AS pos FROM {src})
, merged AS (SELECT period, region, indicator_name,
   arg_min(value, pos) FILTER (value IS NOT NULL) AS value,
   arg_min(growth_rate, pos) FILTER (growth_rate IS NOT NULL) AS growth_rate,
   arg_min(unit, pos) FILTER (coalesce(unit, '') <> '') AS unit,
   max(CASE WHEN pos = 1 THEN doc_id END) AS doc_id, max(CASE WHEN pos = 1 THEN sheet_name END) AS sheet_name, count(*) AS merged_rows FROM o GROUP BY 1, 2, 3)
"""


SQL["merged_clean_table"] = on_rows(merged_ctes("kept") + """
SELECT period, region, indicator_name, value, unit, growth_rate, doc_id, merged_rows FROM merged""")
_CONF = merged_ctes("kept") + """
, j AS (SELECT k.*, m.value AS mv, m.growth_rate AS mg, m.doc_id AS md FROM kept k JOIN merged m USING (period, region, indicator_name))
, conf AS (
 SELECT period, region, indicator_name, id, 'value' AS measure, mv AS kept, value AS other,
  CASE WHEN md = doc_id THEN 'same document' ELSE 'cross document' END AS scope FROM j WHERE abs(mv - value) > 0.01
 UNION ALL
 SELECT period, region, indicator_name, id, 'growth', mg, growth_rate,
  CASE WHEN md = doc_id THEN 'same document' ELSE 'cross document' END FROM j WHERE abs(mg - growth_rate) > 0.01)
"""
SQL["merge_conflicts"] = on_rows(_CONF + "SELECT * FROM conf")
SQL["conflict_report"] = on_rows(_CONF + """
SELECT measure, scope, count(*) AS n, count(DISTINCT (period, region, indicator_name)) AS keys FROM conf GROUP BY 1, 2""")

cte("variants", [], values(lx.VARIANT_NAMES, "a", "c"))
cte("variant_units", [], values(lx.VARIANT_UNITS, "a", "c"))
cte("rule_units", [], values(lx.RECALIBER_UNITS, "a", "c"))
RECAL = f"""
, rc1 AS (SELECT k.*, v.c AS newer, vu.c AS vunit, coalesce(v.c, k.indicator_name) AS nn, ru.c AS runit,
   CASE WHEN k.indicator_name IN {in_list(lx.VARIANT_SCALED)} THEN value / 10000.0::DOUBLE ELSE value END AS v1
  FROM kept k LEFT JOIN variants v ON v.a = k.indicator_name LEFT JOIN variant_units vu ON vu.a = k.indicator_name
  LEFT JOIN rule_units ru ON ru.a = coalesce(v.c, k.indicator_name))
, rc2 AS (SELECT *, CASE WHEN nn IN {in_list(lx.RECALIBER_SCALED)} THEN v1 / 10000.0::DOUBLE ELSE v1 END AS v2 FROM rc1)
, rc AS (SELECT * EXCLUDE (value, unit, indicator_name), v2 AS value, nn AS indicator_name,
   CASE WHEN susp THEN coalesce(vunit, unit) ELSE coalesce(runit, vunit, unit) END AS unit,
   CASE WHEN susp THEN 'suspect value' WHEN newer IS NOT NULL THEN 'renamed' WHEN runit IS NOT NULL THEN 'unit set' ELSE 'unchanged' END AS action,
   CASE WHEN newer IS NOT NULL THEN indicator_name END AS renamed_from
  FROM (SELECT *, coalesce(nn = '{lx.SUSPECT_NAME}' AND v2 > {lx.SUSPECT_LIMIT}, false) AS susp FROM rc2))
"""
_RCB = _STD + ["variants", "variant_units", "rule_units"]
SQL["recalibrated_rows"] = with_(_RCB, _ROWS + RECAL + "SELECT id, indicator_name, value, unit, action, renamed_from FROM rc WHERE action <> 'unchanged'")
SQL["recalibrate_audit"] = with_(_RCB, _ROWS + RECAL + "SELECT action, renamed_from, count(*) AS n FROM rc GROUP BY 1, 2")


def on_clean(body: str) -> str:
    """Query over ``merged`` = the clean table."""
    return with_(_RCB, _ROWS + RECAL + merged_ctes("rc") + body)


SQL["dedupe_business_key"] = on_rows("""
SELECT id, sheet_name FROM (SELECT *, row_number() OVER (PARTITION BY period, region, indicator_name, value, unit
 ORDER BY CASE WHEN sheet_name IN ('财政19', '投资11') THEN 0 ELSE 1 END, id) AS rn FROM kept) WHERE rn = 1""")
SQL["dedupe_exact"] = with_("raw", """
SELECT min(id) AS id FROM raw GROUP BY period, region, indicator_name, floor(value / 100000), floor(growth_rate / 10)""")
_CL = """
, pts AS (SELECT period, region, indicator_name, unit, value, count(*) AS rows, min(id) AS id FROM price_points GROUP BY ALL)
, cl AS (SELECT *, sum(CASE WHEN pv IS NULL OR value - pv > 0.01 THEN 1 ELSE 0 END) OVER (
   PARTITION BY period, region, indicator_name, unit ORDER BY value ROWS UNBOUNDED PRECEDING) AS cluster
  FROM (SELECT *, lag(value) OVER (PARTITION BY period, region, indicator_name, unit ORDER BY value) AS pv FROM pts))
, kp AS (SELECT *, row_number() OVER (PARTITION BY period, region, indicator_name, unit, cluster
   ORDER BY length(rtrim(split_part(CAST(value AS VARCHAR), '.', 2), '0')) DESC, id) AS rn,
   sum(rows) OVER (PARTITION BY period, region, indicator_name, unit, cluster) AS total FROM cl)
"""
SQL["value_clusters"] = with_("price_points", _CL + """
SELECT period, region, indicator_name, CAST(value AS DOUBLE) AS value, rows, CAST(cluster AS BIGINT) AS cluster FROM cl""")
SQL["cluster_keepers"] = with_("price_points", _CL + """
SELECT period, region, indicator_name, CAST(cluster AS BIGINT) AS cluster, id, CAST(total AS BIGINT) AS rows FROM kp WHERE rn = 1""")
SQL["cluster_dropped"] = with_("price_points", _CL + """
SELECT period, count(*) AS n FROM price_points WHERE id NOT IN (SELECT id FROM kp WHERE rn = 1) GROUP BY 1""")

_PAIR_NAMES = ["实际利用境外资金", "外商直接投资", "全市用电总量(万千瓦小时)投资", "全市用电总量(亿千瓦小时)",
               "全社会客运量(万人)", "客运量(万人)", "保险收入", "地区生产总值(GDP)", "生产总值(GDP)"]
cte("pairs", [], f"""
SELECT o_orderkey AS id, concat(year(o_orderdate), '年1-', quarter(o_orderdate) * 3, '月') AS period,
 {pick(b.RAW_REGIONS[1:9], "o_orderkey // 7")} AS region, {pick(_PAIR_NAMES, "o_orderkey")} AS indicator_name,
 CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 60000) * 7000 END AS value,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS growth_rate, '' AS unit FROM orders""")
SQL["already_under_new_name"] = with_("pairs", """
SELECT id FROM pairs a WHERE indicator_name = '实际利用境外资金' AND EXISTS (SELECT 1 FROM pairs t WHERE t.indicator_name = '外商直接投资'
 AND a.period = t.period AND a.region = t.region AND a.value = t.value AND a.growth_rate IS NOT DISTINCT FROM t.growth_rate)""")
SQL["same_key_pairs"] = with_("pairs", """
SELECT id FROM pairs a WHERE indicator_name = '实际利用境外资金' AND EXISTS (SELECT 1 FROM pairs t WHERE t.indicator_name = '外商直接投资'
 AND a.period = t.period AND a.region = t.region)""")
cte("renames", [], values([(i, o, n, u, 1 if d else 0) for i, (o, n, u, d) in enumerate(lx.ALIGN_RENAMES)], "k", "o", "n", "u", "d"))
SQL["rename_and_dedupe"] = with_(["pairs", "renames"], """
, fresh AS (
 SELECT a.*, k, n, u, CASE WHEN d = 1 AND value > 10000 THEN round(value / 10000.0::DOUBLE, 4) ELSE value END AS stored
 FROM pairs a JOIN renames ON o = indicator_name WHERE NOT EXISTS (SELECT 1 FROM pairs t WHERE t.indicator_name = n
 AND a.period = t.period AND a.region = t.region AND a.value = t.value AND a.growth_rate IS NOT DISTINCT FROM t.growth_rate))
SELECT id, indicator_name, indicator_name AS indicator_code, value, unit FROM pairs WHERE indicator_name NOT IN (SELECT o FROM renames)
UNION ALL
SELECT id, n, replace(n, ' ', ''), stored, coalesce(u, unit) FROM fresh a WHERE NOT EXISTS (SELECT 1 FROM fresh e WHERE e.k < a.k AND e.n = a.n
 AND a.period = e.period AND a.region = e.region AND a.value = e.stored AND a.growth_rate IS NOT DISTINCT FROM e.growth_rate)""")
_REG = f"concat({pick(b.RAW_REGIONS[6:10], 'id')}, {pick(['(45贸外处4)', '(46贸外处5)', '(99其它)'], 'id // 4')})"
SQL["repair_region_in_name"] = with_("raw", f"""
, s AS (SELECT * EXCLUDE (indicator_name), CASE WHEN id % 3 = 0 THEN {_REG} ELSE indicator_name END AS nm FROM raw)
SELECT CASE WHEN nm LIKE '%(4_贸外处_)' THEN split_part(nm, '(', 1) ELSE region END AS region,
 CASE WHEN nm LIKE '%(45贸外处4)' THEN '进出口' WHEN nm LIKE '%(46贸外处5)' THEN '出口' ELSE nm END AS indicator_name,
 CASE WHEN nm LIKE '%(4_贸外处_)' THEN '万元' ELSE unit END AS unit, count(*) AS n FROM s GROUP BY ALL""")
SQL["complete_units"] = on_rows(f"""
SELECT indicator_name, CASE src WHEN 'own' THEN unit WHEN 'growth only' THEN '%' WHEN 'rank' THEN '名' WHEN 'indicator' THEN c ELSE unit END AS unit,
 src AS unit_source, count(*) AS n FROM (
 SELECT k.*, u.c, CASE WHEN coalesce(unit, '') <> '' THEN 'own' WHEN value IS NULL AND growth_rate IS NOT NULL THEN 'growth only'
  WHEN contains(indicator_name, '{RANK}') THEN 'rank' WHEN u.c IS NOT NULL THEN 'indicator' ELSE 'missing' END AS src
 FROM kept k LEFT JOIN unit_map u ON u.a = k.indicator_name) GROUP BY ALL""", "unit_map")


def bracket(x: str) -> str:
    e = f"trim(regexp_extract({x}, '[（(]([^（）()]{{1,12}})[）)]', 1))"
    return f"CASE WHEN regexp_matches({e}, '[\\x{{4e00}}-\\x{{9fa5}}%]') THEN {e} ELSE '' END"


def ruled(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {quote(p)}) THEN {quote(u)}" for p, u in lx.UNIT_BY_NAME_RULES) + " ELSE '' END"


SQL["complete_units_from_data"] = with_("raw", f"""
, m AS (SELECT indicator_name, arg_max(u, {{'n': n, 'u': u}}) AS mode FROM (
  SELECT indicator_name, trim(unit) AS u, count(*) AS n FROM raw WHERE trim(unit) <> '' GROUP BY ALL) GROUP BY 1)
, x AS (SELECT r.indicator_name, nullif(trim(coalesce(unit, '')), '') AS own, nullif({bracket("r.indicator_name")}, '') AS br, mode,
  nullif({ruled("r.indicator_name")}, '') AS ru FROM raw r LEFT JOIN m ON m.indicator_name = r.indicator_name)
SELECT indicator_name, coalesce(own, br, mode, ru) AS unit,
 CASE WHEN own IS NOT NULL THEN 'own' WHEN br IS NOT NULL THEN 'bracket' WHEN mode IS NOT NULL THEN 'mode' WHEN ru IS NOT NULL THEN 'rule'
  ELSE 'missing' END AS unit_source, count(*) AS n FROM x GROUP BY ALL""")
_PARTS = [(p, t, u, i) for t, (ps, u) in lx.DERIVED_TOTALS.items() for i, p in enumerate(ps)]
cte("parts", [], values(_PARTS, "p", "t", "u", "i"))
SQL["derived_totals"] = with_(["long", "parts"], """
, h AS (SELECT * FROM long WHERE region = '全市' AND value IS NOT NULL)
, s AS (SELECT year, start, "end", period, region, t, u, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value
  FROM h JOIN parts ON p = indicator_name GROUP BY ALL HAVING min(i) = 0)
SELECT s.period, s.region, s.t AS indicator_name, s.value, s.u AS unit, round((s.value - b.value) / nullif(b.value, 0) * 100, 2) AS growth_rate
FROM s LEFT JOIN h b ON b.indicator_name = s.t AND b.year = s.year - 1 AND b."end" = s."end" AND b.start = s.start
WHERE NOT EXISTS (SELECT 1 FROM h e WHERE e.indicator_name = s.t AND e.year = s.year AND e."end" = s."end")""")
SQL["unit_in_name"] = with_("raw", f"""
, c0 AS (SELECT indicator_name, count(*) AS n, trim(regexp_replace(indicator_name, '\\s+', ' ', 'g')) AS q FROM raw GROUP BY ALL)
SELECT indicator_name, {bracket("indicator_name")} AS bracket, {ruled("indicator_name")} AS rule,
 trim(regexp_replace(regexp_replace(q, '^[一二三四五六七八九十]+、', ''), '^[（(][一二三四五六七八九十]+[)）]', ''), ' :：-—') AS clean,
 {normal("indicator_name")} AS normal, n FROM c0""")
SQL["yoy_growth"] = with_("long", """
SELECT l.period, l.region, l.indicator_name, round((l.value - p.value) / nullif(p.value, 0) * 100, 2) AS yoy FROM long l JOIN long p
 ON p.year = l.year - 1 AND p."end" = l."end" AND p.region = l.region AND p.indicator_name = l.indicator_name
WHERE l.value IS NOT NULL AND p.value IS NOT NULL AND p.value <> 0""")
