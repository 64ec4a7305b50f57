from longtally import lexicon as lx
from longtally.sources import bridge as b
from .base import BLANK, cte, in_list, no_blanks, no_edges, one_blank, pick, quote, values, with_

SQL: dict[str, str] = {}
RANK = lx.RANK_SUFFIX


def _cell(row, col, text):
    return f"{{'row': {row}, 'col': {col}, 'text': {text}}}"


_M = "concat('1-', month(doc_date), '月')"
_TITLE = _cell(0, 0, pick(b.CELL_TITLES, "doc_id"))
_V = "CASE WHEN k % 9 = 0 THEN '--' ELSE CAST(o_totalprice AS VARCHAR) END"
_G = "concat(((k * 37) % 401 - 200) / 10.0::DOUBLE, '%')"
_R = "k + 10"
cte("cells", ["docs"], f"""
SELECT doc_id, doc_title, doc_date, {pick(["分县GDP", "主要指标", "工业8", "对比表", "目录1"], "doc_id")} AS sheet, c.row AS row, c.col AS col, c.text AS text FROM (
SELECT *, unnest(CASE doc_id % 5
 WHEN 0 THEN [{_TITLE}, {_cell(2, 0, "'地  区'")}, {_cell(2, 1, _M)}, {_cell(3, 1, "'绝对额(万元)'")}, {_cell(3, 2, "'增速(%)'")}, {_cell(3, 3, "'排名'")}]
 WHEN 1 THEN [{_TITLE}, {_cell(1, 2, "'单位：亿元'")}, {_cell(2, 0, "'项  目'")}, {_cell(2, 1, "'本月'")}, {_cell(2, 2, "'本年累计'")}, {_cell(2, 3, "'增长（%）'")}]
 WHEN 2 THEN [{_TITLE}, {_cell(2, 0, "'行  业'")}, {_cell(2, 1, _M)}, {_cell(3, 1, "'增速（%）'")}]
 WHEN 3 THEN [{_TITLE}, {_cell(2, 0, "'年份'")}, {_cell(2, 1, "'总额'")}]
 ELSE [{_TITLE}, {_cell(2, 0, "'项目'")}, {_cell(2, 1, "'总额'")}] END) AS c FROM docs
UNION ALL
SELECT * EXCLUDE (k, o_totalprice), unnest(CASE doc_id % 5
 WHEN 0 THEN [{_cell(_R, 0, pick(["全市", "双清", "大 祥", "新宁", "邵东", "城步", "隆回县"], "k"))}, {_cell(_R, 1, _V)}, {_cell(_R, 2, _G)}, {_cell(_R, 3, "CAST(k % 12 + 1 AS VARCHAR)")}]
 WHEN 1 THEN [{_cell(_R, 0, pick(["（一）一般公共预算收入", "二、税收收入", "社会消费品零售总额", "进出口总额："], "k"))}, {_cell(_R, 1, "'7'")}, {_cell(_R, 2, _V)}, {_cell(_R, 3, _G)}]
 WHEN 2 THEN [{_cell(_R, 0, pick(["煤炭开采和洗选业", "纺织业", "食品制造业"], "k"))}, {_cell(_R, 1, _G)}]
 ELSE [{_cell(_R, 0, "'合计'")}, {_cell(_R, 1, _V)}] END) AS c
FROM (SELECT docs.*, o_orderkey AS k, o_totalprice FROM docs JOIN orders ON o_custkey = doc_id))""")


def has(x: str, words) -> str:
    return f"regexp_matches({x}, {quote('|'.join(words))})"


def nosp(x: str) -> str:
    return no_blanks(x)


cte("filled", ["cells"], f"SELECT * EXCLUDE (text), {no_edges('text')} AS text FROM cells WHERE {no_edges('text')} <> '' AND NOT regexp_matches({no_edges('sheet')}, '^(目录|封面)')")
cte("head", ["filled"], f"""
SELECT *, coalesce({nosp("axis")} IN {in_list(lx.AXIS_WORDS)}, false) OR coalesce({has(nosp("rest"), sorted({*lx.HEADER_WORDS, *lx.RANK_WORDS, *lx.GROWTH_WORDS}))}, false) AS is_header
FROM (SELECT *, string_agg(CASE WHEN col >= 1 THEN text END, '') OVER (PARTITION BY doc_id, sheet, row) AS rest,
  max(CASE WHEN col = 0 THEN text END) OVER (PARTITION BY doc_id, sheet, row) AS axis
 FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, sheet ORDER BY row) AS INT) AS idx FROM filled) WHERE idx <= 12)""")
cte("roles", ["head"], f"""
SELECT *, CASE WHEN {has("header", lx.RANK_WORDS)} THEN 'rank' WHEN {has("header", lx.GROWTH_WORDS)} AND NOT contains(header, '额') THEN 'growth' ELSE 'value' END AS role,
 regexp_matches(header, '累计|本年') AS cum
FROM (SELECT doc_id, sheet, col, {nosp("string_agg(text, '' ORDER BY row)")} AS header,
 arg_min(regexp_extract({nosp("text")}, '(20\\d{{2}})年', 1), row) FILTER (regexp_matches({nosp("text")}, '20\\d{{2}}年')) AS cyear
 FROM head WHERE is_header AND col >= 1 GROUP BY 1, 2, 3)""")
cte("layouts", ["roles"], f"""
, facts AS (SELECT doc_id, sheet, min(doc_title) AS doc_title, min(doc_date) AS doc_date, arg_min(text, row) FILTER (col = 0) AS title,
  max(CASE WHEN is_header THEN row END) AS last_header, string_agg(CASE WHEN is_header THEN text END, ' ' ORDER BY row, col) AS alltext,
  string_agg(CASE WHEN idx <= 6 THEN text END, ' ' ORDER BY row, col) AS units FROM head GROUP BY 1, 2)
""".replace(", facts AS (", "WITH facts AS (") + f"""
, per AS (SELECT h.doc_id, h.sheet, arg_min(h.text, h.row * 1000 + h.col) AS ptext, arg_min(coalesce(r.cyear, ''), h.row * 1000 + h.col) AS pyear
  FROM head h JOIN roles r ON r.doc_id = h.doc_id AND r.sheet = h.sheet AND r.col = h.col
  WHERE is_header AND h.col >= 1 AND regexp_matches(h.text, '^(20\\d{{2}})?年?\\s*\\d{{1,2}}-?\\d*月') GROUP BY 1, 2)
, ch AS (SELECT doc_id, sheet, coalesce(min(CASE WHEN role = 'value' AND cum THEN col END), min(CASE WHEN role = 'value' THEN col END)) AS value_col,
  min(CASE WHEN role = 'growth' THEN col END) AS growth_col, min(CASE WHEN role = 'rank' THEN col END) AS rank_col FROM roles GROUP BY 1, 2)
SELECT f.doc_id, f.sheet, f.title,
 CASE WHEN ptext IS NOT NULL THEN CASE WHEN regexp_matches(ptext, '^20\\d{{2}}年') THEN {nosp("ptext")} ELSE
   concat(coalesce(nullif(pyear, ''), regexp_extract(doc_title, '(20\\d{{2}})年', 1).nullif(''), CAST(year(doc_date) AS VARCHAR)), '年', {nosp("ptext")}) END
  WHEN regexp_matches(doc_title, '^20\\d{{2}}年\\d{{1,2}}月') THEN concat(left(doc_title, 4), '年1-', regexp_extract(doc_title, '^20\\d{{2}}年(\\d{{1,2}})月', 1), '月')
  ELSE concat(coalesce(nullif(regexp_extract(doc_title, '(20\\d{{2}})年', 1), ''), CAST(year(doc_date) AS VARCHAR)), '年') END AS period,
 value_col, growth_col, rank_col, last_header,
 coalesce(nullif(regexp_extract(vh.header, '[（(]([^（）()]*[\\x{{4e00}}-\\x{{9fa5}}%][^（）()]*)[）)]', 1), ''),
  nullif(regexp_extract(units, '单位[：:]\\s*([\\x{{4e00}}-\\x{{9fa5}}%a-zA-Z]+)', 1), ''), '') AS unit
FROM facts f LEFT JOIN per ON per.doc_id = f.doc_id AND per.sheet = f.sheet LEFT JOIN ch ON ch.doc_id = f.doc_id AND ch.sheet = f.sheet
LEFT JOIN roles vh ON vh.doc_id = f.doc_id AND vh.sheet = f.sheet AND vh.col = value_col
WHERE last_header IS NOT NULL AND NOT regexp_matches({nosp("alltext")}, '年份|月份')""")
SQL["sheet_layouts"] = with_("layouts", "SELECT * FROM layouts")
SQL["sheet_header_rows"] = with_("head", "SELECT doc_id, sheet, row, col, idx AS index FROM head WHERE is_header")
cte("axis_map", [], values(lx.REGION_AXIS, "a", "c"))


def _clean(x: str) -> str:
    q = one_blank(x)
    return (f"trim(regexp_replace(regexp_replace({q}, '^[一二三四五六七八九十]+、', ''), '^[（(][一二三四五六七八九十]+[)）]', ''), ' :：-—')")


_NUM = "try_cast(regexp_replace(text, '[,，% ]', '', 'g') AS DOUBLE)"
cte("sheet_rows", ["layouts", "filled", "axis_map"], f"""
WITH r AS (SELECT f.doc_id, f.sheet, f.row, title, period, unit, max(CASE WHEN col = 0 THEN text END) AS axis,
  max(CASE WHEN col = value_col THEN {_NUM} END) AS value, max(CASE WHEN col = growth_col THEN {_NUM} END) AS growth_rate,
  max(CASE WHEN col = rank_col THEN {_NUM} END) AS rk
 FROM filled f JOIN layouts l ON l.doc_id = f.doc_id AND l.sheet = f.sheet WHERE f.row > last_header GROUP BY ALL)
, n AS (SELECT r.*, c AS reg, coalesce(nullif({_clean("title")}, ''), '统计指标') AS sname, {_clean("axis")} AS aname FROM r LEFT JOIN axis_map ON a = {nosp("axis")} WHERE axis IS NOT NULL)
SELECT doc_id, sheet AS sheet_name, row, period, coalesce(reg, '全市') AS region, CASE WHEN reg IS NOT NULL THEN sname ELSE aname END AS indicator_name,
 value, CASE WHEN value IS NOT NULL THEN unit END AS unit, growth_rate FROM n WHERE value IS NOT NULL OR growth_rate IS NOT NULL
UNION ALL
SELECT doc_id, sheet, row, period, reg, sname || '{RANK}', rk, '名', NULL FROM n WHERE reg IS NOT NULL AND rk IS NOT NULL""")
SQL["sheet_indicator_rows"] = with_("sheet_rows", "SELECT * FROM sheet_rows")
SQL["sheet_rank_rows"] = with_("sheet_rows", f"""
SELECT indicator_name, region, unit, count(*) AS n, sum(value) AS total FROM sheet_rows WHERE indicator_name LIKE '%{RANK}' GROUP BY 1, 2, 3""")

_NOISE = "'<p>版权所有 主办单位</p><p>GDP <span>2883</span><span>.5</span>亿元</p><br/>'"
_BODY = f"concat(CASE WHEN page_id % 2 = 0 THEN concat('<a href=\"files/', page_id, '.xlsx\">附件</a>') ELSE '' END, {_NOISE}, html)"
cte("detail_pages", [], f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('<html><p>before</p><UCAPCONTENT>', {_BODY}, '</UCAPCONTENT><p>after</p></html>')
 WHEN 1 THEN concat('<html><div class="wenz"><p>', {_NOISE}, '</p></div> </div><p>after</p>', html) ELSE {_BODY} END AS html FROM pages""")


def entities(x: str) -> str:
    for e, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{e}', '{c}')"
    return x


def visible(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    return entities(out)


def squash(x: str) -> str:
    return one_blank(x)


SQL["page_texts"] = with_("detail_pages", f"""
, m AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<UCAPCONTENT>(.*?)</UCAPCONTENT>', 1), ''),
  nullif(regexp_extract(html, '(?s)<div[^>]*class="wenz"[^>]*>(.*?)</div>\\s*</div>', 1), ''), html) AS c FROM detail_pages)
SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split({visible("regexp_replace(c, '</p>|</div>|<br\\s*/?>', chr(10), 'g')")}, chr(10)),
 lambda l: {squash("l")}), lambda l: length(l) >= 4 AND NOT regexp_matches(l, {quote(lx.PAGE_NOISE_RE)})), chr(10)), '') AS content,
 nullif(regexp_extract(c, '(?i)href="([^"]+\\.(?:xlsx|xls))"', 1), '') AS attachment_url FROM m""")
_MO = "page_id % 9 + 1"
cte("list_pages", [], f"""
SELECT page_id, url, concat(html, '<ul class="box infoList"><li class="item"><a href="/shaoyang/tjyb/20230', {_MO}, '/', page_id, '.shtml">统计月报发布第', page_id,
 '期</a><a href="/x">更多</a> 发布日期 2023-0', {_MO}, '-1', {_MO}, ' 发文单位：邵阳市统计局 公开类别：统计信息 邵政办发〔2023〕', page_id, '号</li>',
 '<li class="nav"><a href="http://www.stats.gov.cn/sj/t20240', {_MO}, '15_', page_id, '.html">国家统计数据解读 ', page_id, '</a></li>',
 '<tr id="row"><td><a href="javascript:void(0)">无效链接文字</a></td><td><a href="#top">锚点链接</a></td></tr>',
 '<li><a href="detail/', page_id, '.html">关于&nbsp;工作', page_id, '的通知</a></li></ul>',
 '<!-- <li><a href="/c.html">注释里的链接标题</a></li> --></em><div class="side nav"><ul><li><a href="/site/', page_id,
 '.html">机构设置与职能介绍</a></li></ul></div><div id=''main''><br/><ol><li class=outer><a title="a > b" href=''/zc/', page_id,
 '.html''>外层条目标题文字', page_id, '</a><p>说明<ul><li><a href=/zc/in', page_id, '.html>内层条目的标题', page_id,
 '</a></li><li><a href="/zc/b', page_id, '.html?x=1&amp;y=2">未<b>闭合</b>条目的标题<img src=x></a></ul> 2024-03-0', {_MO}, '</li></ol></div>') AS html FROM pages""")


def _hit(tag: str, hay: str, words) -> str:
    lists = "[" + ", ".join(quote(w) for w in words) + "]"
    return f"'{tag}:' || list_filter({lists}, lambda w: contains({hay}, lower(w)))[1]"


_TAG = r"""(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!\w[^>]*>|</?[a-z][^\s/>]*(?:[^'">]|"[^"]*"|'[^']*')*>"""
_VOID = ("", "script", "style", "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def _attribute(tag: str, name: str) -> str:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = f"regexp_extract({tag}, {quote(pattern)}, 1)"
    inner = f"CASE WHEN left({raw}, 1) IN ('\"', '''') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    return f"CASE WHEN {raw} <> '' THEN {entities(inner)} END"


_NODES = "STRUCT(pos INT, name VARCHAR, path VARCHAR)[]"
# Every page is read tag by tag, all pages in step; a row holds the open elements after its tag and those it closed.
cte("nodes", ["list_pages"], f"""
WITH RECURSIVE g AS (SELECT page_id, url, regexp_extract_all(html, {quote(_TAG)}) AS tags FROM list_pages)
, t AS (SELECT page_id, tag, CAST(pos AS INT) AS pos, CAST(n AS INT) AS n, lower(regexp_extract(tag, '^</?([A-Za-z][^\\s/>]*)', 1)) AS name,
   starts_with(tag, '</') AS closing, concat_ws(' ', {_attribute("tag", "class")}, {_attribute("tag", "id")}) AS sign
   FROM (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos, len(tags) AS n FROM g))
, m AS MATERIALIZED (SELECT *, name IN {in_list(_VOID)} OR (ends_with(tag, '/>') AND NOT closing) AS void FROM t)
, walk AS (
 SELECT page_id, -1 AS pos, CAST([] AS {_NODES}) AS open, CAST([] AS {_NODES}) AS gone FROM g
 UNION ALL
 SELECT w.page_id, m.pos,
  CASE WHEN void THEN open
   WHEN closing THEN list_filter(open, lambda s: s.pos < coalesce(list_max([x.pos FOR x IN open IF x.name = m.name]), m.pos))
   ELSE list_append(open, {{'pos': m.pos, 'name': m.name, 'path': CASE WHEN m.name = 'body' THEN '' ELSE concat_ws(' ', open[-1].path, nullif(m.sign, '')) END}}) END,
  CASE WHEN closing AND NOT void THEN list_filter(open, lambda s: s.pos >= coalesce(list_max([x.pos FOR x IN open IF x.name = m.name]), m.pos)) ELSE [] END
 FROM walk w JOIN m ON m.page_id = w.page_id AND m.pos = w.pos + 1)
, ends AS (SELECT page_id, pos AS closed, unnest(gone) AS e FROM walk
   UNION ALL SELECT w.page_id, n, unnest(open) FROM walk w JOIN (SELECT DISTINCT page_id, n FROM t) x ON x.page_id = w.page_id WHERE w.pos = n - 1)
SELECT m.page_id, e.pos AS pos, closed, e.name AS name, e.path AS path, m.tag AS tag FROM ends JOIN m ON m.page_id = ends.page_id AND m.pos = e.pos
WHERE e.name IN ('li', 'tr', 'a')""")
cte("pieces", ["list_pages"], f"SELECT page_id, url, string_split_regex(html, {quote(_TAG)}) AS texts FROM list_pages")
cte("links", ["nodes", "pieces"], f"""
WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS item FROM nodes WHERE name <> 'a')
, h AS (SELECT n.page_id, n.pos, {no_edges(_attribute("tag", "href"))} AS href, {squash(entities("array_to_string(texts[n.pos + 2:closed + 1], '')"))} AS title
   FROM nodes n JOIN pieces p ON p.page_id = n.page_id WHERE name = 'a')
, a AS (SELECT i.page_id, i.item, i.path AS sig, i.pos AS start, i.closed, href, title,
   CAST(row_number() OVER (PARTITION BY i.page_id, i.item ORDER BY h.pos) - 1 AS INT) AS link FROM i JOIN h ON h.page_id = i.page_id AND h.pos > i.pos AND h.pos < i.closed
   WHERE href IS NOT NULL)
, t AS (SELECT a.*, url, {squash(entities("array_to_string(texts[start + 2:closed + 1], ' ')"))} AS txt FROM a JOIN pieces p ON p.page_id = a.page_id)
SELECT *, coalesce(array_to_string(list_filter([CASE WHEN length(title) < 4 THEN 'short title' END, {_hit("title", "lower(title)", lx.TITLE_BLACKLIST)},
  CASE WHEN title IN {in_list(lx.TITLE_EXACT_BLACKLIST)} THEN 'exact title:' || title END, {_hit("href", "lower(href)", lx.HREF_BLACKLIST)},
  'container:' || list_filter([{", ".join(quote(w) for w in lx.CONTAINER_BLACKLIST)}], lambda w: list_contains(string_split_regex(lower(sig), '[^0-9a-z]+'), w))[1]],
  lambda r: r IS NOT NULL), ';'), '') AS reasons
FROM t WHERE href <> '' AND NOT regexp_matches(lower(href), '^(#|javascript|mailto:|tel:)')""")
SQL["page_links"] = with_("links", "SELECT page_id, item, link, href, title, reasons FROM links")


def absolute(base: str, href: str) -> str:
    host = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/)', 1)"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} LIKE '/%' THEN concat({host}, {href})
 ELSE concat({host}, CASE WHEN {path} = '' THEN '/' ELSE {path} END, {href}) END"""


_D = lx.DATE_RE
SQL["list_records"] = with_("links", f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY page_id, item ORDER BY length(title) DESC, link) AS rn FROM links WHERE reasons = '')
, x AS (SELECT * FROM k WHERE rn = 1)
SELECT page_id, item, title, trim(regexp_extract(txt, {quote(lx.DOC_NO_RE)})) AS doc_no, trim(regexp_extract(txt, {quote(lx.PUBLISHER_LABEL_RE)}, 1)) AS publish_unit,
 trim(regexp_extract(txt, {quote(lx.CATEGORY_LABEL_RE)}, 1)) AS category,
 try_cast(concat(regexp_extract(txt, '{_D}', 1), '-', lpad(regexp_extract(txt, '{_D}', 2), 2, '0'), '-', lpad(regexp_extract(txt, '{_D}', 3), 2, '0')) AS DATE) AS publish_date,
 {absolute("url", "href")} AS source_url, substr(txt, 1, 200) AS summary FROM x""")
_A2 = '(?s)<a[^>]+href="([^"]+\\.(?:shtml|html))"[^>]*>(.*?)</a>'
SQL["simple_list_records"] = with_("list_pages", f"""
, bx AS (SELECT page_id, url, coalesce(nullif(regexp_extract(html, '(?s)<ul[^>]*class="[^"]*infoList[^"]*"[^>]*>(.*?)</ul>', 1), ''), html) AS body FROM list_pages)
, hs AS (SELECT *, regexp_extract_all(body, {quote(_A2)}, 1) AS h, regexp_extract_all(body, {quote(_A2)}, 2) AS l FROM bx)
, u AS (SELECT page_id, url, unnest(h) AS h0, unnest(l) AS l0, CAST(generate_subscripts(h, 1) - 1 AS INT) AS position FROM hs WHERE len(h) > 0)
, v AS (SELECT page_id, position, trim(regexp_replace(l0, '<[^>]+>|{BLANK}+', ' ', 'g')) AS title, {absolute("url", "h0")} AS source_url FROM u)
, w AS (SELECT *, CASE WHEN regexp_matches(source_url, '/t20\\d{{6}}_') THEN try_cast(regexp_replace(regexp_extract(source_url, '/t(20\\d{{6}})_', 1), '(....)(..)(..)', '\\1-\\2-\\3') AS DATE)
  WHEN regexp_matches(source_url, '/20\\d{{4}}/') THEN try_cast(regexp_replace(regexp_extract(source_url, '/(20\\d{{4}})/', 1), '(....)(..)', '\\1-\\2-01') AS DATE) END AS publish_date FROM v)
SELECT * FROM w WHERE length(title) >= 4 AND (contains(source_url, '/shaoyang/') OR (contains(source_url, 'stats.gov.cn') AND publish_date IS NOT NULL))""")
cte("host_units", [], values(lx.PUBLISHER_OF_HOST, "a", "c"))
cte("category_units", [], values(lx.PUBLISHER_OF_CATEGORY, "a", "c"))


def _found(x: str) -> str:
    return ("coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, {quote(p)}, 1)), '')" for p in (
        lx.PUBLISHER_LABEL_RE, lx.PUBLISHER_SOURCE_RE, lx.PUBLISHER_META_RE)) + ")")


_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_UNIT = f"""
, f AS (SELECT record_id, nullif(publish_unit, '') AS own, {_found("html")} AS page, h.c AS host, g.c AS cat FROM page_records p
 LEFT JOIN host_units h ON h.a = {_HOST.format(u="p.source_url")} LEFT JOIN category_units g ON g.a = p.category)
, z AS (SELECT record_id, coalesce(own, page, host, cat, '') AS publish_unit, CASE WHEN own IS NOT NULL THEN 'own' WHEN page IS NOT NULL THEN 'page'
  WHEN host IS NOT NULL THEN 'host' WHEN cat IS NOT NULL THEN 'category' ELSE 'missing' END AS unit_source FROM f)
"""
_UN = ["page_records", "host_units", "category_units"]
SQL["fill_publish_unit"] = with_(_UN, _UNIT + "SELECT * FROM z")
SQL["publish_unit_sources"] = with_(_UN, _UNIT + "SELECT unit_source, count(*) AS n FROM z GROUP BY 1")
SQL["page_hosts"] = f"SELECT {_HOST.format(u='url')} AS host, count(*) AS n FROM pages GROUP BY 1"

_ANCHOR = r"(增长|下降)(?:了)?\s*(-?\d+(?:\.\d+)?)\s*%"
cte("anchors", ["prose"], f"""
WITH q AS (SELECT doc_id, source_type, period, {squash("text")} AS t FROM prose)
, s AS (SELECT *, string_split_regex(t, '{_ANCHOR}') AS ps, regexp_extract_all(t, '{_ANCHOR}') AS xs, regexp_extract_all(t, '{_ANCHOR}', 1) AS vs,
  regexp_extract_all(t, '{_ANCHOR}', 2) AS ns FROM q WHERE regexp_matches(t, '{_ANCHOR}'))
, u AS (SELECT doc_id, source_type, period, unnest(xs) AS x, unnest(vs) AS verb, unnest(ns) AS percent, unnest(ps[1:len(xs)]) AS piece,
  CAST(generate_subscripts(xs, 1) - 1 AS INT) AS position FROM s)
SELECT doc_id, source_type, period, position, verb, percent,
 right(coalesce(string_agg(piece || x, '') OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || piece, 80) AS "window" FROM u""")
SQL["prose_anchors"] = with_("anchors", 'SELECT doc_id, position, "window", verb, percent FROM anchors')
_AMT = lx.PROSE_NUMBER_RE + r"\s*" + lx.PROSE_UNIT_RE
_GEN = lx.PROSE_GENERIC_RE + _AMT
_KNOWN = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(w, {quote(p)}) THEN {quote(n)} END" for p, n in reversed(lx.PROSE_NAME_RULES)) + ")"
SQL["prose_indicators"] = with_("anchors", f"""
, a AS (SELECT * EXCLUDE ("window"), "window" AS w FROM anchors)
, b AS (SELECT *, {_KNOWN} AS kn, regexp_extract_all(w, {quote(_AMT)}, 1)[-1] AS num, regexp_extract_all(w, {quote(_AMT)}, 2)[-1] AS un,
  regexp_replace(regexp_extract(w, {quote(_GEN)}, 1), '[，。、,：:]+$', '') AS other FROM a)
, c AS (SELECT doc_id, source_type, period, position, verb, CASE WHEN kn IS NOT NULL AND num IS NOT NULL THEN kn
   WHEN length(other) >= 2 AND NOT regexp_matches(other, {quote(lx.PROSE_STOP_RE)}) THEN other END AS indicator_name,
   CAST(replace(CASE WHEN kn IS NOT NULL AND num IS NOT NULL THEN num ELSE regexp_extract(w, {quote(_GEN)}, 2) END, ',', '').nullif('') AS DOUBLE) AS value,
   CASE WHEN kn IS NOT NULL AND num IS NOT NULL THEN un ELSE regexp_extract(w, {quote(_GEN)}, 3) END AS unit,
   CASE WHEN verb = '下降' THEN -CAST(percent AS DOUBLE) ELSE CAST(percent AS DOUBLE) END AS growth_rate FROM b)
SELECT doc_id, {no_blanks('indicator_name')} AS indicator_code, source_type, period, indicator_name, value, unit, growth_rate FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id, {no_blanks('indicator_name')} ORDER BY verb = '下降', position) AS rn
 FROM c WHERE indicator_name IS NOT NULL) WHERE rn = 1""")
SQL["json_payload_slices"] = with_("trace", """
SELECT step_id, concat(payload, ' end }') AS wide, regexp_extract(payload, '^\\{"text":"([^"]*)"', 1) AS text,
 regexp_extract(payload, '\\{"text":"([^"]*)"\\}\\}$', 1) AS answer FROM trace""")
SQL["numbers_from_text"] = """
SELECT raw, CASE m WHEN 2 THEN 1000 + k % 1000 + 0.5::DOUBLE WHEN 3 THEN -(k % 90 + 0.25::DOUBLE) WHEN 4 THEN (k % 7) * 1000.0::DOUBLE END AS number, count(*) AS n FROM (
 SELECT o_orderkey AS k, o_orderkey % 6 AS m, CASE o_orderkey % 6 WHEN 0 THEN '--' WHEN 1 THEN '' WHEN 2 THEN concat('1,', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), '.5')
 WHEN 3 THEN concat(' -', o_orderkey % 90, '.25% ') WHEN 4 THEN concat(o_orderkey % 7, '，000') ELSE '约三成' END AS raw FROM orders) GROUP BY 1, 2"""
