"""Sheet layouts, prose and pages against literal fixtures."""

import datetime
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from longtally.operators import prose, sheets
from longtally.sources import elements, landed


def grid(spark, rows, title="2025年9月月报卡数据", sheet="s"):
    date = datetime.date(2025, 10, 20)
    cells = [(1, title, date, sheet, i, j, str(v)) for i, r in enumerate(rows) for j, v in enumerate(r) if v != ""]
    return spark.createDataFrame(cells, "doc_id long, doc_title string, doc_date date, sheet string, row long, col int, text string")


def rows_of(spark, rows, **kw):
    got = sheets.indicator_rows(grid(spark, rows, **kw)).collect()
    return {(r.indicator_name, r.region, r.period): (r.value, r.unit, r.growth_rate) for r in got}


def test_region_table(spark):
    got = rows_of(spark, [
        ["地区生产总值"], [""], ["地  区", "2025年1-9月"], ["", "绝对额(万元)", "增速(%)", "排名"],
        ["全市", 19746101, 4.958], ["新宁", 1041963.13, 4.5, 10], ["邵东", 1655627, 6.4, 1],
    ])
    p = "2025年1-9月"
    assert got[("地区生产总值", "新宁县", p)] == (1041963.13, "万元", 4.5)
    assert got[("地区生产总值排名", "新宁县", p)] == (10.0, "名", None)
    assert len(got) == 5


def test_indicator_table(spark):
    got = rows_of(spark, [
        ["财政"], ["项  目", "1-9月"], ["", "绝对额(万元)", "增长（%）"], ["地方一般公共预算收入", 861488, -6.2490],
    ])
    assert got == {("地方一般公共预算收入", "全市", "2025年1-9月"): (861488.0, "万元", -6.249)}


def test_growth_table_and_matrix(spark):
    got = rows_of(spark, [["工业"], ["行  业", "1-9月"], ["", "增速（%）"], ["煤炭开采和洗选业", -37.0531]])
    assert got == {("煤炭开采和洗选业", "全市", "2025年1-9月"): (None, None, -37.0531)}
    assert rows_of(spark, [["对比"], ["年份", "总额"], ["2020", 5]]) == {}
    assert rows_of(spark, [["目录"], ["项目", "总额"], ["a", 5]], sheet="目录") == {}


def test_year_from_column_and_title(spark):
    header_year = rows_of(spark, [["t"], ["指标", "2023年", ""], ["", "1-12月", "增速(%)"], ["a产值", 5, 1]], title="2024年2月月报卡")
    assert list(header_year)[0][2] == "2023年1-12月"
    from_title = rows_of(spark, [["t"], ["指标", "本月止累计"], ["a产值", 5]], title="2021年12月月报卡数据")
    assert list(from_title)[0][2] == "2021年1-12月"


def test_late_rows_are_read(spark):
    rows = [["t"], ["指标", "总额"]] + [[f"指标{i}x", i] for i in range(400)]
    assert len(rows_of(spark, rows)) == 400


PROSE = (
    "前三季度，全市实现地区生产总值2883.5亿元、增长0.2%。其中，第一产业完成增加值467.4亿元、增长3.9%，"
    "第二产业增加值940.0亿元、下降8.4%，第三产业增加值1476.1亿元、增长5.6%。社会消费品零售总额达到980.5亿元、增长5.8%。"
)


def extract(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.indicator_name, r.value, r.unit, r.growth_rate) for r in prose.extract_indicators(df).collect()]


def test_prose(spark):
    got = {(v, g) for _, v, _, g in extract(spark, PROSE)}
    assert got == {(2883.5, 0.2), (467.4, 3.9), (940.0, -8.4), (1476.1, 5.6), (980.5, 5.8)}


def test_prose_reads_whole_text(spark):
    long = "甲乙丙丁 " * 20000 + PROSE
    assert len(extract(spark, long)) == 5
    assert extract(spark, "增长 5%") == []


def test_page_text(spark):
    html = (
        '<UCAPCONTENT><p>实现地区生产总值<span>2883</span><span>.5</span>亿元&nbsp;。</p><p>短</p><p>版权所有：某某</p>'
        '<a href="abc/files/1.xlsx">附件下载地址</a><script>var x = "隐藏文字";</script></UCAPCONTENT><p>页脚之外的文字</p>'
    )
    row = landed.extract_pages(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert "2883.5亿元" in row.content and "版权" not in row.content and "隐藏" not in row.content and "页脚" not in row.content
    assert row.attachment_url == "abc/files/1.xlsx"


def test_list_page(spark):
    html = (
        '<ul><li class="row"><a href="/x/1.shtml">通知公告</a><a href="/x/2.shtml">关于发布统计月报的通知</a> 2023-05-06 发布单位：某市统计局</li>'
        '<li class="nav-bar menu"><a href="/x/3.shtml">一个足够长的标题文字</a></li>'
        '<li><a href="javascript:go()">一个足够长的标题</a></li><li><a href="/login">登录到本站系统</a></li></ul>'
    )
    df = spark.createDataFrame([(1, "https://h.org/l/", html)], "id int, url string, html string")
    rows = landed.list_records(df, "id").collect()
    assert [(r.title, str(r.publish_date), r.publish_unit, r.source_url) for r in rows] == [
        ("关于发布统计月报的通知", "2023-05-06", "某市统计局", "https://h.org/x/2.shtml")
    ]
    reasons = {r.title: r.reasons for r in landed.page_links(df, "id").collect()}
    assert reasons["通知公告"] == ["exact title:通知公告"] and reasons["一个足够长的标题文字"] == ["container:nav"]


def test_publish_unit_order(spark):
    rows = [
        (1, "https://tjj.hunan.gov.cn/a", "政策文件", "", "<p>发布单位：某市财政局</p>"),
        (2, "https://tjj.hunan.gov.cn/a", "政策文件", "", ""), (3, "https://other.org/a", "政策文件", None, ""),
        (4, "https://other.org/a", "别的", "", ""), (5, "https://tjj.hunan.gov.cn/a", "政策文件", "自有", ""),
    ]
    df = spark.createDataFrame(rows, "record_id int, source_url string, category string, publish_unit string, html string")
    got = {r.record_id: r.unit_source for r in landed.fill_publish_unit(df).collect()}
    assert got == {1: "page", 2: "host", 3: "category", 4: "missing", 5: "own"}


def links_of(spark, html):
    df = spark.createDataFrame([(1, "https://h.org/l/", html)], "id int, url string, html string")
    return df, {r.title: (r.href, r.reasons) for r in landed.page_links(df, "id").collect()}


def test_list_items_know_what_encloses_them(spark):
    _, links = links_of(spark, """
        <body class="nav"><div class="side Nav"><ul><li><a href="/a.html">机构设置与职能介绍</a></li></ul></div>
        <div id='x-crumb'><table><tr><td><a href='/b.html'>单引号的链接标题</a></td></tr></table></div>
        <div class="navigator"><ul><li><a class=x href=/c.html>没有引号的链接标题</a></li></ul></div></body>""")
    assert links == {
        "机构设置与职能介绍": ("/a.html", ["container:nav"]), "单引号的链接标题": ("/b.html", ["container:crumb"]), "没有引号的链接标题": ("/c.html", [])
    }


def test_nested_list_items_stay_apart(spark):
    df, links = links_of(spark, """<ul><li class="outer">甲<ul><li><a href="/in1.html">内层条目一的标题</a> 2024-01-02</li>
        <li><a href="/in2.html?a=1&amp;b=2">内层<b>条目</b>二</a></ul> 乙 <a href="/out.html">外层条目自己的标题文字</a> 2024-03-04</li></ul>
        <!-- <li><a href="/no.html">注释里的链接标题</a></li> --><script>"<li><a href='/no.html'>脚本里的链接</a></li>"</script>""")
    assert set(links) == {"内层条目一的标题", "内层条目二", "外层条目自己的标题文字"} and links["内层条目二"][0] == "/in2.html?a=1&b=2"
    rows = landed.list_records(df, "id").orderBy("item").collect()
    assert [(r.item, r.title, r.summary) for r in rows] == [
        (0, "外层条目自己的标题文字", "甲 内层条目一的标题 2024-01-02 内层 条目 二 乙 外层条目自己的标题文字 2024-03-04"),
        (1, "内层条目一的标题", "内层条目一的标题 2024-01-02"), (2, "内层条目二", "内层 条目 二"),
    ]


class Tree(HTMLParser):
    """Open elements on a stack, as plain code."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.made, self.at, self.void = [], [], 0, elements.VOID
        self.feed(html)
        self.close()
        self.made += [(at, self.at, name, path) for at, name, path in self.stack]

    def handle_starttag(self, tag, attrs):
        if tag not in self.void:
            values = dict(attrs)
            own = [values[k] for k in ("class", "id") if k in values]
            above = [self.stack[-1][2]] if self.stack else []
            self.stack.append((self.at, tag, "" if tag == "body" else " ".join(above + ([" ".join(own)] if own else []))))
        self.at += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.void:
            at, name, path = self.stack.pop()
            self.made.append((at, at, name, path))

    def handle_endtag(self, tag):
        opened = [i for i, s in enumerate(self.stack) if s[1] == tag]
        if opened and tag not in self.void:
            self.made += [(at, self.at, name, path) for at, name, path in self.stack[opened[-1]:]]
            del self.stack[opened[-1]:]
        self.at += 1


SOUP = ["<li>", "<LI class='a b'>", '<li id="x">', "</li>", "<ul class=u>", "</ul>", "<div id=d class='c'>", "</div>", "<a href=/x>", "</a>", "<p>", "</p>",
        "<br>", "<br/>", "<tr/>", "<tr>", "</tr>", "</em>", "<body class=n>", "</body>", "text", " 1 < 2 "]


def test_elements_of_any_soup_of_tags(spark):
    rng = random.Random(3)
    soups = ["".join(rng.choices(SOUP, k=rng.randint(0, 40))) for _ in range(150)] + ["".join(rng.choices(SOUP, k=3 * elements.PART + 7)), "", "<li>" * 600]
    df = spark.createDataFrame(list(enumerate(soups)), "i int, html string").withColumn("tags", elements.tags(F.col("html")))
    got = df.select("i", F.size("tags").alias("n"), F.size(elements.texts(F.col("html"))).alias("texts"), elements.elements(F.col("tags"), ("li", "tr", "a")).alias("e"))
    for r in got.collect():
        tree = Tree(soups[r.i])
        want = sorted((at, closed, name, " ".join(path.split())) for at, closed, name, path in tree.made if name in ("li", "tr", "a"))
        assert [(e.at, e.closed, e.name, " ".join(e.path.split())) for e in r.e] == want, soups[r.i]
        assert r.texts == r.n + 1


def test_pages_without_html(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<li>no link")], "id int, url string, html string")
    assert landed.page_links(df, "id").count() == landed.list_records(df, "id").count() == 0


def test_filled_cells_trims_a_cell_once(spark):
    texts = ["", " ", "　 \t", " a ", "b\n", " c d　", "年份", None]
    names = ["目录1", " 　目录", "封面", "工业目录", "a封面", "", None]
    rows = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in names for t in texts)]
    out = sheets.filled_cells(spark.createDataFrame(rows, "id long, sheet string, text string"))
    kept = {i: t.strip() for i, s, t in rows if t and t.strip() and s is not None and not s.strip().startswith(("目录", "封面"))}
    assert {r["id"]: r["text"] for r in out.collect()} == kept and len(kept) == 12
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1  # not in the filter as well, nor on sheet names
