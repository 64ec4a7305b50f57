"""Landed web pages to texts, list records and publishing units.

List pages are read through their element tree, other pages by regular expressions
on the whole HTML text; one page is one row, so nothing here shuffles except where
records are merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import text
from . import elements

_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def visible_text(html: Column) -> Column:
    """Text between tags; scripts, styles and comments are dropped, entities decoded."""
    return elements.decoded(F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), r"<[^>]*>", ""))


def page_content(html: Column) -> Column:
    """Main part of a detail page: content tag, else content div, else all of it."""
    tagged = F.regexp_extract(html, r"(?is)<UCAPCONTENT>(.*?)</UCAPCONTENT>", 1)
    boxed = F.regexp_extract(html, r'(?s)<div[^>]*class="wenz"[^>]*>(.*?)</div>\s*</div>', 1)
    return F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(boxed, F.lit("")), html)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Body text (one line per paragraph, noise lines dropped) and workbook link."""
    content = page_content(F.col(html))
    broken = F.regexp_replace(content, r"</p>|</div>|<br\s*/?>", "\n")
    lines = F.transform(F.split(visible_text(broken), "\n"), text.squash)
    kept = F.filter(lines, lambda l: (F.length(l) >= 4) & ~l.rlike(lx.PAGE_NOISE_RE))
    link = F.regexp_extract(content, r'(?i)href="([^"]+\.(?:xlsx|xls))"', 1)
    return pages.withColumns({
        "content": F.array_join(kept, "\n"), "attachment_url": F.nullif(link, F.lit(""))
    }).drop(html)


def _first_in(haystack: Column, words) -> Column:
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(haystack, F.lower(w))), F.lit(0))


def link_reasons(title: Column, href: Column, signature: Column, min_length: int = 4, allow_href=(), allow_container=()) -> Column:
    """Why a link is navigation noise; an empty array means it is kept."""
    tokens = F.split(F.lower(signature), "[^0-9a-z]+")
    say = lambda hit, word: F.when(hit.isNotNull(), F.concat(F.lit(word + ":"), hit))
    container = F.get(F.filter(F.array(*[F.lit(w) for w in lx.CONTAINER_BLACKLIST]), lambda w: F.array_contains(tokens, w)), F.lit(0))
    reasons = [
        F.when(F.length(title) < min_length, F.lit("short title")),
        say(_first_in(F.lower(title), lx.TITLE_BLACKLIST), "title"),
        F.when(title.isin(lx.TITLE_EXACT_BLACKLIST), F.concat(F.lit("exact title:"), title)),
        say(_first_in(F.lower(href), lx.HREF_BLACKLIST), "href"),
        say(container, "container"),
    ]
    if allow_href:
        reasons.append(F.when(_first_in(F.lower(href), allow_href).isNull(), F.lit("href not allowed")))
    if allow_container:
        allowed = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in allow_container]))
        reasons.append(F.when(~allowed, F.lit("container not allowed")))
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def usable_href(href: Column) -> Column:
    low = F.lower(href)
    bad = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in ("#", "javascript", "mailto:", "tel:")])
    return (href != "") & ~bad


def _items(pages: DataFrame, key: str, url: str, html: str, with_text: bool = False) -> DataFrame:
    """List items and table rows, nested ones too, with the classes and ids of all that encloses them.

    ``links`` are the usable links anywhere inside; ``text`` is all of an item's text, if asked for.
    """
    cut = pages.select(key, url, elements.tags(F.col(html)).alias("_tags"), elements.texts(F.col(html)).alias("_texts"))
    cut = cut.withColumn("_elements", elements.elements(F.col("_tags"), ("li", "tr", "a")))
    tag = lambda e: F.get("_tags", e["at"])
    anchors = F.transform(F.filter("_elements", lambda e: e["name"] == "a"), lambda e: F.struct(
        e["at"].alias("at"), text.trim_blanks(elements.attribute(tag(e), "href")).alias("href"),
        text.squash(elements.inside(e, F.col("_texts"), "")).alias("title"),
    ))
    cut = cut.withColumn("_anchors", F.filter(anchors, lambda a: a["href"].isNotNull()))
    within = lambda e: F.transform(
        F.filter("_anchors", lambda a: (a["at"] > e["at"]) & (a["at"] < e["closed"])),
        lambda a, i: F.struct(i.alias("link"), a["href"].alias("href"), a["title"].alias("title")),
    )
    facts = lambda e, i: F.struct(
        i.alias("item"), e["path"].alias("signature"), F.filter(within(e), lambda a: usable_href(a["href"])).alias("links"),
        *([text.squash(elements.inside(e, F.col("_texts"), " ")).alias("text")] if with_text else []),
    )
    return cut.select(key, url, F.inline(F.transform(F.filter("_elements", lambda e: e["name"] != "a"), facts)))


def page_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Usable links of every list item or table row, with the reasons against each.

    A link inside nested items belongs to each of them.
    """
    links = _items(pages, key, url, html).select(key, "item", "signature", F.inline("links"))
    return links.withColumn("reasons", link_reasons(F.col("title"), F.col("href"), F.col("signature")))


def list_records(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """One record per item that keeps a link: the longest title wins, facts come from the item's text.

    The best link is chosen inside the item's link array, so pages never shuffle.
    """
    clean = F.filter("links", lambda x: F.size(link_reasons(x["title"], x["href"], F.col("signature"))) == 0)
    ranked = F.transform(clean, lambda x: F.struct(
        F.length(x["title"]).alias("n"), (-x["link"]).alias("first"), x["title"].alias("title"), x["href"].alias("href")))
    rows = _items(pages, key, url, html, with_text=True).filter(F.size("links") > 0).withColumn("_best", F.array_max(ranked))
    rows = rows.filter(F.col("_best").isNotNull())
    return rows.select(
        key, "item", F.col("_best.title").alias("title"),
        F.coalesce(text.first_match(F.col("text"), lx.DOC_NO_RE, 0), F.lit("")).alias("doc_no"),
        F.coalesce(text.first_match(F.col("text"), lx.PUBLISHER_LABEL_RE), F.lit("")).alias("publish_unit"),
        F.coalesce(text.first_match(F.col("text"), lx.CATEGORY_LABEL_RE), F.lit("")).alias("category"),
        text.find_date(F.col("text")).alias("publish_date"),
        text.absolute_url(F.col(url), F.col("_best.href")).alias("source_url"),
        F.substring("text", 1, 200).alias("summary"),
    )


def simple_list_records(pages: DataFrame, key: str, internal, external, url: str = "url", html: str = "html") -> DataFrame:
    """Records of a plain list page: links to .html pages inside the list box, dated by their URL.

    Links off the internal hosts need a date in the URL; other hosts are dropped.
    """
    box = F.regexp_extract(F.col(html), r'(?s)<ul[^>]*class="[^"]*infoList[^"]*"[^>]*>(.*?)</ul>', 1)
    body = F.when(box == "", F.col(html)).otherwise(box)
    anchor = r'(?s)<a[^>]+href="([^"]+\.(?:shtml|html))"[^>]*>(.*?)</a>'
    pair = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all(body, F.lit(anchor), F.lit(2)).alias("label"),
    )
    links = pages.select(key, url, F.posexplode(pair).alias("position", "a")).select(
        key, "position", text.strip_tags(F.col("a.label")).alias("title"),
        text.absolute_url(F.col(url), F.col("a.href")).alias("source_url"),
    ).filter(F.length("title") >= 4)
    exact, month = r"/t(20\d{2})(\d{2})(\d{2})_", r"/(20\d{2})(\d{2})/"
    part = lambda p, i: F.regexp_extract("source_url", p, i)
    date = F.when(
        F.col("source_url").rlike(exact), F.concat_ws("-", part(exact, 1), part(exact, 2), part(exact, 3))
    ).when(F.col("source_url").rlike(month), F.concat(part(month, 1), F.lit("-"), part(month, 2), F.lit("-01")))
    links = links.withColumn("publish_date", date.try_cast("date"))
    inside, outside = (text.contains_any(F.col("source_url"), hosts) for hosts in (internal, external))
    return links.filter(inside | (outside & F.col("publish_date").isNotNull()))


def fill_publish_unit(records: DataFrame, html: str = "html") -> DataFrame:
    """Complete blank publishing units: the page's own text, then its host, then its category.

    Adds ``unit_source``. Both maps are fixed tables and are broadcast.
    """
    spark = records.sparkSession
    hosts = lx.lookup_frame(spark, lx.PUBLISHER_OF_HOST, "_h", "_host_unit")
    categories = lx.lookup_frame(spark, lx.PUBLISHER_OF_CATEGORY, "_c", "_category_unit")
    own = F.nullif(F.coalesce("publish_unit", F.lit("")), F.lit(""))
    out = (
        records.withColumn("_own", own)
        .withColumn("_page", F.when(own.isNull(), text.find_publisher(F.col(html))))
        .join(F.broadcast(hosts), text.host_of(F.col("source_url")) == F.col("_h"), "left")
        .join(F.broadcast(categories), F.col("category") == F.col("_c"), "left")
    )
    source = (
        F.when(F.col("_own").isNotNull(), "own").when(F.col("_page").isNotNull(), "page")
        .when(F.col("_host_unit").isNotNull(), "host").when(F.col("_category_unit").isNotNull(), "category")
        .otherwise("missing")
    )
    return out.withColumn("publish_unit", F.coalesce("_own", "_page", "_host_unit", "_category_unit", F.lit(""))).withColumn(
        "unit_source", source
    ).drop("_own", "_page", "_h", "_host_unit", "_c", "_category_unit", html)
