"""String functions on Columns: cleaning, names, units, numbers, URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import lexicon as lx


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space as Unicode has it; Java's ``\s`` alone takes ASCII blanks only.
OTHER_BLANKS = r"\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = rf"[\s{OTHER_BLANKS}]"


def squash(c: Column) -> Column:
    """Collapse white space, full-width blanks included, to one blank and trim.

    Single blanks, by far the most common case, are left untouched by the pattern.
    """
    return F.trim(F.regexp_replace(c, rf"(?:[\t-\r{OTHER_BLANKS}]| (?={BLANK})){BLANK}*", " "))


def squash_ascii(c: Column) -> Column:
    """The same for ASCII white space only."""
    return F.trim(F.regexp_replace(c, r"(?:[^\S ]| (?=\s))\s*", " "))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, BLANK + "+", "")


def trim_blanks(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def contains_any(c: Column, words) -> Column:
    """True where the text holds at least one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"<[^>]+>|{BLANK}+", " "))


def clean_title_numbering(c: Column) -> Column:
    """Drop numbering such as "一、" or "（一）" and edge punctuation."""
    c = F.regexp_replace(squash(c), r"^[一二三四五六七八九十]+、", "")
    c = F.regexp_replace(c, r"^[（(][一二三四五六七八九十]+[)）]", "")
    return F.regexp_replace(c, rf"^[\s{OTHER_BLANKS}:：\-—]+|[\s{OTHER_BLANKS}:：\-—]+$", "")


def normalise_name(c: Column) -> Column:
    """Half-width brackets, no blanks, no leading numbering, no trailing punctuation."""
    c = F.translate(F.trim(c), "（）　 ", "()")
    c = F.regexp_replace(c, lx.NAME_PREFIX_RE, "")
    return F.regexp_replace(c, lx.NAME_TRAIL_RE, "")


def strip_wrapper(c: Column) -> Column:
    """Drop one leading wrapper word such as "全市" or "其中:"."""
    return F.regexp_replace(c, lx.NAME_WRAP_RE, "")


def strip_verbs(c: Column) -> Column:
    return F.regexp_replace(c, lx.NAME_VERB_RE, "")


def strip_rank(c: Column) -> Column:
    return F.regexp_replace(c, lx.RANK_SUFFIX + "$", "")


def is_noise_sentence(c: Column) -> Column:
    return c.rlike(lx.NAME_NOISE_RE)


def tree_key(c: Column) -> Column:
    """Name key of the taxonomy: half-width brackets and colon, no blanks."""
    return F.translate(c, "（）： ", "():")


def paren_unit(c: Column) -> Column:
    """Unit in the first bracket if it holds a CJK character or %, else ''."""
    unit = F.trim(F.regexp_extract(c, lx.PAREN_UNIT_RE, 1))
    return F.when(unit.rlike(lx.UNIT_CHARS_RE), unit).otherwise(F.lit(""))


def unit_by_name(c: Column) -> Column:
    """First unit whose pattern matches the name, else ''."""
    out = F.lit("")
    for pattern, unit in reversed(lx.UNIT_BY_NAME_RULES):
        out = F.when(c.rlike(pattern), F.lit(unit)).otherwise(out)
    return out


def to_number(c: Column) -> Column:
    """Number text to double; separators, % and blanks dropped; placeholders and Java suffixes such as 12d null."""
    bare = F.regexp_replace(c, rf"[,，%\s{OTHER_BLANKS}]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def ellipsis(c: Column, limit: int = 60) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def plain_number(c: Column) -> Column:
    """Print a double; whole numbers below 1e15 lose their fraction."""
    whole = (c == F.rint(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def decimal_places(c: Column) -> Column:
    """Digits after the point of a decimal, trailing zeros not counted."""
    tail = F.element_at(F.split(c.cast("string"), r"\."), -1)
    return F.length(F.regexp_replace(tail, "0+$", ""))


def csv_list(c: Column) -> Column:
    """Comma list to array: trimmed, empty items dropped, first occurrence kept."""
    items = F.transform(F.split(c, "[,，]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def host_of(url: Column) -> Column:
    """Lower-case authority of a URL, port included; '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def absolute_url(base: Column, href: Column) -> Column:
    """Join a link with the page it was found on: absolute, rooted or relative."""
    scheme_host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*/)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(path)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("/"), F.concat(scheme_host, href))
        .otherwise(F.concat(scheme_host, folder, href))
    )


def cjk_tokens(c: Column) -> Column:
    """Greedy, non-overlapping runs of two to six CJK characters."""
    return F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}]{2,6}"), F.lit(0))


def json_slice(c: Column, left: str = "{", right: str = "}") -> Column:
    """Text from the first opening to the last closing bracket, null when absent."""
    start = F.locate(left, c)
    stop = F.length(c) - F.locate(right, F.reverse(c)) + 1
    return F.when(
        (start > 0) & (F.locate(right, c) > 0) & (stop > start), F.substring(c, start, stop - start + 1)
    )


def find_date(c: Column) -> Column:
    """First date in the text as a DATE, null when absent or impossible."""
    part = lambda i: F.regexp_extract(c, lx.DATE_RE, i)
    text = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return text.try_cast("date")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed group of the first match, null when nothing matched."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def find_publisher(c: Column) -> Column:
    """Publishing unit named in a page: label, then source line, then meta tag."""
    return F.coalesce(
        first_match(c, lx.PUBLISHER_LABEL_RE),
        first_match(c, lx.PUBLISHER_SOURCE_RE),
        first_match(c, lx.PUBLISHER_META_RE),
    )
