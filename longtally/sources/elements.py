"""The element tree of a page, as Column expressions over its list of tags.

A page is cut once into tags and the texts between them; text i stands before tag i. A fold over the tags
keeps the stack of open elements, so an element is the interval from its opening tag to the tag that closes
it, and its path is what the stack held. An end tag closes the latest open element of its name and all that
were opened after it; one without an open element is passed over; what is still open at the end closes there.
Comments, scripts, styles and declarations are neither tags nor text. One page is one row: nothing shuffles,
and the fold works in parts, so its lists are never copied as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Named entities that occur in running text; '&' comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_TAG = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!\w[^>]*>"
    r"""|</?[a-z][^\s/>]*+(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
)
#: Tags folded at a time.
PART = 256

_STACK = "array<struct<at:int,name:string,path:string>>"
#: An element: number of its opening tag, number of the tag that closes it, name, and path (classes and ids from the body down to it).
ELEMENTS = "array<struct<at:int,closed:int,name:string,path:string>>"


def tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))


def texts(html: Column) -> Column:
    """The texts between the tags: one more than there are tags."""
    return F.split(html, _TAG, -1)


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; null if the tag does not have it."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.when(raw != "", decoded(F.regexp_replace(raw, """^["']|["']$""", "")))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def elements(tags: Column, names: tuple[str, ...]) -> Column:
    """The elements of the given names in order of their opening tags."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1))
    sign = lambda t: F.when(t.rlike(r"(?i)\b(?:class|id)\s*="), F.concat_ws(" ", attribute(t, "class"), attribute(t, "id")))
    marks = F.transform(tags, lambda t, i: F.struct(
        i.alias("at"), name(t).alias("name"), F.startswith(t, F.lit("</")).alias("closing"), F.endswith(t, F.lit("/>")).alias("empty"), sign(t).alias("sign")
    ))
    marks = F.filter(marks, lambda m: (m["name"] != "") & ~m["name"].isin("script", "style", *VOID))
    wanted = lambda s: s["name"].isin(*names)
    done = lambda s, at: F.struct(s["at"].alias("at"), at.cast("int").alias("closed"), s["name"].alias("name"), s["path"].alias("path"))
    nothing = lambda kind: F.array().cast(kind)

    def opened(state: Column, m: Column) -> Column:
        above = F.try_element_at(state["stack"], F.lit(-1))["path"]
        path = F.when(m["name"] == "body", F.lit("")).otherwise(F.concat_ws(" ", above, m["sign"]))
        node = F.struct(m["at"].alias("at"), m["name"].alias("name"), path.alias("path"))
        return F.when(m["empty"], F.struct(
            state["stack"].alias("stack"), F.when(wanted(m), F.concat(state["made"], F.array(done(node, m["at"])))).otherwise(state["made"]).alias("made")
        )).otherwise(F.struct(F.concat(state["stack"], F.array(node)).alias("stack"), state["made"].alias("made")))

    def closed(state: Column, m: Column) -> Column:
        latest = F.array_max(F.transform(F.filter(state["stack"], lambda s: s["name"] == m["name"]), lambda s: s["at"]))
        return _let(latest, lambda at: F.when(at.isNull(), state).otherwise(F.struct(
            F.filter(state["stack"], lambda s: s["at"] < at).alias("stack"),
            F.concat(state["made"], F.transform(F.filter(state["stack"], lambda s: (s["at"] >= at) & wanted(s)), lambda s: done(s, m["at"]))).alias("made"),
        )))

    step = lambda state, m: F.when(m["closing"], closed(state, m)).otherwise(opened(state, m))
    parts = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor(F.size(marks) / PART).cast("int")), lambda p: p * PART < F.size(marks)), lambda p: F.slice(marks, p * PART + 1, PART)
    )
    whole = F.aggregate(
        parts,
        F.struct(nothing(_STACK).alias("stack"), nothing(f"array<{ELEMENTS}>").alias("made")),
        lambda state, part: F.aggregate(
            part, F.struct(state["stack"].alias("stack"), nothing(ELEMENTS).alias("made")), step,
            lambda last: F.struct(last["stack"].alias("stack"), F.concat(state["made"], F.array(last["made"])).alias("made")),
        ),
        lambda last: F.concat(F.flatten(last["made"]), F.transform(F.filter(last["stack"], wanted), lambda s: done(s, F.size(tags)))),
    )
    return F.sort_array(whole)


def inside(element: Column, texts: Column, between: str) -> Column:
    """Texts in an element, with ``between`` where tags stood."""
    return decoded(F.array_join(F.slice(texts, element["at"] + 2, element["closed"] - element["at"]), between))
