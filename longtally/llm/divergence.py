"""How far the sources of a language differ in their words: an audit over hash-consed segment trees.

Terms of a language are numbered by how often they occur: bands of totals within a factor of two, and inside a
band by code points. ``BLOCK`` consecutive numbers make a block, over which every group (language, source) has a
segment tree of its counts. Trees of a block are hash-consed: equal subtrees, such as the many without any
occurrence, are one node, whichever groups they come from. Two groups are compared by walking down their trees
at once, level by level; a pair of nodes that comes up several times is walked, and its leaves priced, only once.
A pair of blocks' prices are sums; Spark adds them up, which stands for the upper part of the trees.

A task holds one block of at most two tiles of ``TILE`` groups, so a language or a source of a third of all rows
is spread over blocks, and many sources over pairs of tiles. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, ranked, sent_if_few, shared, stored

#: Letters of any script but for ASCII's other characters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 2048
TILE = 64
#: Probabilities are whole numbers of this scale, plus one.
SCALE = 1_000_000_000
#: Terms listed for a group.
LEADING = 10
#: Entries of one walk over many pairs of trees.
AT_ONCE = 1 << 19

PRICED = "lang string, part string, number long, other long, band int, value long"


class Trees:
    """Hash-consed segment trees over the rows of ``counts`` (one row a group, one column a term)."""

    def __init__(self, counts: np.ndarray) -> None:
        groups, width = counts.shape
        self.values = np.unique(counts)
        full = 1 << max(width - 1, 0).bit_length()
        ids = np.zeros((groups, full), np.int64)  # node 0 of the leaves: no term
        ids[:, :width] = np.searchsorted(self.values, counts) + 1
        self.leaves = ids
        #: For each level above the leaves: node to left and right node below.
        self.below: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.values) + 1
        self.sizes = [size]
        while ids.shape[1] > 1:
            pairs, at = np.unique(ids[:, 0::2] * size + ids[:, 1::2], return_inverse=True)
            self.below.append((pairs // size, pairs % size))
            ids, size = at.reshape(groups, -1), len(pairs)
            self.sizes.append(size)
        self.roots = ids[:, 0]

    def walk(self, one: np.ndarray, two: np.ndarray, price) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prices of pairs of trees, and the keys and prices of the pairs of leaves that were priced.

        ``price`` gets, as arrays, a number of the pair of trees and a leaf of each.
        """
        pair, x, y, met = np.arange(len(one)), self.roots[one], self.roots[two], []
        for level in range(len(self.below), -1, -1):
            size = self.sizes[level]
            keys, at = np.unique((pair * size + x) * size + y, return_inverse=True)
            pair, x, y = keys // size // size, keys // size % size, keys % size
            met.append(at)
            if level:
                left, right = self.below[level - 1]
                pair, x, y = np.tile(pair, 2), np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
        prices = price(pair, x, y)
        sums = prices
        for level, at in enumerate(reversed(met)):
            sums = sums[at]
            if level < len(met) - 1:
                sums = sums[: len(sums) // 2] + sums[len(sums) // 2 :]
        return sums, keys, prices


def chances(values: np.ndarray, words: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (words + 2 * terms)), exact; a row a group, a column a count.

    Divides in three steps of a thousand, so nothing overflows below 9e15 words.
    """
    whole = (words + 2 * terms)[:, None]
    share, rest = np.divmod(values[None, :] + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        share = share * 1000 + digits
    return share + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _price(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Prices in one block: pairs of groups of the two tiles, and, in a tile's own unit, its groups' leading terms."""
    lang, band, block, one, two = key
    marks = rows[rows["place"] < 0].sort_values("number")
    numbers, width = marks["number"].to_numpy(), int(marks["width"].iloc[0])
    counts = np.zeros((len(numbers), width), np.int64)
    cells = rows[rows["place"] >= 0]
    counts[np.searchsorted(numbers, cells["number"]), cells["place"]] = cells["count"]
    groups = np.flatnonzero(numbers >= 0)  # the language itself has the number -1
    tile = numbers // TILE
    first, second = groups[tile[groups] == one], groups[tile[groups] == two]
    if one == two:
        a, b = np.triu_indices(len(first), 1)
        a, b = first[a], first[b]
    else:
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    pairs = {"lang": lang, "part": "pair", "number": numbers[a], "other": numbers[b], "band": 0}
    if not width:
        return pd.DataFrame({**pairs, "value": np.zeros(len(a), np.int64)})
    trees = Trees(counts)
    p = np.zeros((len(numbers), len(trees.values) + 1), np.int64)
    p[:, 1:] = chances(trees.values, marks["count"].to_numpy(), int(marks["terms"].iloc[0]))

    def walk(a: np.ndarray, b: np.ndarray):
        return trees.walk(a, b, lambda pair, x, y: np.where(x == 0, 0, gaps(p[a[pair], x], np.maximum(p[b[pair], y], 1))))

    step = max(AT_ONCE // width, 1)
    value = [walk(a[i : i + step], b[i : i + step])[0] for i in range(0, len(a), step)]
    out = [pd.DataFrame({**pairs, "value": np.concatenate(value) if value else np.zeros(0, np.int64)})]
    if one == two:
        whole = int(np.flatnonzero(numbers < 0)[0])
        for g in first:
            _, keys, prices = walk(np.array([g]), np.array([whole]))
            places = np.flatnonzero(counts[g] > 0)
            x, y = trees.leaves[g, places], trees.leaves[whole, places]
            prices = prices[np.searchsorted(keys, x * trees.sizes[0] + y)]
            more = p[g, x] > p[whole, y]
            places, prices = places[more], prices[more]
            best = np.lexsort((places, -prices))[:LEADING]
            out.append(pd.DataFrame(
                {"lang": lang, "part": "term", "number": numbers[g], "other": block * BLOCK + places[best], "band": band, "value": prices[best]}
            ))
    return pd.concat(out)


def term_counts(documents: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, count, total) of the terms in at least ``least`` documents of their language."""
    words = F.sort_array(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    sorted_words = documents.select("lang", "source", words.alias("ws"))
    # In the sorted words of a document, each term is flagged once.
    flagged = F.transform("ws", lambda t, i: F.struct(t.alias("term"), F.coalesce(t != F.get("ws", i - 1), F.lit(True)).alias("new")))
    cells = sorted_words.select("lang", "source", F.explode(flagged).alias("t")).groupBy("lang", "source", "t.term").agg(
        F.count("*").alias("count"), F.count_if("t.new").alias("docs")
    )
    of_term = Window.partitionBy("lang", "term")
    known = cells.withColumn("spread", F.sum("docs").over(of_term)).withColumn("total", F.sum("count").over(of_term))
    return known.where(F.col("spread") >= least).select("lang", "source", "term", "count", "total")


def divergence(documents: DataFrame, least: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) that occurs in ``documents``.

    ``part`` pair: ``item`` is each other source of the language, ``value`` the divergence between the two.
    ``part`` term: ``item`` is one of at most ``LEADING`` terms that the group uses more than its language does,
    ``value`` the term's share in that divergence. Ranks run by value, ties by code points.

    Null text, lang and source are empty ones. Each row is a document, also if it repeats another. Groups
    without terms take part with counts of zero; in a language without kept terms all pairs have the value 0.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    shared(spark)
    documents = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    cells = stored(term_counts(documents, least), "divergence-cells")
    band = F.floor(F.log2(F.col("total"))).cast("int")
    terms = stored(cells.groupBy("lang", "term").agg(F.first("total").alias("total")).withColumn("band", band), "divergence-terms")
    terms = ranked(terms, ["lang", "band"], ["term"], "at", "divergence-ranked")
    terms = terms.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long")).withColumn("place", F.col("at") % BLOCK)

    words = cells.groupBy("lang", "source").agg(F.sum("count").alias("words"))
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("words"))
    found = stored(documents.select("lang", "source").distinct().join(words, ["lang", "source"], "left"), "divergence-found")
    groups = ranked(found, ["lang"], ["source"], "number", "divergence-groups")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / TILE) + 1).cast("long").alias("tiles"))
    langs = tiles.join(vocabulary.withColumnRenamed("words", "lang_words"), "lang", "left").na.fill(0)
    langs = sent_if_few(stored(langs, "divergence-langs"))
    groups = sent_if_few(stored(groups.na.fill(0, ["words"]), "divergence-numbers"))

    # Each language has one block without terms, so that groups are paired where no term is kept.
    blocks = terms.groupBy("lang", "band", "block").agg(F.count("*").cast("int").alias("width"))
    blocks = blocks.union(tiles.select("lang", F.lit(-1), F.lit(0).cast("long"), F.lit(0)))
    zero, all_tiles = F.lit(0).cast("long"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    of_group = [F.least("tile", "u").alias("one"), F.greatest("tile", "u").alias("two")]
    of_lang = [F.col("u").alias("one"), F.col("u").alias("two")]
    unit = ["lang", "band", "block"]
    # Cells of a group go to its tile's unit with every tile; those of the language to each tile's own unit.
    numbered = groups.join(langs, "lang").withColumn("tile", F.floor(F.col("number") / TILE).cast("long"))
    dealt = numbered.select("lang", "source", "number", "words", "terms", "tile", F.explode(all_tiles).alias("u"))
    marks = dealt.join(blocks, "lang").select(*unit, *of_group, "number", F.lit(-1).cast("long").alias("place"), F.col("words").alias("count"), "terms", "width")
    whole = langs.join(blocks, "lang").select("*", F.explode(all_tiles).alias("u"))
    whole = whole.select(*unit, *of_lang, F.lit(-1).cast("long"), F.lit(-1).cast("long"), "lang_words", "terms", "width")
    placed = cells.join(terms.select("lang", "term", "band", "block", "place"), ["lang", "term"]).join(dealt, ["lang", "source"])
    placed = placed.select(*unit, *of_group, "number", "place", "count", zero, F.lit(0))
    totals = terms.join(langs, "lang").select(*unit, "place", "total", F.explode(all_tiles).alias("u"))
    totals = totals.select(*unit, *of_lang, F.lit(-1).cast("long"), "place", "total", zero, F.lit(0))
    rows = marks.union(whole).union(placed).union(totals)
    priced = stored(rows.groupBy(*unit, "one", "two").applyInPandas(_price, PRICED), "divergence-priced")

    sums = priced.where("part = 'pair'").groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    sums = sums.union(sums.select("lang", F.col("other"), F.col("number"), "value"))
    name = groups.select("lang", "number", "source")
    pairs = sums.join(name, ["lang", "number"]).join(name.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    leading = priced.where("part = 'term'").join(name, ["lang", "number"]).join(
        terms.select("lang", "band", F.col("at").alias("other"), F.col("term").alias("item")), ["lang", "band", "other"]
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return told(pairs, "pair").union(told(leading, "term").where(F.col("rank") <= LEADING))
