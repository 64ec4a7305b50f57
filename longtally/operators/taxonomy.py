"""Indicator taxonomy: ordered classification rules, tree building, leaf matching.

Ordered rules become one CASE per distinct (sheet, name), so classifying needs no
join with a rule table; the tree is a handful of lookups joined by code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import text
from .runs import numbered


def _first_rule(conditions: list[Column], results: list, fallback) -> Column:
    pairs = list(zip(conditions, results))
    return reduce(lambda other, cr: F.when(cr[0], cr[1]).otherwise(other), reversed(pairs), fallback)


def _matches(c: Column, pattern: str | None) -> Column:
    return c.rlike(pattern) if pattern else F.lit(True)


def classify(df: DataFrame, sheet: str = "sheet_name", name: str = "indicator_name") -> DataFrame:
    """Category, sub-category and fixed unit by sheet first, then name keywords."""
    s, n = F.col(sheet), F.col(name)
    category = _first_rule(
        [s.rlike(sp) & _matches(n, yes) & (~n.rlike(no) if no else F.lit(True)) for sp, yes, no, _ in lx.CATEGORY_RULES],
        [F.lit(r[3]) for r in lx.CATEGORY_RULES], F.lit(lx.CATEGORY_FALLBACK),
    )
    out = df.withColumn("category", category)
    c = F.col("category")
    sub = _first_rule(
        [(c == cat) & _matches(n, p1) & _matches(n, p2) for cat, p1, p2, _ in lx.SUBCATEGORY_RULES],
        [F.lit(r[3]) for r in lx.SUBCATEGORY_RULES], F.lit(None).cast("string"),
    )
    fixed = _first_rule(
        [(F.lit(True) if cat is None else c == cat) & _matches(n, p) for cat, p, _ in lx.FIXED_UNIT_RULES],
        [F.lit(r[2]) for r in lx.FIXED_UNIT_RULES], F.lit(None).cast("string"),
    )
    return out.withColumns({"sub_category": sub, "unit_fixed": fixed})


def classify_leaf(df: DataFrame, sheet: str = "sheet_name", name: str = "indicator_name") -> DataFrame:
    """Category and sub-category of a tree leaf; unknown sheets fall back to one node."""
    s, n = F.col(sheet), F.col(name)
    conditions = [s.rlike(sp) & _matches(n, np) for sp, np, _, _ in lx.LEAF_RULES]
    place = lambda c, sub: F.struct(F.lit(c).alias("category"), F.lit(sub).alias("sub_category"))
    rule = _first_rule(conditions, [place(c, sub) for _, _, c, sub in lx.LEAF_RULES], place(*lx.TREE_FALLBACK))
    return df.withColumn("_r", rule).select("*", "_r.*").drop("_r")


def dictionary(raw: DataFrame) -> DataFrame:
    """One row per indicator code: a name, a sheet, its class, and its units without bad ones.

    Units are distinct before they are collected, so the list is bounded by the
    number of unit labels.
    """
    rows = raw.groupBy("indicator_code").agg(
        F.min("indicator_name").alias("indicator_name"), F.max("sheet_name").alias("sheet_name"), F.count(F.lit(1)).alias("rows")
    )
    units = raw.filter((F.coalesce("unit", F.lit("")) != "") & ~F.col("unit").isin(lx.BAD_UNITS)).select("indicator_code", "unit").distinct()
    listed = units.groupBy("indicator_code").agg(F.array_join(F.sort_array(F.collect_list("unit")), "|").alias("_units"))
    out = classify(rows).join(listed, "indicator_code", "left")
    return out.withColumn("unit_fixed", F.coalesce("unit_fixed", "_units")).drop("_units")


def fixed_nodes(spark) -> DataFrame:
    """Levels one and two of the tree, with the fallback node."""
    rows = []
    for i, (category, subs) in enumerate(lx.TREE.items(), 1):
        code = f"c{i:02d}"
        rows.append((code, category, 1, i, None))
        named = subs + ([("other", lx.TREE_FALLBACK[1])] if category == lx.TREE_FALLBACK[0] else [])
        rows += [(f"{code}_{slug}", name, 2, j, code) for j, (slug, name) in enumerate(named, 1)]
    return lx.lookup_frame(spark, rows, "code", "name", "level", "sort", "parent_code")


def build_tree(leaves: DataFrame) -> DataFrame:
    """Three-level node table from leaves (indicator_name, sheet_name), one row per name.

    Leaf codes number the distinct names in order; the list of names is the
    dictionary's size, whatever the number of rows behind it.
    """
    upper = fixed_nodes(leaves.sparkSession)
    top = upper.filter("level = 1").select(F.col("code").alias("_top"), F.col("name").alias("category"))
    mid = upper.filter("level = 2").select(F.col("code").alias("parent_code"), F.col("name").alias("sub_category"), F.col("parent_code").alias("_top"))
    homes = mid.join(F.broadcast(top), "_top").drop("_top")
    placed = classify_leaf(leaves).join(F.broadcast(homes), ["category", "sub_category"])
    lower = numbered(placed, [F.col("indicator_name")], "sort").select(
        F.format_string("ind_%04d", "sort").alias("code"), F.col("indicator_name").alias("name"),
        F.lit(3).alias("level"), "sort", "parent_code",
    )
    return upper.unionByName(lower)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Leaf with the names of its two ancestors: one self-join per level."""
    level = lambda n, *cols: nodes.filter(F.col("level") == n).select(*cols)
    leaf = level(3, F.col("code"), F.col("name"), F.col("parent_code").alias("_p2"))
    mid = level(2, F.col("code").alias("_p2"), F.col("name").alias("sub_category"), F.col("parent_code").alias("_p1"))
    top = level(1, F.col("code").alias("_p1"), F.col("name").alias("category"))
    return leaf.join(mid, "_p2").join(top, "_p1").select("code", "name", "category", "sub_category")


def nested_tree(nodes: DataFrame) -> DataFrame:
    """One row per category: leaf count and nested children (ordered, with their leaves)."""
    item = lambda *extra: F.struct("sort", "code", "name", *extra)
    leaves = nodes.filter("level = 3").groupBy(F.col("parent_code").alias("code")).agg(F.sort_array(F.collect_list(item())).alias("children"))
    mid = nodes.filter("level = 2").join(leaves, "code", "left")
    size = F.coalesce(F.size("children"), F.lit(0))
    kids = mid.withColumn("n", F.when(F.col("children").isNull(), 0).otherwise(size)).groupBy(F.col("parent_code").alias("code")).agg(
        F.sort_array(F.collect_list(item("children"))).alias("children"), F.sum("n").alias("leaves")
    )
    return nodes.filter("level = 1").join(kids, "code", "left").select("sort", "code", "name", "leaves", "children")


def match_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Hang dictionary rows (indicator_code, indicator_name, category) on leaves.

    Candidates are an array in order of trust: name with the investment suffix,
    the name, then prefix and unit stripped forms with their aliases, then
    variants and aliases. Rank rows only match rank leaves.
    """
    from .governance import _lookup

    n = F.col("_n")
    prefixed = reduce(lambda a, b: a | b, [F.startswith(n, F.lit(p)) for p in lx.TREE_NAME_PREFIXES])
    united = reduce(lambda a, b: a | b, [F.endswith(n, F.lit(u)) for u in lx.TREE_UNIT_TAILS])
    inner_p = F.when(prefixed, F.expr("substring(_n, 4)"))
    inner_u = F.when(united, F.regexp_replace(n, r"\([^()]*\)$", ""))
    out = rows.withColumn("_n", text.tree_key(F.col("indicator_name")))
    out = out.withColumns({"_ip": inner_p, "_iu": inner_u})
    for source, table, target in (
        ("_ip", lx.TREE_ALIASES, "_pa"), ("_iu", lx.TREE_ALIASES, "_ua"), ("_iu", lx.TREE_VARIANT_NAMES, "_uv"),
        ("_n", lx.TREE_VARIANT_NAMES, "_v"), ("_n", lx.TREE_ALIASES, "_a"),
    ):
        out = _lookup(out, F.col(source), table, target)
    is_rank = F.endswith("indicator_code", F.lit(lx.RANK_SUFFIX))
    rank_name = F.when(F.endswith(n, F.lit(lx.RANK_SUFFIX)), n).otherwise(F.concat(n, F.lit(lx.RANK_SUFFIX)))
    invest = F.when(F.col("category") == "固定资产投资", F.concat(n, F.lit("投资")))
    plain = F.array(invest, n, F.col("_ip"), F.col("_pa"), F.col("_iu"), F.col("_ua"), F.col("_uv"), F.col("_v"), F.col("_a"))
    candidates = F.when(is_rank, F.array(rank_name)).otherwise(plain)
    tries = out.select("indicator_code", F.posexplode(candidates).alias("_pos", "leaf"))
    known = leaves.select(F.col("indicator_name").alias("leaf")).distinct()
    hits = tries.join(known, "leaf").groupBy("indicator_code").agg(F.min_by("leaf", "_pos").alias("leaf"))
    return rows.join(hits, "indicator_code", "left")


def link_audit(matched: DataFrame, leaves: DataFrame) -> DataFrame:
    """Dictionary rows without a leaf and leaves without a dictionary row."""
    rows = matched.filter(F.col("leaf").isNull()).select(F.lit("dictionary row without leaf").alias("type"), "indicator_name")
    bare = leaves.select("indicator_name").distinct().join(
        matched.select(F.col("leaf").alias("indicator_name")), "indicator_name", "left_anti"
    ).select(F.lit("leaf without dictionary row").alias("type"), "indicator_name")
    return rows.unionByName(bare)


def listing(base: DataFrame, **dims: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Left-join chain of a star: name=(dimension, base key, dimension key, label column).

    No hint: the size of each dimension decides how it is joined.
    """
    for out, (dim, key, dim_key, label) in dims.items():
        small = dim.select(F.col(dim_key).alias("_k"), F.col(label).alias(out))
        base = base.join(small, F.col(key) == F.col("_k"), "left").drop("_k")
    return base
