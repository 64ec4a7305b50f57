"""Merkle manifest of a dataset, kept as a log of tree nodes in postorder.

Leaves of one source stand in order; every ``FAN`` consecutive nodes of a level (the last run: fewer, even
one) become the hash of their digests, until one node is left. The roots of the sources, in order, are the
leaves of one more tree, whose root stands for the whole dataset.

Aligned builders work on ``FAN ** LEVELS`` consecutive nodes of a tree, which carry a complete subtree, or the
tree's end: no builder needs another one's nodes. It appends every node to the log when it is complete, so
children stand right before their parent. Its own root is a node for the builders of the next round; a round
shrinks a tree by ``FAN ** LEVELS``, whatever its source's share of all rows.

Positions need no index. Before leaf k, k leaves and all runs they complete were written, so leaf k stands at
k + k // F + k // F^2 + ...; node i of level l is complete with leaf min((i + 1) F^l, n) - 1, and l nodes after
it. ``position`` computes this, and proofs fetch the siblings of a node, and of the nodes above it, from there.
A proof travels from the top down: the siblings of a builder's root are found once, by the builder above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, new_path, ranked, sent_if_few, shared, stored

FAN = 16
#: Levels that one builder completes: it holds FAN ** LEVELS nodes at most.
LEVELS = 3
AT_ONCE = FAN**LEVELS
#: What a leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the tree over the sources; theirs count from 0.
TOP = -1

#: ``base`` and ``block`` say which builder has the node among its children or runs.
LOG = "tree long, n long, base int, block long, position long, digest string"
#: The way on from a builder's root: left and right siblings of each level in turn, and the roots on it.
WAY = "tree long, n long, block long, steps array<string>, subroot string, root string"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def width(level: int, n: int) -> int:
    """Nodes of a level in a tree with ``n`` leaves."""
    return -(-n // FAN**level)


def position(level: int, index: int, n: int) -> int:
    """Where node ``index`` of a level stands in the postorder log of a tree with ``n`` leaves, from 0."""
    leaf = min((index + 1) * FAN**level, n) - 1
    at, runs = leaf + level, leaf // FAN
    while runs:
        at, runs = at + runs, runs // FAN
    return at


def build(digests: list[str], base: int, block: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, position, digest) of a builder's nodes, from its first child of level ``base`` to its root, as they are completed."""
    first, top = block * AT_ONCE, min(base + LEVELS, height(n))
    runs: list[list[str]] = [[] for _ in range(LEVELS)]
    for i, digest in enumerate(digests):
        level, at = base, position(base, first + i, n)
        while True:
            yield level, at, digest
            if level == top:
                break
            run = runs[level - base]
            run.append(digest)
            if len(run) < FAN and i < len(digests) - 1:
                break
            # The run is complete with this node, and its parent follows right behind.
            digest = digest_of("".join(run))
            run.clear()
            level, at = level + 1, at + 1


def children(found: dict[int, str], base: int, block: int, n: int) -> list[list[str]]:
    """Digests of a builder's nodes below its root, a list for each level, fetched by their positions."""
    levels = []
    for level in range(base, min(base + LEVELS, height(n))):
        share = AT_ONCE // FAN ** (level - base)
        levels.append([found[position(level, i, n)] for i in range(block * share, min((block + 1) * share, width(level, n)))])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[str]:
    """Left and right siblings, level by level, on the way from a builder's child at ``place`` to its root."""
    steps = []
    for nodes in levels:
        start = place // FAN * FAN
        steps += ["".join(nodes[start:place]), "".join(nodes[place + 1 : start + FAN])]
        place //= FAN
    return steps


def fold(digest: str, steps: list[str]) -> str:
    """The root that a node's digest and the siblings on its way give."""
    for left, right in zip(steps[::2], steps[1::2], strict=True):
        # A node alone in its tree has no step; one alone in its run has a step without siblings.
        digest = digest_of(left + digest + right)
    return digest


def leaf_of(columns: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def leaves(documents: DataFrame, changed: Column) -> DataFrame:
    """(source, doc_id, leaf, shown): each row's digest and, where ``changed`` holds, that of the row with its
    text's A-Z lower-cased. Columns beyond ``FIELDS`` take no part."""
    leaf = leaf_of([F.col(f) for f in FIELDS])
    altered = leaf_of([lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    return documents.select("source", "doc_id", leaf.alias("leaf"), F.when(changed, altered).alias("shown"))


def _builders(nodes: DataFrame, base: int) -> DataFrame:
    """The log rows that the builders of one round append, given their children of level ``base``."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        tree, block = map(int, key)
        rows = rows.sort_values("position")
        n = int(rows["n"].iloc[0])
        made = []
        for level, at, digest in build(rows["digest"].tolist(), base, block, n):
            if base == 0 or level > base:  # children of later rounds are in the log already
                own = level < base + LEVELS
                made.append((tree, n, base if own else base + LEVELS, block if own else block // AT_ONCE, at, digest))
        return pd.DataFrame(made, columns=["tree", "n", "base", "block", "position", "digest"])

    return nodes.groupBy("tree", "block").applyInPandas(run, LOG)


def append_trees(leaves: DataFrame, path: str, most: int, top: bool = False) -> None:
    """Appends whole trees to the log under ``path``: those of the sources, or the one over them (``top``).

    ``leaves`` (tree, n, index, digest); ``most`` is the largest n. A round's input is what the one before wrote.
    """
    spark = leaves.sparkSession
    block = F.floor(F.col("index") / AT_ONCE).cast("long")
    nodes = leaves.select("tree", "n", block.alias("block"), F.col("index").alias("position"), "digest")
    for base in range(0, max(height(most), 1), LEVELS):
        if base:
            nodes = read_log(spark, path).where((F.col("base") == base) & (F.col("n") > FAN**base) & ((F.col("tree") == TOP) == F.lit(top)))
        _builders(nodes, base).write.mode("append").partitionBy("base").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def _descend(ways: DataFrame, log: DataFrame, base: int) -> DataFrame:
    """The ways of the builders of round ``base`` become those of their children; trees that end below keep theirs."""

    def run(key, nodes: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        tree, block = map(int, key)
        n, upper, subroot, root = (way[c].iloc[0] for c in ("n", "steps", "subroot", "root"))
        levels = children(dict(zip(nodes["position"].tolist(), nodes["digest"].tolist())), base, block, int(n))
        first = block * AT_ONCE
        count = min(AT_ONCE, width(base, int(n)) - first)
        made = [(tree, n, first + i, siblings(levels, i) + list(upper), subroot, root) for i in range(count)]
        return pd.DataFrame(made, columns=["tree", "n", "block", "steps", "subroot", "root"])

    deep = F.col("n") > FAN**base if base else F.lit(True)
    nodes = log.where((F.col("base") == base) & deep).groupBy("tree", "block")
    lower = nodes.cogroup(ways.where(deep).groupBy("tree", "block")).applyInPandas(run, WAY)
    return stored(lower.union(ways.where(~deep)) if base else lower, "manifest-ways")


def _proofs(rows: DataFrame, log: DataFrame, ways: DataFrame) -> DataFrame:
    """The last step down: proofs of the rows (tree, index, doc_id, leaf, shown) themselves."""

    def run(key, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        way = nodes[nodes["position"] < 0].iloc[0]
        nodes = nodes[nodes["position"] >= 0]
        block, root, upper = int(key[1]), way["root"], list(way["steps"])
        levels = children(dict(zip(nodes["position"].tolist(), nodes["digest"].tolist())), 0, block, int(way["n"]))
        told = []
        for index, leaf, shown in zip(rows["index"], rows["leaf"], rows["shown"], strict=True):
            steps = siblings(levels, int(index) - block * AT_ONCE) + upper
            folded = fold(shown or leaf, steps)
            told.append((digest_of("".join(steps)), folded, folded == root))
        out = pd.DataFrame(told, columns=["proof", "folded_root", "verified"], index=rows.index)
        return rows[["doc_id", "leaf"]].assign(subroot=way["subroot"], root=root, **out)

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("steps", "array<string>"), ("subroot", "string"), ("root", "string"))]
    nodes = log.where("base = 0").select("tree", "block", "n", "position", "digest", *nothing)
    nodes = nodes.union(ways.select("tree", "block", "n", F.lit(-1).cast("long"), F.lit(None).cast("string"), "steps", "subroot", "root"))
    block = F.floor(F.col("index") / AT_ONCE).cast("long")
    kind = rows.schema["doc_id"].dataType
    # Ids cross as text, as null ones would turn the others into floating point numbers.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", block)
    out = rows.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInPandas(
        run, "doc_id string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def manifest(documents: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row of ``documents``.

    ``proof`` is the digest of all siblings on the way to the root, level by level, left to right.
    ``folded_root`` is computed from the row as shown and those siblings; rows where ``changed`` holds are
    shown with their text's A-Z lower-cased, so they are found out if that alters them.

    Leaves of a source ascend by doc_id, nulls first; rows of one id by leaf, so repeated rows are
    interchangeable. Sources ascend by code points, null first (a source of its own, not the empty one). Null
    fields are told from empty ones; columns beyond ``FIELDS`` take no part; an empty table gives no rows.
    """
    spark = documents.sparkSession
    shared(spark)
    marked = stored(leaves(documents, F.lit(False) if changed is None else changed), "manifest-leaves")
    rows = ranked(marked, ["source"], ["doc_id", "leaf", "shown"], "index", "manifest-ranked")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    sources = stored(ranked(counts, [], ["source"], "tree", "manifest-counts").withColumnRenamed("source", "of"), "manifest-sources")
    trees, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    numbered = rows.join(sent_if_few(sources), F.col("source").eqNullSafe(F.col("of"))).select("tree", "n", "index", "doc_id", "leaf", "shown")

    path = new_path(spark, "manifest-log")
    append_trees(numbered.select("tree", "n", "index", F.col("leaf").alias("digest")), path, most)
    # The root of a tree is the node written last.
    subroots = stored(read_log(spark, path).groupBy("tree").agg(F.max_by("digest", "position").alias("subroot")), "manifest-subroots")
    top = F.lit(TOP).cast("long")
    append_trees(subroots.select(top.alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("index"), F.col("subroot").alias("digest")), path, trees, top=True)

    log = read_log(spark, path)
    summit = log.where(F.col("tree") == TOP).groupBy("tree", "n").agg(F.max_by("digest", "position").alias("root"))
    ways = summit.select("tree", "n", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot"), "root")
    for base in reversed(range(0, max(height(trees), 1), LEVELS)):
        ways = _descend(ways, log.where(F.col("tree") == TOP), base)
    ways = ways.select(F.col("block").alias("tree"), "steps", "root").join(subroots, "tree").join(sources.select("tree", "n"), "tree")
    ways = stored(ways.select("tree", "n", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root"), "manifest-ways")
    for base in reversed(range(LEVELS, height(most), LEVELS)):
        ways = _descend(ways, log.where(F.col("tree") != TOP), base)
    return _proofs(numbered, log.where(F.col("tree") != TOP), ways)
