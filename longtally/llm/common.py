"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Word as the contracts of several operators define it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, as in local tests, a private one is set.

    On a cluster a missing setting is an error: a temporary folder of one machine is not seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and gives real sizes to the planner."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared(spark)}/llm-{label}-{uuid.uuid4().hex[:16]}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared(df.sparkSession)
    return df.checkpoint()


def unused(name: str, columns) -> str:
    """``name``, with underscores in front until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, UPPER, LOWER)


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` (a, b: long). Returns (node, root), root being the smallest node reachable,
    for nodes that have an edge to another one. Alternates the large-star and small-star
    steps; every step folds on the map side, joins on the node (a hot hub is a skewed
    sort-merge join that adaptive execution splits) and is checkpointed.
    """
    current = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = around.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")) if both else joined
        linked = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            linked = linked.union(joined.select("u", F.col("m").alias("v")))
        return linked.where("u <> v").distinct()

    def digest(pairs: DataFrame):
        row = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        return row[0], row[1]

    seen = digest(current)
    while seen[0]:
        current = checkpointed(star(checkpointed(star(current, True)), False))
        now = digest(current)
        if now == seen:
            break
        seen = now
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root")).distinct()


#: Rows up to which a table of one short row per source or shard is sent to all tasks.
FEW_ROWS = 20_000


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it was counted to have few rows, else as it is; for tables that are already stored."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def running_total(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group; for small, already folded tables."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0).cast("long")))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, label: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in its group, from 0, ascending by ``order``, nulls first.

    Rows are dealt by ranges, sorted and numbered where they are written, so neither a large group nor all
    rows ever meet in one task; only one count for each range and group in it is joined back. Rows equal in
    ``order`` get their places in any order. ``df`` should be stored, as ranges are sampled from it first.
    """
    at, part, row, first, offset, of_part = (unused(n, df.columns) for n in ("_at", "_part", "_row", "_first", "_offset", "_of_part"))
    of = [unused(f"_of{i}", df.columns) for i in range(len(group))]
    keys = [quoted(c).asc_nulls_first() for c in (*group, *order)]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    placed = stored(dealt, label).withColumn(part, F.shiftright(at, 33)).withColumn(row, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy(F.col(part).alias(of_part), *(quoted(c).alias(o) for c, o in zip(group, of))).agg(F.min(row).alias(first), F.count("*").alias("n"))
    counts = sent_if_few(stored(running_total(counts, of, of_part, "n", offset).drop("n"), f"{label}-counts"))
    same = F.col(part) == F.col(of_part)
    for c, o in zip(group, of):
        same = same & quoted(c).eqNullSafe(F.col(o))
    place = (F.col(row) - F.col(first) + F.col(offset)).alias(name)
    return placed.join(counts, same).select(*map(quoted, df.columns), place)
