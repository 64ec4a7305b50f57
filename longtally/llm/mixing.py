"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each word of a document gets a rate. Of all rates that give every source its target number of
words and stay below a cap, those closest to the prior rates in relative entropy are
exponentially tilted: rate = min(cap, prior * exp(tilt of the source)). The tilts maximise the
convex dual, whose gradient is the words a tilt yields less the target. Newton steps find
them: every step is one aggregate over (source, prior) with the sizes already folded, joined
with the tilts so far. Rates are then rounded into whole copies so that each source's total
comes within half a document of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, quoted, running_total, sent_if_few, stored, unused

WEIGHTS = (5, 2, 1)
CAP = 3.0
TOLERANCE = 1e-10
MAX_STEPS = 200
#: Tilt of a source that shall give no words; its exponential is 0.
NO_RATE = -1000.0
#: Columns of the result and of its steps.
RESULTS = {
    "doc_id", "source", "size", "prior", "source_size", "target", "rate", "copies", "taken",
    "of", "tilt", "floor", "fraction", "draw", "fine", "coarse", "edge", "base", "need", "up",
}
#: A document's draw is cut into this many coarse, and each of these into as many fine steps.
STEPS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) with ``weight``: sources in order of code points, null last, take the weights in turn.

    The rank comes from counts of ranges, so no task sees all sources.
    """
    ranged = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    offsets = running_total(ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "part", "n", "offset")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(inside) - 1
    ranked = ranged.withColumn("rank", rank).join(offsets.select("part", "offset"), "part")
    place = (F.col("rank") + F.col("offset")) % len(weights)
    return ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double").alias("weight"))


def capped_targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``target``: shares of all sizes by ``weight``, stopping at ``cap`` times the source's size.

    The excess goes to the others by weight until none is above its limit. One aggregate a round;
    each round stops at least one more source, and usually all that will stop.
    """
    level = -1.0
    while True:
        stopped = F.col("weight") * level > cap * F.col("source_size")
        row = sources.agg(
            F.sum("source_size").cast("double").alias("total"), F.coalesce(F.sum(F.when(stopped, cap * F.col("source_size"))), F.lit(0.0)).alias("held"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("weights"),
        ).first()
        if row["total"] is None or not row["weights"]:
            break
        risen = (row["total"] - row["held"]) / row["weights"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return sources.withColumn("target", F.least(F.col("weight") * max(level, 0.0), cap * F.col("source_size")))


def tilts(moments: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, target, tilt) from ``moments`` (source, prior, size) and ``targets`` (source, target).

    Words grow with the tilt, and each source keeps a bracket (low, high) around its solution: without the cap
    the target is met at ``low`` exactly, and at ``high`` every word is at the cap. A Newton step that leaves the
    bracket, or has no slope to go by, becomes a bisection. With one prior per source the first step settles.
    A source that is not settled after ``MAX_STEPS`` is an error. A source without words keeps the tilt 0, one
    with words but no target is sent to rate 0.
    """
    ends = moments.groupBy("source").agg(F.sum(F.col("size") * F.col("prior")).alias("mass"), F.min("prior").alias("least"))
    nothing = (F.col("mass") <= 0) | F.col("mass").isNull()
    low = F.when(nothing, 0.0).when(F.col("target") > 0, F.log("target") - F.log("mass")).otherwise(NO_RATE)
    high = F.when(nothing, 0.0).when(F.col("target") > 0, F.greatest(F.lit(math.log(cap)) - F.log("least"), low)).otherwise(NO_RATE)
    at = targets.select(F.col("source").alias("of"), "target").join(ends, F.col("of").eqNullSafe(F.col("source")), "left")
    now = checkpointed(at.select(F.col("of").alias("source"), "target", low.alias("low"), high.alias("high"), low.alias("tilt")))
    for _ in range(MAX_STEPS):
        raw = F.col("prior") * F.exp("tilt")
        step = (
            moments.join(now, moments["source"].eqNullSafe(now["source"])).drop(moments["source"])
            .groupBy("source", "target", "low", "high", "tilt")
            .agg(F.sum(F.col("size") * F.least(raw, F.lit(cap))).alias("words"), F.sum(F.when(raw < cap, F.col("size") * raw)).alias("curvature"))
        )
        gap = F.col("target") - F.col("words")
        settled = F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0))
        step = step.select(
            "source", "target", F.when(gap > 0, F.col("tilt")).otherwise(F.col("low")).alias("low"),
            F.when(gap < 0, F.col("tilt")).otherwise(F.col("high")).alias("high"), "tilt",
            (F.col("tilt") + gap / F.nullif("curvature", F.lit(0.0))).alias("newton"), settled.alias("settled"),
        )
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        tilt = F.when(F.col("settled"), F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        now = checkpointed(step.select("source", "target", "low", "high", tilt.alias("tilt"), "settled"))
        if now.where("NOT settled").isEmpty():
            return now.select("source", "target", "tilt")
        now = now.drop("settled")
    raise ArithmeticError(f"sources did not reach their targets in {MAX_STEPS} steps")


def mixed(rows: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``target``, ``rate``, ``copies`` and ``taken`` to rows (doc_id, size, source, prior).

    ``copies`` is the rate rounded down, or up for a share of the documents: a document's draw is a hash of
    its id less the fraction of its rate, and in the order of draws documents are rounded up as long as the
    source's total comes closer to its target. The order is found by two levels of histograms; only documents
    of the one fine step in which a source's total is reached are sorted. Rows that share id and size are
    interchangeable.
    """
    moments = checkpointed(rows.groupBy("source", "prior").agg(F.sum("size").cast("double").alias("size")))
    found = sent_if_few(checkpointed(tilts(moments, targets, cap).select(F.col("source").alias("of"), "target", "tilt")))
    rate = F.least(F.col("prior") * F.exp("tilt"), F.lit(cap))
    whole = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.floor("rate"))
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40))
    draws = rows.join(found, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).drop("of", "tilt")
    draws = draws.withColumn("floor", whole.cast("long")).withColumn("fraction", F.greatest(F.col("rate") - F.col("floor"), F.lit(0.0)))
    draws = draws.withColumn("draw", uniform - F.col("fraction"))
    fine = F.floor((F.col("draw") + 1) / 2 * (STEPS * STEPS)).cast("long")
    draws = stored(draws.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / STEPS)), "mix-draws")

    source = F.col("source")
    folded = checkpointed(draws.groupBy("source", "coarse", "fine").agg(
        F.sum(F.when(F.col("fraction") > 0, F.col("size")).otherwise(0)).alias("size"),
        F.sum(F.col("floor") * F.col("size")).alias("whole"), F.first("target").alias("target"),
    ))
    need = folded.groupBy("source").agg((F.first("target") - F.sum("whole")).alias("need")).withColumnRenamed("source", "of")

    def reached(steps: DataFrame, group: list[str], by: str) -> DataFrame:
        """The step of each group in which the total is reached, and the size before it."""
        sums = steps.groupBy(*group, "need", "base", by).agg(F.sum("size").alias("size"))
        before = running_total(sums, group, by, "size", "before").withColumn("before", F.col("before") + F.col("base"))
        return before.where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("size") > F.col("need"))).select(
            F.col("source").alias("of"), *group[1:], "need", by, F.col("before").alias("base")
        )

    start = folded.join(need, source.eqNullSafe(F.col("of"))).drop("of").withColumn("base", F.lit(0).cast("long"))
    coarse = checkpointed(reached(start, ["source"], "coarse"))
    inner = folded.join(coarse.withColumnRenamed("coarse", "at"), source.eqNullSafe(F.col("of")) & (F.col("coarse") == F.col("at"))).drop("of", "at")
    edge = checkpointed(reached(inner, ["source"], "fine").withColumnRenamed("fine", "edge"))
    full = need.join(edge.select(F.col("of").alias("with_edge")), F.col("of").eqNullSafe(F.col("with_edge")), "left_anti")
    limits = checkpointed(
        edge.select("of", "need", "edge", "base").union(
            full.select("of", "need", F.when(F.col("need") > 0, STEPS * STEPS + 1).otherwise(-1).cast("long"), F.lit(0).cast("long"))
        )
    )
    placed = draws.join(sent_if_few(limits), source.eqNullSafe(F.col("of"))).drop("of")
    away = placed.where("fine <> edge").withColumn("up", (F.col("fine") < F.col("edge")).cast("long"))
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("fraction") > 0, F.col("size")).otherwise(0)
    before = F.coalesce(F.sum(counted).over(order), F.lit(0)) + F.col("base")
    at_edge = placed.where("fine = edge").withColumn("up", (before + F.col("size") / 2 <= F.col("need")).cast("long"))
    copies = F.col("floor") + F.when(F.col("fraction") > 0, F.col("up")).otherwise(0)
    out = away.union(at_edge).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("floor", "fraction", "draw", "fine", "coarse", "edge", "base", "need", "up")


def mix(documents: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, text: str = "text", prior: str | None = None, carry: tuple = ()) -> DataFrame:
    """(doc_id, source, size, prior, source_size, target, rate, copies, taken) of every row of ``documents``.

    ``size`` counts words (a null text has none). ``prior`` names a column of positive rates to stay close to
    (default 1 for all; null or not positive counts as 1); ``carry`` names columns to keep, which must not be named
    like a result; other columns are dropped. Documents without words get whole copies by their
    rate and take no words. Null ids and sources are kept; a null source is a source of its own. Repeated rows are
    mixed one by one. An empty table gives no rows.
    """
    if not math.isfinite(cap) or cap <= 0:
        raise ValueError("cap must be a positive number")
    taken = set(carry) & RESULTS
    if taken:
        raise ValueError(f"carried columns named like results: {sorted(taken)}")
    own = F.col(prior).cast("double") if prior else F.lit(1.0)
    rows = stored(documents.select(
        "doc_id", "source", word_count(F.col(text)).alias("size"), F.when(own > 0, own).otherwise(1.0).alias("prior"), *carry,
    ), "mix-rows")
    sources = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = checkpointed(capped_targets(checkpointed(cyclic_weights(sources, weights)), cap))
    sizes = sent_if_few(targets.select(F.col("source").alias("of"), "source_size"))
    return mixed(rows, targets, cap).join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mixed_documents(documents: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, text: str = "text") -> DataFrame:
    """The documents, each as often as the mix takes it (documents without words by their rate), with their own columns.

    Every row is numbered where it is first written, so rows that repeat each other are mixed one by one.
    """
    columns = documents.columns
    row, kept = unused("_row", columns), unused("_mix", columns)
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    copies = mix(numbered, weights, cap, text, carry=(row,)).where("copies > 0").select(row, F.col("copies").cast("int").alias(kept))
    taken = numbered.join(copies, row).withColumn(kept, F.explode(F.sequence(F.lit(1), F.col(kept))))
    return taken.select(*map(quoted, columns))
