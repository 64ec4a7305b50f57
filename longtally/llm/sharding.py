"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts are one indivisible group. Differencing takes the two partial
partitions with the largest spread and adds them in opposite order, the fullest shard of one
to the emptiest of the other, until one partition is left.

One heap over all groups would not scale, and partial partitions combine, so it runs twice:
groups are dealt into buckets by digest, and each bucket's task differences its groups into
parcels of nearly equal size, of three scales (nine tenths of its groups, nine hundredths, a
hundredth). Then the parcels, and the few groups that are heavy against a shard, are
differenced into shards: large items first, small parcels last to level what is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, running_total, stored

#: A group is heavy from this part of a shard's mean size on; so there are at most shards times this.
HEAVY_PART = 64
GROUPS_PER_BUCKET = 100_000
#: Parcels of a bucket and scale at most, and of all buckets together about.
PARCELS, ALL_PARCELS = 16, 16_384


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Number of the part (0 to k-1) of every item, by k-way differencing. Ties go by the items' order."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def take(node: int) -> np.ndarray:
        if node < n:
            leaf = np.zeros(k, np.int64)
            leaf[-1] = sizes[node]
            return leaf
        return sums.pop(node)

    while len(heap) > 1:
        (_, one), (_, other) = heapq.heappop(heap), heapq.heappop(heap)
        total = take(one) + take(other)[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        node = n + len(merges)
        merges.append((one, other, order))
        sums[node] = total
        heapq.heappush(heap, (-int(total[-1] - total[0]), node))
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    part = np.zeros(n, np.int64)
    if n == 1:
        part[0] = k - 1
    for node in range(n + len(merges) - 1, n - 1, -1):
        one, other, order = merges[node - n]
        place = np.empty(k, np.int64)
        place[order] = places.pop(node)
        for child, own in ((one, place), (other, place[::-1])):
            if child < n:
                part[child] = own[k - 1]
            else:
                places[child] = own
    return part


def shards_by_bytes(documents: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) of every row.

    ``size``: UTF-8 bytes of the text plus 8; a null text has none and counts as a group of its own apart
    from the empty text, with the checksum of no bytes. Equal texts share a shard, and shards are as near to
    equal in bytes as groups allow. Slots of a shard count from 0 without gaps, in an order that ids and
    texts alone decide; rows that repeat both are interchangeable. Null ids are kept. An empty table gives
    no rows. Other columns are left out.
    """
    spark = documents.sparkSession
    payload = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(payload) + 8).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"), F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("null")).alias("digest"),
    ), "shard-rows")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    n_groups, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    heavy_from = max(1, total // (shards * HEAVY_PART))
    buckets = max(partitions(spark), -(-n_groups // GROUPS_PER_BUCKET))
    parcels = max(1, min(PARCELS, ALL_PARCELS // (3 * buckets)))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
        frame["parcel"] = 0
        for scale in range(3):
            own = np.flatnonzero(frame["scale"] == scale)
            frame.loc[own, "parcel"] = difference(frame["bytes"].to_numpy()[own], parcels)
        return frame

    draw = F.pmod(F.xxhash64("digest"), F.lit(100 * buckets))
    scale = F.when(draw % 100 < 90, 0).when(draw % 100 < 99, 1).otherwise(2)
    light = groups.where(F.col("bytes") <= heavy_from).select(
        "digest", "bytes", F.floor(draw / 100).cast("int").alias("bucket"), scale.cast("int").alias("scale")
    )
    placed = stored(light.groupBy("bucket").applyInPandas(local, "digest string, bytes long, bucket int, scale int, parcel int"), "shard-parcels")
    # Bounded: the parcels of all buckets, and heavy groups, of which shards x HEAVY_PART fit into the total.
    items = placed.groupBy("bucket", "scale", "parcel").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "bucket", "scale", "parcel").collect()
    heavy = groups.where(F.col("bytes") > heavy_from).orderBy(F.desc("bytes"), "digest").collect()
    part = difference(np.array([*(r["bytes"] for r in heavy), *(r["bytes"] for r in items)], np.int64), shards).tolist()
    of_heavy = spark.createDataFrame([(r["digest"], p) for r, p in zip(heavy, part, strict=False)], "digest string, shard int")
    of_parcel = spark.createDataFrame(
        [(r["bucket"], r["scale"], r["parcel"], p) for r, p in zip(items, part[len(heavy) :], strict=True)],
        "bucket int, scale int, parcel int, shard int",
    )
    assigned = placed.join(of_parcel, ["bucket", "scale", "parcel"]).select("digest", "shard").union(of_heavy)
    return with_slots(rows.join(assigned, "digest"), buckets)


def with_slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the gapless ``slot`` within ``shard``: a running count over hash buckets of the shard, then within each bucket."""
    cell = stored(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int")), "shard-cells")
    counts = cell.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = running_total(counts, ["shard"], "cell", "n", "offset").drop("n")
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")
    ranked = cell.withColumn("rank", F.row_number().over(inside))
    return ranked.join(offsets, ["shard", "cell"]).withColumn("slot", F.col("rank") - 1 + F.col("offset")).drop("rank", "offset", "cell")
