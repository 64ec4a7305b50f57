"""SimHash near-duplicates, linked through the anchor points of a covering code.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of one half.
The anchors of a half are a covering code of its 32 bits: a Hamming code on 31 of them, each
word of which covers all points within one bit, times the free last bit. Every fingerprint is
at home at its nearest anchor (covering radius 1) and is replicated to all anchors within
radius plus threshold (1 + 1, at most 17 of them); so whoever comes within one bit of it meets
it at his home anchor. Fingerprints are compared per anchor, in whole 64 bits.

Copies of a text share a fingerprint and are folded first. An anchor at which very many are at
home is split: its homes are dealt into blocks and the visitors go to every block. Of the links
of a batch only a star per connected set goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import components, quoted, stored, unused

SEED = 42
HOMES_PER_BLOCK = 4096
PAIRS_AT_ONCE = 2_000_000
SHINGLES_AT_ONCE = 1 << 16
#: Bit i of a point's syndrome is the parity of the positions 1 to 31 whose number has bit i set.
CHECKS = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> i & 1) for i in range(5)], np.uint64)
FREE = 1 << 31


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the changes that lead to an anchor within two bits, nearest first, and their number."""
    table, count = np.zeros((32, 17), np.uint64), np.zeros(32, np.int64)
    for s in range(32):
        one = 1 << (s - 1) if s else 0
        found = [one, one | FREE]
        if s:
            found += [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if a < a ^ s]
        table[s, : len(found)], count[s] = found, len(found)
    return table, count


FLIPS, REACH = _flips()


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words without ASCII white space, shingles
    space-joined with repeats, a text of fewer words as one shingle, no words 0. A bit is set if over half
    of the shingles' XXH64 have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + SHINGLES_AT_ONCE], last[at : at + SHINGLES_AT_ONCE], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(first)).view("<u8")[0])


def fingerprinted(documents: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long (the bits of the unsigned number); a column of that name is replaced."""
    kept = [c for c in documents.columns if c != name]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(values, np.uint64).view(np.int64))], [*kept, name])

    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField(name, T.LongType())])
    return documents.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)


def _anchors(points: np.ndarray, reach: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, at home) of every point at its first ``reach`` anchors (None: all) of both halves."""
    rows, keys, homes = [], [], []
    for half in range(2):
        part = points >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(points), np.int64)
        for i, check in enumerate(CHECKS):
            syndrome |= (np.bitwise_count(part & check).astype(np.int64) & 1) << i
        for n in range(reach or FLIPS.shape[1]):
            near = np.flatnonzero(REACH[syndrome] > n)
            rows.append(near)
            keys.append((part[near] ^ FLIPS[syndrome[near], n]) | np.uint64(half << 32))
            homes.append(np.full(len(near), n == 0))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(homes)


def _replicas(points: DataFrame, reach: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key, home = _anchors(values, reach)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row].view(np.int64)), pa.array(home)], ["anchor", "fingerprint", "home"])

    return points.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long, home boolean")


def _star(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of each connected set as a star around its smallest member."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = place[: len(left)], place[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _links(key: np.ndarray, point: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of homes with all that meet them at an anchor; rows of one anchor stand together."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(np.arange(len(start)), size)
    at = np.flatnonzero(home & (size[group] > 1))
    width = size[group[at]]
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    cuts = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    cuts = np.append(cuts, len(at))  # a sum that is a multiple would leave out the last home
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own, n = at[low:high], width[low:high]
        if not len(own):
            continue
        one = np.repeat(own, n)
        other = np.repeat(start[group[own]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(point[one] ^ point[other]) <= threshold) & (point[one] != point[other])
        a, b = _star(point[one[near]], point[other[near]])
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def links(points: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b) fingerprints whose links connect what links at ``threshold`` (3 at most) or fewer bits connect.

    ``points`` (fingerprint long), without repeats. Stars stand for the links of a batch, so the result
    grows with the points, not with the pairs.
    """
    if threshold > 3:
        raise ValueError("two halves cover three bits at most")
    crowded = stored(
        _replicas(points, 1).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOMES_PER_BLOCK)
        .select("anchor", F.ceil(F.col("n") / HOMES_PER_BLOCK).cast("int").alias("blocks")), "simhash-crowded",
    )
    met = _replicas(points, None)
    if crowded.isEmpty():
        met = met.withColumn("block", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
        placed = met.join(crowded, "anchor", "left")
        everywhere = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = placed.withColumn("own", own).withColumn("block", F.explode(everywhere))
        met = placed.select("anchor", "fingerprint", (F.col("home") & (F.col("own").isNull() | (F.col("own") == F.col("block")))).alias("home"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            anchor, block, point = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            home = batch.column(3).to_numpy(zero_copy_only=False)
            anchor, block, point = (np.concatenate([h, x]) for h, x in zip(held, (anchor, block.astype(np.int64), point.view(np.uint64)), strict=True))
            home = np.concatenate([np.ones(len(held[0]), bool), home])
            if not len(anchor):
                continue
            key = np.cumsum(np.concatenate([[0], ((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])).astype(np.int64)]))
            a, b = _links(key, point, home, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            last = home & (key == key[-1])  # its group may go on: homes come first and stay for those to come
            held = [anchor[last], block[last], point[last]]

    dealt = met.select("anchor", "block", "fingerprint", "home").repartition("anchor", "block")
    return dealt.sortWithinPartitions("anchor", "block", F.desc("home")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(rows: DataFrame, threshold: int = 3) -> DataFrame:
    """(fingerprint, root, component_id) of every fingerprint in ``rows`` (doc_id, fingerprint).

    ``root`` is one fingerprint for a whole component. ``component_id`` is the smallest doc_id reachable over links, itself included; null ids are passed over
    and a component of null ids alone has none. Equal fingerprints are linked, also the zero of texts without
    words. An empty table gives no rows.
    """
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-classes")
    linked = components(links(classes, threshold)).withColumnRenamed("node", "fingerprint")
    joined = classes.join(stored(linked, "simhash-roots"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    joined = stored(joined, "simhash-joined")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(joined.join(least, "root").select("fingerprint", "root", "component_id"), "simhash-components")


def one_of_each(documents: DataFrame, threshold: int = 3) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays, nulls last;
    of rows that share it, that with the smallest text. All columns stay as they are."""
    columns = documents.columns
    mark, root, least, several_rows, rank = (unused(n, columns) for n in ("_simhash", "_root", "_least", "_shared", "_rank"))
    own = [quoted(c) for c in columns]
    marked = stored(fingerprinted(documents, name=mark), "simhash-documents")
    groups = near_duplicates(marked.select("doc_id", F.col(mark).alias("fingerprint")), threshold)
    crowd = marked.groupBy(F.col(mark).alias("fingerprint")).agg(F.count("*").alias("n")).join(groups, "fingerprint")
    # Slim first: only components of several rows need their rows compared.
    sums = crowd.groupBy("root").agg(F.sum("n").alias("all")).where("all > 1").select("root")
    several = stored(crowd.join(sums, "root").select(
        F.col("fingerprint").alias(mark), F.col("root").alias(root), F.col("component_id").alias(least), F.lit(True).alias(several_rows)
    ), "simhash-several")
    joined = marked.join(several, mark, "left")
    alone = joined.where(F.col(several_rows).isNull()).select(*own)
    first = joined.where(F.col(several_rows) & F.col("doc_id").eqNullSafe(F.col(least))).select(root, *own)
    order = Window.partitionBy(root).orderBy(F.col("text").asc_nulls_last())
    one = first.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*own)
    return alone.union(one)
