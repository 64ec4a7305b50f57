"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, so the largest cosine is the smallest Euclidean distance. A
table hashes a vector to a cell of a grid over several Gaussian projections. A query visits its
own cell and then neighbouring cells in the order in which they are expected to hold near
vectors (perturbations of few, close cell borders first). The candidates of all tables are
ranked by exact cosines.

The grid is fitted on a bounded sample: for every number of projections and tables, the least number of
probes with which the sample's own neighbours are found as often as ``recall`` asks. Of these the one of least
work is taken, for the number of vectors there are: candidates of a query, each counted once, and cells visited.

Cells are dealt into groups; a group's rows travel once per table, and a query goes once to
every group that holds a cell it visits, with the list of those cells. A group of more than
``ROWS_PER_TASK`` vectors (a hot cell) is split and its queries go to all parts. Each part
returns its best of each query, which keeps the ranking exact and what is emitted small.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

TABLE_COUNTS, WIDTH, MOST_PROJECTIONS = (1, 2, 4), 2.0, 24
SAMPLE, SAMPLE_QUERIES, MOST_PROBES = 4096, 128, 6561
ROWS_PER_TASK = 8192
QUERIES_AT_ONCE = 256


def probe_order(projections: int, most: int) -> np.ndarray:
    """Perturbations as rows over 2 x projections places (nearest border first), in order of expected success.

    Place j stands for the j-th nearest border; j and its mirror image are the two borders of one projection,
    so no row has both. The score of a row is the sum of the expected squared distances of its borders.
    """
    k = projections
    j = np.arange(1, 2 * k + 1)
    mirrored = 2 * k + 1 - j
    score = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - mirrored / (k + 1) + mirrored * (mirrored + 1) / (4 * (k + 1) * (k + 2)))
    rows, heap = [()], [(score[0], (0,))] if k else []
    while heap and len(rows) < most:
        cost, places = heapq.heappop(heap)
        if all(2 * k - 1 - p not in places for p in places):
            rows.append(places)
        last = places[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - score[last] + score[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (cost + score[last + 1], (*places, last + 1)))
    out = np.zeros((len(rows), 2 * k), np.int64)
    for i, places in enumerate(rows):
        out[i, list(places)] = 1
    return out


class Grid:
    """Hash functions of all tables, the same for the same dimension and number of projections."""

    def __init__(self, dimension: int, projections: int, probes: int = MOST_PROBES, seed: int = 11):
        draw = np.random.default_rng([seed, dimension, projections])
        self.dimension, self.projections, self.tables = dimension, projections, max(TABLE_COUNTS)
        self.axes = draw.normal(size=(self.tables, dimension, projections))
        self.shift = draw.uniform(0, WIDTH, size=(self.tables, projections))
        self.factor = draw.integers(-(2**62), 2**62, size=(self.tables, projections), dtype=np.int64) | 1
        self.table = draw.integers(-(2**62), 2**62, size=self.tables, dtype=np.int64)
        self.order = probe_order(projections, probes)

    def _cells(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = (unit @ self.axes[t] + self.shift[t]) / WIDTH
        low = np.floor(place)
        return place - low, low.astype(np.int64), (low.astype(np.int64) * self.factor[t]).sum(axis=1) + self.table[t]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table."""
        return np.stack([self._cells(unit, t)[2] for t in range(self.tables)], axis=1)

    def probes(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Cells of table t that each vector visits, in order."""
        inside, _, own = self._cells(unit, t)
        border = np.concatenate([inside, 1 - inside], axis=1)
        step = np.concatenate([-self.factor[t], self.factor[t]])
        near = np.argsort(border, axis=1, kind="stable")
        return own[:, None] + (self.order @ step[near].T).T


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def fit(sample: np.ndarray, vectors: int, neighbours: int, recall: float) -> Grid:
    """The grid of least work for so many vectors among those that reach ``recall`` on the sample.

    Work is the number of candidates, a vector found in several tables counted once, and of cells visited. Where
    no grid reaches the recall with ``MOST_PROBES``, the one that comes closest is taken.
    """
    unit = _unit(sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])])  # copies are found by any grid
    own = min(SAMPLE_QUERIES, len(unit))
    near = unit[:own] @ unit.T
    near[np.arange(own), np.arange(own)] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(neighbours, len(unit) - 1)]
    if not best.size:
        return Grid(sample.shape[1], 1, 1)
    chosen, least = None, (math.inf, math.inf)
    worse = 0
    for k in range(1, MOST_PROJECTIONS + 1):
        grid = Grid(sample.shape[1], k)
        most = len(grid.order)
        cells = grid.cells(unit)
        nth = np.full((own, len(unit)), most)  # the probe that first visits a vector's cell in any table so far
        reached = False
        for t in range(grid.tables):
            visits = grid.probes(unit[:own], t)
            for q in range(own):
                order = np.argsort(visits[q], kind="stable")
                at = np.minimum(np.searchsorted(visits[q][order], cells[:, t]), most - 1)
                here = visits[q][order[at]] == cells[:, t]
                nth[q] = np.minimum(nth[q], np.where(here, order[at], most))
            if t + 1 not in TABLE_COUNTS:
                continue
            found = np.sort(np.take_along_axis(nth, best, axis=1), axis=None)
            probes = min(int(found[math.ceil(recall * len(found)) - 1]) + 1, most)
            missed = max(0.0, recall - (found < probes).mean())
            work = (nth < probes).mean() * vectors + probes * (t + 1)
            if (missed, work) < least:
                chosen, least, reached = (k, t + 1, probes), (missed, work), True
        worse = 0 if reached else worse + 1
        if worse == 3:  # finer grids need ever more probes from here on
            break
    grid = Grid(sample.shape[1], chosen[0], chosen[2])
    grid.tables = chosen[1]
    return grid


def usable(vector: str):
    """Column: not null, not empty, every component finite, at least one not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(
    vectors: DataFrame, query, *, vec_id: str = "vec_id", vector: str = "embedding", neighbours: int = 5, recall: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest vectors found for each row for which Column ``query`` holds.

    ``score`` is the cosine in double precision on the original vectors; ties go to the smaller id. A row is no
    candidate of queries with its own id. Vectors null, empty, zero or with null or non-finite components take
    no part, nor do rows without an id, nor vectors of another dimension than most of the sample. Of equal vectors only the ids
    that can be among the nearest (the smallest ``neighbours`` + 1) are indexed, so copies lose no result. A query
    that finds fewer than asked is run again over all cells. Of rows that share an id, the one nearest to the query
    counts. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), query.alias("asks")
    )
    rows = stored(rows, "nearest-rows")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if total < 2:
        return spark.createDataFrame([], schema)
    # Bounded: SAMPLE vectors, the same for the same rows.
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").select("v").limit(SAMPLE).collect()]
    sizes = [len(v) for v in sample]
    dimension = max(set(sizes), key=lambda n: (sizes.count(n), n))
    grid = fit(np.array([v for v in sample if len(v) == dimension]), total, neighbours, recall)
    rows = rows.where(F.size("v") == dimension)
    groups = max(partitions(spark), -(-total * grid.tables // ROWS_PER_TASK))

    same = Window.partitionBy(F.xxhash64("v"), F.hash("v"), "v").orderBy("id")
    able = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= neighbours + 1)

    def group_of(cells: np.ndarray) -> np.ndarray:
        mixed = cells.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)

    names = ["part_of", "asks", "id", "v", "cells"]
    travelling = "part_of int, asks boolean, id long, v array<double>, cells array<long>"

    def batch_of(part, asks, ids, data, cells, ends) -> pa.RecordBatch:
        width = np.arange(0, data.size + 1, dimension, dtype=np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(np.full(len(ids), asks)), pa.array(ids, pa.int64()),
            pa.ListArray.from_arrays(width, pa.array(data.ravel())), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(cells, pa.int64())),
        ], names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ids = _matrix(batch.column(1), dimension), batch.column(0).to_numpy()
            cells = grid.cells(_unit(data))
            for t in range(grid.tables):
                yield batch_of(group_of(cells[:, t]), False, ids, data, cells[:, t], np.arange(len(ids) + 1))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, QUERIES_AT_ONCE // 4):
                batch = whole.slice(low, QUERIES_AT_ONCE // 4)
                data, ids = _matrix(batch.column(1), dimension), batch.column(0).to_numpy()
                unit = _unit(data)
                cells = np.concatenate([grid.probes(unit, t) for t in range(grid.tables)], axis=1)
                part = group_of(cells.ravel()).astype(np.int64)
                key = np.repeat(np.arange(len(ids)), cells.shape[1]) * groups + part
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                head = key[order][starts]
                yield batch_of(head % groups, True, ids[head // groups], data[head // groups], cells.ravel()[order], np.append(starts, key.size))

    def everywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ids = _matrix(batch.column(1), dimension), batch.column(0).to_numpy()
            for part in range(groups):
                yield batch_of(np.full(len(ids), part), True, ids, data, np.zeros(0, np.int64), np.zeros(len(ids) + 1))

    indexed = able.select("id", "v").mapInArrow(index, travelling)
    parts = stored(
        indexed.groupBy("part_of").agg(F.ceil(F.count("*") / ROWS_PER_TASK).cast("int").alias("parts")), "nearest-parts"
    )

    def ranked(asked: DataFrame) -> DataFrame:
        own = indexed.join(parts, "part_of").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        to = asked.join(parts, "part_of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = own.unionByName(to).drop("parts").repartition("part_of", "part").sortWithinPartitions("part_of", "part", "asks")
        found = met.select("part_of", "part", "asks", "id", "v", "cells").mapInArrow(search, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranks = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
        return ranks.where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy().astype(np.int64)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(part) != 0) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if low == high:
                    continue
                if part[low] != now:
                    now, held = part[low], []
                first = low + int(np.argmax(asks[low:high])) if asks[low:high].any() else high
                if first > low:
                    rows = batch.slice(low, first - low)
                    held.append((rows.column(3).to_numpy(), _matrix(rows.column(4), dimension), rows.column(5).flatten().to_numpy()))
                if first < high and held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    for at in range(first, high, QUERIES_AT_ONCE):
                        yield _best(batch.slice(at, min(QUERIES_AT_ONCE, high - at)), *held[0], dimension, neighbours)

    asked = rows.where("asks").select("id", "v")
    result = stored(ranked(asked.mapInArrow(visits, travelling)), "nearest-found")
    short = result.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(neighbours, total - 1))
    missing = stored(rows.where("asks").join(short, F.col("id") == F.col("query_id"), "left_anti").select("id", "v"), "nearest-missing")
    if missing.isEmpty():
        return result
    again = ranked(missing.mapInArrow(everywhere, travelling))
    return result.join(missing.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(again)


def _best(asked: pa.RecordBatch, ids: np.ndarray, data: np.ndarray, cells: np.ndarray, dimension: int, neighbours: int) -> pa.RecordBatch:
    """The nearest of one part to each query among the rows of the cells that it visits."""
    queries, own = _matrix(asked.column(4), dimension), asked.column(3).to_numpy()
    length, norm = np.linalg.norm(queries, axis=1), np.linalg.norm(data, axis=1)
    near = (queries @ data.T) / length[:, None] / norm
    known, cell = np.unique(cells, return_inverse=True)
    lists = asked.column(5)
    visited = np.zeros((len(own), len(known)), bool)
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    here = known[at] == flat
    visited[np.repeat(np.arange(len(own)), sizes)[here], at[here]] = True
    visited[sizes == 0] = True  # no list: all cells
    near[~visited[:, cell] | (own[:, None] == ids)] = -np.inf
    if near.shape[1] > neighbours:
        least = np.partition(near, near.shape[1] - neighbours, axis=1)[:, -neighbours]
    else:
        least = np.full(len(own), -2.0)
    q, r = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
    score = np.einsum("ij,ij->i", queries[q], data[r]) / (length[q] * norm[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, q, side="left")
    top = np.arange(len(q)) - first < neighbours
    return pa.RecordBatch.from_arrays([pa.array(own[q[top]]), pa.array(ids[r[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])
