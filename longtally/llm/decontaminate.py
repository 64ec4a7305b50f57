"""Benchmark decontamination by Wu-Manber search over words.

The letters of the search are words: each word of the test items has a number, all other
words are 0. Test items become windows of consecutive words. For windows of one length:

* a shift table over hashed blocks of two words says how far the end of the window may move
  on (most blocks of a text are in no window, so it moves by nearly the window length);
* where the shift is 0, the hash of the last block selects a bucket of windows;
* a hash of the first words and then the comparison of all words confirm an occurrence.

Numpy moves many places of the text at once. Test items are read in passes of a bounded
number of windows; each pass broadcasts its own tables, so the size of a broadcast does not
grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are part of words keep their value, A-Z become a-z, all others blanks.
_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
TABLE_BITS = 18
LANE = 512


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, letters a-z and all characters beyond ASCII."""
    return (text or b"").translate(_KEEP).split()


def _block(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B1) + right.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)).astype(np.int64) & ((1 << TABLE_BITS) - 1)


class Search:
    """Tables for windows of one length."""

    def __init__(self, windows: np.ndarray):
        self.windows = windows
        self.length = m = windows.shape[1]
        self.back = 1 if m > 1 else 0
        self.shift = np.full(1 << TABLE_BITS, m - self.back, np.uint8)
        for end in range(self.back, m):
            np.minimum.at(self.shift, _block(windows[:, end - self.back], windows[:, end]), m - 1 - end)
        suffix = _block(windows[:, m - 1 - self.back], windows[:, m - 1])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << TABLE_BITS) + 1))
        self.prefix = _block(windows[:, 0], windows[:, self.back])

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Ends of possible occurrences, found by skipping."""
        m = self.length
        starts = np.arange(m - 1, len(text), LANE)
        stops = np.minimum(starts + LANE, len(text))
        found = []
        while len(starts):
            shift = self.shift[_block(text[starts - self.back], text[starts])]
            here = shift == 0
            if here.any():
                found.append(starts[here])
            starts = starts + np.maximum(shift, 1)
            alive = starts < stops
            starts, stops = starts[alive], stops[alive]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end of the occurrence, number of the window), every occurrence of every window."""
        ends = self.candidates(text)
        key = _block(text[ends - self.back], text[ends])
        low, high = self.bucket[key], self.bucket[key + 1]
        at, which = [], []
        rank = 0
        while len(ends):
            alive = low + rank < high
            ends, low, high = ends[alive], low[alive], high[alive]
            window = self.order[low + rank]
            first = ends - self.length + 1
            near = self.prefix[window] == _block(text[first], text[first + self.back])
            e, w = ends[near], window[near]
            same = np.ones(len(e), bool)
            for k in range(self.length):
                same &= text[e - self.length + 1 + k] == self.windows[w, k]
            at.append(e[same])
            which.append(w[same])
            rank += 1
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Pass:
    """Vocabulary, windows by length, and the items that have each window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        owners: dict[tuple[int, ...], set] = {}
        for item, ws in items:
            ids = [self.number[w] for w in ws]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1):
                owners.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.searches, self.owners = [], []
        for width in sorted({len(k) for k in owners}):
            keys = [k for k in owners if len(k) == width]
            self.searches.append(Search(np.array(keys, np.int32)))
            self.owners.append([sorted(o for o in owners[k] if o is not None) for k in keys])

    def numbers(self, text: bytes | None) -> np.ndarray:
        """The words of a text as numbers of this pass."""
        return np.fromiter(map(self.number.get, words(text), repeat(0)), np.int32)

    def scan(self, texts: list[np.ndarray]) -> Iterator[tuple[list[tuple[int, int]], set]]:
        """Hit spans (start, end in words) and item ids of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(texts), np.int32)  # a 0 ends each text: no window spans two
        for b, n, ws in zip(begin, sizes, texts, strict=True):
            text[b : b + n] = ws
        edge = np.zeros(len(text) + 1, np.int32)
        items: dict[int, set] = {}
        for search, owners in zip(self.searches, self.owners, strict=True):
            ends, which = search.occurrences(text)
            np.add.at(edge, ends - search.length + 1, 1)
            np.add.at(edge, ends + 1, -1)
            document = np.searchsorted(begin, ends, side="right") - 1
            pairs = np.unique(np.stack([document, which]), axis=1)
            for d, w in pairs.T.tolist():
                items.setdefault(d, set()).update(owners[w])
        covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        change = np.diff(covered)
        first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        left, right = np.searchsorted(first, begin), np.searchsorted(first, begin + sizes)
        for i, b in enumerate(begin):
            yield [(int(s - b), int(e - b)) for s, e in zip(first[left[i] : right[i]], last[left[i] : right[i]], strict=True)], items.get(i, set())


def _passes(benchmark: DataFrame, item_id: str, text: str, window: int, windows_per_pass: int) -> Iterator[Pass]:
    pending, size = [], 0
    for item, content in benchmark.select(F.col(item_id), F.col(text).cast("binary")).toLocalIterator():
        ws = words(bytes(content) if content is not None else None)
        if ws:
            pending.append((item, ws))
            size += len(ws)
        if size >= windows_per_pass:
            yield Pass(pending, window)
            pending, size = [], 0
    yield Pass(pending, window)

#: Columns that ``find_contamination`` adds.
ADDED = ("n_words", "hit_spans", "hit_items")


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, windows_per_pass: int = 500_000,
) -> DataFrame:
    """Adds to each document ``n_words`` (long), ``hit_spans`` (array of start and end in words, disjoint,
    ascending) and ``hit_items`` (array of the item ids with an occurring window, ascending).

    A window is ``window`` consecutive words of an item; a shorter item, but not an empty one, is one
    window. Null and empty texts have no words and no hits. Items without an id hit, but are not listed.
    Repeated documents and items are judged alike. Columns of these names in the input are replaced.
    """
    kept = [c for c in documents.columns if c not in ADDED]
    schema = T.StructType([
        *(documents.schema[c] for c in kept), T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("hit_items", T.ArrayType(T.LongType())),
    ])
    arrow = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
    context = documents.sparkSession.sparkContext
    at = kept.index(text)
    found = documents.select(*(f"`{c}`" for c in kept))
    for number, tables in enumerate(_passes(benchmark, item_id, item_text, window, windows_per_pass)):
        sent = context.broadcast(tables)

        def run(batches, sent=sent, number=number):
            for batch in batches:
                texts = [sent.value.numbers(t) for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
                spans, items = [], []
                for s, i in sent.value.scan(texts):
                    spans.append(s)
                    items.append(sorted(i))
                if number:
                    spans = [_union(a, b) for a, b in zip(batch.column(len(kept) + 1).to_pylist(), spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.column(len(kept) + 2).to_pylist(), items, strict=True)]
                values = ([len(t) for t in texts], spans, items)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(kept)], *(pa.array(v, t) for v, t in zip(values, arrow, strict=True))], [*kept, *ADDED]
                )

        found = found.mapInArrow(run, schema)
    return found


def _union(one: list, other: list) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted([*map(tuple, one), *map(tuple, other)]):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def n_hit():
    """Column: number of hit words, from ``hit_spans``."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
