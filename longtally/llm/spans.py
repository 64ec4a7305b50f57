"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences, and every run of several consecutive sentences is hashed (128
bits). A run starts at every sentence and is the shortest with at least ``least_sentences`` and
``least_words``; what it is depends on its own words alone, so a passage has the same runs
wherever it stands. Runs are folded to (number of documents, smallest id) and joined with those
that several documents have; sentences covered by any occurrence but the first are removed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Ends of sentences: marks followed by white space, line ends, and the full-width marks (UTF-8).
_END = re.compile(rb"[.!?]+\s+|\n\s*|\xe3\x80\x82\s*|\xef\xbc[\x81\x9f]\s*")
#: Longer sentences are cut after words whose checksum is divisible by CUT: lists and unpunctuated text have runs too.
LONG_SENTENCE, CUT = 24, 8
_WORD = re.compile(rb"\S+\s*")


def sentences(text: bytes) -> list[bytes]:
    """The text's sentences with what follows them; joined, they are the text."""
    found, at = [], 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        piece = text[at:end]
        at = end
        if not piece:
            continue
        if len(piece) > 2 * LONG_SENTENCE and len(piece.split()) > LONG_SENTENCE:
            low = 0
            for word in _WORD.finditer(piece):
                if zlib.crc32(word.group().lower().strip()) % CUT == 0:
                    found.append(piece[low : word.end()])
                    low = word.end()
            if low < len(piece):
                found.append(piece[low:])
        else:
            found.append(piece)
    return found


def runs(pieces: list[bytes], least_sentences: int, least_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentence behind the last, digest) of every run; case of A-Z and white space do not count."""
    words = [p.lower().split() for p in pieces]
    keys = [b" ".join(w) for w in words]
    counts = [len(w) for w in words]
    end, total = 0, 0
    for start in range(len(pieces)):
        while end < len(pieces) and (end - start < least_sentences or total < least_words):
            total += counts[end]
            end += 1
        if end - start < least_sentences or total < least_words:
            return
        yield start, end, xxhash.xxh3_128_digest(b"\n".join(keys[start:end]))
        total -= counts[start]


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 7) - (1 << 63)


def remove_repeats(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least_sentences: int = 2, least_words: int = 10) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed_words, kept_text) of every row.

    A run's first occurrence is in the document with the smallest id, and there the first in the text; all
    others are removed. Rows that share id and text are one document. A null id counts as larger than all
    others. A null text has no sentences and stays null, a text without repeats stays as it is to the byte.
    Other columns are left out. An empty table gives no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, ids, keys, at = [], [], [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                content = value.as_py()
                if not content:
                    continue
                key, seen = _key(content), set()
                for start, _, digest in runs(sentences(content), least_sentences, least_words):
                    if digest not in seen:  # later ones of the same text are not first anyway
                        seen.add(digest)
                        high.append(int.from_bytes(digest[:8], "little", signed=True))
                        low.append(int.from_bytes(digest[8:], "little", signed=True))
                        ids.append(doc)
                        keys.append(key)
                        at.append(start)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (high, low, ids, keys)), pa.array(at, pa.int32())], ["h1", "h2", "doc_id", "text_key", "at"]
            )

    marks = stored(rows.mapInArrow(spans, "h1 long, h2 long, doc_id long, text_key long, at int"), "spans")
    never = F.lit(2**63 - 1)
    order = F.coalesce("doc_id", never)
    shared = (
        marks.groupBy("h1", "h2").agg(F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.min("text_key").alias("k1"), F.max("text_key").alias("k2"), F.count("*").alias("n"))
        .where("n > 1 AND (first_id < last_id OR k1 < k2)").select("h1", "h2", "first_id")
    )
    shared_marks = stored(marks.join(stored(shared, "spans-shared"), ["h1", "h2"]).withColumn("first", order == F.col("first_id")), "spans-marks")
    # Several texts may share the smallest id: of them the one with the smallest checksum is the first.
    twins = (
        shared_marks.where("first").groupBy("h1", "h2").agg(F.min("text_key").alias("k1"), F.max("text_key").alias("k2"))
        .where("k1 < k2").select("h1", "h2", "k1")
    )
    second = shared_marks.where("first").join(stored(twins, "spans-twins"), ["h1", "h2"]).where("text_key > k1")
    later = shared_marks.where("NOT first").select("doc_id", "text_key", "at").union(second.select("doc_id", "text_key", "at"))
    # A group is one text: its list is no longer than its sentences.
    removed = stored(later.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("at")), "spans-removed")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "text", "text_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value, at in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                content = value.as_py()
                pieces = sentences(content or b"")
                gone, seen, elsewhere = set(), set(), set(at or ())
                for start, end, digest in runs(pieces, least_sentences, least_words):
                    if start in elsewhere or digest in seen:
                        gone.update(range(start, end))
                    seen.add(digest)
                kept = None if content is None else b"".join(p for i, p in enumerate(pieces) if i not in gone)
                for column, v in zip(out, (len(pieces), len(gone), sum(len(pieces[i].split()) for i in gone), kept), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())],
                ["doc_id", "text", "n_sentences", "n_removed", "removed_words", "kept_text"],
            )

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("text_key", T.LongType())])
    joined = rows.mapInArrow(keyed, schema).join(
        removed.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "at"),
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key")), "left",
    )
    return joined.select("doc_id", "text", "at").mapInArrow(
        cut, "doc_id long, text string, n_sentences long, n_removed long, removed_words long, kept_text string"
    )
