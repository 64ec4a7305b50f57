"""WARC archives: write captures, read them back, and merge their indexes into one.

Archives are files of whole records that Spark's text writer lays down in the shared folder:
a record is a string, and the blank lines that end it are the line separator, so any store
that Spark writes to will do. A payload of at least ``least`` bytes is stored once, as the
response of the smallest id; equal ones become revisit records that name it.

Reading parses each archive by the lengths in its headers and yields its captures as one
locally sorted run. Runs are dealt by ranges of (URL key, time, id) and each range merges its
pieces of all runs with a loser tree, so ranges follow each other in global order.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
NO_ID = "none"
RUN_SCHEMA = (
    "run string, run_row long, url_key string, captured_at string, page_id long, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, offset long, length long"
)
MERGED_SCHEMA = "range_no int, range_row long, " + RUN_SCHEMA


def _header(*lines: Column | tuple) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for line in lines for p in (*line, "\r\n")))


def records(captures: DataFrame, least: int = 100) -> DataFrame:
    """(record) strings of captures (page_id, url, captured_at as ISO text, payload as text).

    Of captures with equal payloads of ``least`` bytes or more, that with the smallest id is the
    response, the others revisit it; all smaller ones are responses. Rows that share both id and
    payload are the same capture: all of them are responses. A null payload is empty; control
    characters and blanks of a URL become %20. A null id counts as larger than all others.
    """
    body = captures.select(
        "page_id", F.coalesce("payload", F.lit("")).alias("payload"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce("captured_at", F.lit("1970-01-01T00:00:00Z")).alias("captured_at"),
    ).withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("long")})
    # Slim: ids and digests alone are folded, and only payloads that several ids share are joined.
    first = (
        body.where(F.col("bytes") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    )
    joined = body.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = _header(("HTTP/1.1 200 OK",), ("Content-Type: text/html; charset=utf-8",), ("Content-Length: ", F.col("bytes")), ())
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit(NO_ID)), F.lit(">"))
    block_bytes = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        _header(
            ("WARC/1.1",), ("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID: ", uri("page_id")),
            ("WARC-Date: ", F.col("captured_at")), ("WARC-Target-URI: ", F.col("url")),
            ("WARC-Payload-Digest: sha256:", F.col("digest")),
        ),
        F.when(revisit, _header(
            ("WARC-Refers-To: ", uri("first_id")),
            ("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",),
        )).otherwise(""),
        _header(("Content-Type: application/http; msgtype=response",), ("Content-Length: ", block_bytes), ()),
    )
    return joined.withColumn("http", http).select(
        F.concat(header, F.col("http"), F.when(revisit, "").otherwise(F.col("payload"))).alias("record")
    )


def write_archives(captures: DataFrame, path: str, least: int = 100, records_per_file: int = 10_000) -> None:
    """Gzipped WARC files under ``path``; ``records_per_file`` bounds what a reader holds at once."""
    (
        records(captures, least).write.option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def url_key(url: str) -> str:
    """Sort key: host labels reversed and comma-joined, then ``)`` and the path with the query."""
    rest = url.partition("://")[2] or url
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def _parse(content: bytes) -> Iterator[tuple]:
    stream = io.BytesIO(zlib.decompress(content, 47)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    page = lambda text: None if text is None or text == NO_ID else int(text)
    inside = lambda text: text and text[len("<urn:page:") : -1]

    def head() -> dict[str, str]:
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        return fields

    while True:
        offset = stream.tell()
        fields = head()
        if not fields:
            return
        start, length = stream.tell(), int(fields["Content-Length"])
        http = head()
        payload = stream.read(start + length - stream.tell())
        if stream.read(len(END)) != END.encode():
            raise ValueError(f"record at {offset} does not end where its length says")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != int(http["Content-Length"]) or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload at {offset} does not match its digest")
        yield (
            url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], page(inside(fields["WARC-Record-ID"])), kind,
            page(inside(fields.get("WARC-Refers-To"))), int(http["Content-Length"]), digest, offset, stream.tell() - offset,
        )


_ORDER = lambda key: (key[0], key[1], key[2] is None, key[2] or 0)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; each file is a run, sorted by key, time and id.

    Checks every record's end, and the length and digest of every stored payload.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RUN_SCHEMA.split(",")]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = sorted(_parse(bytes(content)), key=_ORDER)
                out = pd.DataFrame([(name, i, *row) for i, row in enumerate(rows)], columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("path", "content").mapInPandas(run, RUN_SCHEMA)


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, so a new row replays only one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.rows: list[tuple | None] = [next(r, None) for r in runs]
        self.keys = [None if r is None else key(r) for r in self.rows]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node > 0:
            other = self.losers[node]
            if other < 0:  # first visit: wait here for the opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[winner := self.losers[0]] is not None:
            yield self.rows[winner]
            self.rows[winner] = row = next(self.runs[winner], None)
            self.keys[winner] = None if row is None else self.key(row)
            self._replay(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Adds (range_no, range_row): their order is the global order by URL key, time and id.

    Ranges are cut by Spark from a sample of the keys, on all three columns, so captures of one hot URL
    spread over ranges too. A task holds the slim index rows of its range.
    """

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[str, list[tuple]] = {}
        for frame in frames:
            clean = frame.astype(object).where(frame.notna(), None)
            for row in clean.itertuples(index=False, name=None):
                pieces.setdefault(row[0], []).append(row)
        tree = LoserTree([iter(pieces[r]) for r in sorted(pieces)], lambda row: _ORDER(row[2:5]))
        number, out = TaskContext.get().partitionId(), []
        names = [c.split()[0] for c in MERGED_SCHEMA.split(",")]
        typed = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        for i, row in enumerate(tree):
            out.append((number, i, *row))
            if len(out) == 10_000:
                yield typed(out)
                out = []
        yield typed(out)

    dealt = runs.repartitionByRange("url_key", "captured_at", F.col("page_id").asc_nulls_last())
    return dealt.sortWithinPartitions("run", "run_row").mapInPandas(merge, MERGED_SCHEMA)


def pieces_of(rows: Iterable[tuple], key) -> Iterator[tuple]:
    """Merge of already sorted lists; a helper for callers outside Spark jobs."""
    return iter(LoserTree([iter(r) for r in rows], key))
