"""Structured Streaming jobs for incremental work.

Sources are any streaming DataFrame; the helpers only add transformations and a
sink. State is bounded by watermarks, and each sink tolerates a replayed batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import lexicon as lx
from ..functions.text import squash_ascii
from ..sources import keyed


def file_stream(
    spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None, files: str | None = None
) -> DataFrame:
    """Stream of parquet files in a folder with the schema of a static frame."""
    reader = spark.readStream.schema(like.schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def new_documents(stream: DataFrame, key: str, event_time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once within the lateness bound; later repeats are left to the sink's key."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def publication_counts(stream: DataFrame, event_time: str, window: str = "1 day", lateness: str = "1 day", *by: str) -> DataFrame:
    """Tumbling counts; a window is final once the watermark has passed its end."""
    counts = stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *by)
    return counts.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n"
    )


def sanity_alerts(
    stream: DataFrame, event_time: str, metric: str, low: float, high: float, window: str = "1 hour", lateness: str = "1 hour"
) -> DataFrame:
    """Per window: rows, null metrics, and values outside the plausible range."""
    value = F.col(metric)
    out = F.when((value < low) | (value > high), 1)
    counts = stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window)).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(value.isNull(), 1)).alias("missing"), F.count(out).alias("suspect")
    )
    return counts.filter("missing > 0 OR suspect > 0").select(
        F.col("window.start").alias("window_start"), "n", "missing", "suspect"
    )


def window_rows(stream: DataFrame, event_time: str, keys: list[str], metric: str, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Per window: how often each row of keys and metric came. State holds the different rows of open windows."""
    counts = stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *keys, metric).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, metric, "n")


def window_checks(rows: DataFrame, metric: str, ratio: float = lx.MAGNITUDE_RATIO, row_limit: int = lx.ROW_LIMIT_WARN) -> DataFrame:
    """(window_start, check_name, n) of the checks that a window's counted rows do not pass; as in the batch check.

    ``duplicates``: rows beyond the first of each; ``magnitude``: the largest positive value against the smallest;
    ``many rows``: their number. A window without a warning gives no row.
    """
    positive = F.when(F.col(metric) > 0, F.col(metric))
    spread = F.max(positive) / F.min(positive)
    folded = rows.groupBy("window_start").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("extra"), spread.alias("spread"))
    warn = lambda bad, name, n: F.when(bad, F.struct(F.lit(name).alias("check_name"), n.cast("long").alias("n")))
    checks = F.array(
        warn(F.col("extra") > 0, "duplicates", F.col("extra")), warn(F.col("spread") >= ratio, "magnitude", F.round("spread")),
        warn(F.col("rows") > row_limit, "many rows", F.col("rows")))
    return folded.select("window_start", F.inline(F.filter(checks, lambda x: x.isNotNull())))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet table, all available input in one run."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def keep_current(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write the rows each batch adds or changes under its number; ``current`` reads the newest row of a key.

    In update mode every window is there as soon as it has a row, also those that the watermark has not
    passed. A replayed batch overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(write).start()
    )


def current(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row of each key; folds on the map side."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def keep_table(
    stream: DataFrame, path: str, checkpoint: str, key: str, merge: keyed.Merge, buckets: int = 64, mode: str = "append", gather: bool = True
) -> StreamingQuery:
    """Keep a keyed table current: each batch rewrites the buckets of its own keys alone, and a replay changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed.merge_batch(batch, path, batch_id, key, merge, buckets, gather)

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(write).start()
    )


def upsert_documents(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = 64) -> StreamingQuery:
    """Keep one row per key: the first by ``order``, in whatever batch it comes and however late."""
    return keep_table(stream, path, checkpoint, key, keyed.first_by(key, order), buckets, gather=False)


class SessionRounds(StatefulProcessor):
    """Rounds of one session at a time, from the turns its state keeps.

    A timer that every turn pushes on closes a session after ``idle_ms`` without one: its turns leave the state,
    its rounds stay as they are, and what comes after is passed over. Turns and due time are one value, as each
    call of the state waits for an answer of the JVM: a session costs one read, one write and two of its timer.
    """

    CLOSED = -1

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "due long, turns string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.session.get()
        if stored is not None and stored[0] == self.CLOSED:
            return
        known = {(s, q) for s, q in json.loads(stored[1])} if stored is not None else set()
        turns = known | {(int(s), q) for frame in rows for s, q in zip(frame["seq"], frame["question"], strict=True)}
        turns = sorted(turns, key=_place)
        if stored is not None:
            self.handle.deleteTimer(stored[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        self.session.update((due, json.dumps(turns, ensure_ascii=False)))
        yield pd.DataFrame([(key[0], *r) for r in _rounds(turns)], columns=["session_id", "round_no", "seq", "question", "asked"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.update((self.CLOSED, "[]"))
        return iter([])

    def close(self) -> None:
        pass


def _place(turn: tuple) -> tuple:
    return turn[0], turn[1] or ""


def _rounds(turns: list[tuple]) -> list[tuple]:
    """(round_no, seq, question, asked): consecutive equal questions share a round.

    As in the batch version, a turn without text goes on with the round, and so does the one after it.
    """
    rounds: list[tuple] = []
    previous = None
    for seq, question in turns:
        if rounds and (previous is None or question is None or question == previous):
            rounds[-1] = (len(rounds), seq, question, rounds[-1][3] + 1)
        else:
            rounds.append((len(rounds) + 1, seq, question, 1))
        previous = question
    return rounds


def session_rounds(stream: DataFrame, idle_ms: int) -> DataFrame:
    """(session_id, round_no, seq, question, asked): all rounds of every session a batch touches.

    Turns (session_id, seq, question) may come late and repeatedly; they take their place by ``seq``.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    turns = stream.select("session_id", F.col("seq").cast("long").alias("seq"), squash_ascii(F.col("question")).alias("question"))
    schema = f"session_id {kind['session_id']}, round_no long, seq long, question string, asked long"
    return turns.groupBy("session_id").transformWithStateInPandas(SessionRounds(idle_ms), schema, "Update", "ProcessingTime")


#: State on disk, and no batches without data: timers are looked at with the next turns.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def live_round_collapse(stream: DataFrame, rounds_path: str, checkpoint: str, buckets: int = 64, idle_ms: int = 30 * 86_400_000) -> StreamingQuery:
    """Keep collapsed rounds current for the sessions each batch touches.

    Turns live in a state store (RocksDB), so no batch reads what earlier ones have landed, and the rounds of a
    touched session replace its earlier ones in a keyed table.
    """
    conf = stream.sparkSession.conf
    before = {name: conf.get(name) for name in STATE}
    try:  # a query takes its settings when it starts
        for name, value in STATE.items():
            conf.set(name, value)
        return keep_table(session_rounds(stream, idle_ms), rounds_path, checkpoint, "session_id", keyed.replaced("session_id"), buckets, "update")
    finally:
        for name, value in before.items():
            conf.set(name, value)
