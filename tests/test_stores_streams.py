"""Writers, incremental reads and streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from longtally.operators import trace
from longtally.sources import keyed, publish, status, stores, workspace
from longtally.streaming import live


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "1", "x"), ("k", "1", "x")], "url string, t string, c string")
    new = spark.createDataFrame([("a", "1", None, 1), ("b", "2", "x", 2), ("b", "9", "x", 3), ("n", "1", "x", 4)], "url string, t string, c string, i int")
    got = {r.url: (r.t, r.outcome) for r in stores.upsert_outcomes(old, new, "url", ["t", "c"], F.col("i")).collect()}
    assert got == {"a": ("1", "unchanged"), "b": ("2", "updated"), "k": ("1", "kept"), "n": ("1", "inserted")}
    assert [r.url for r in stores.insert_ignore(old, new, ["url"], F.col("i")).collect()] == ["n"]


def test_pending_ignores_null_keys(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    done = spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.id for r in stores.pending(docs, done, "id").collect()] == [2]


def test_replace_by_name_and_split(spark):
    path = workspace.new_path(spark, "replace")
    frame = lambda rows: spark.createDataFrame(rows, "analysis_name string, v int")
    stores.replace_by_name(frame([("a", 1), ("b", 1)]), path)
    stores.replace_by_name(frame([("a", 2)]), path)
    assert {(r.analysis_name, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_workspace_writes_once_for_each_state_of_its_inputs(spark, tmp_path):
    calls = []
    (tmp_path / "table.parquet").write_bytes(b"one")

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert workspace.written(spark, "once", str(tmp_path), build).count() == 3
    assert calls == [1]
    (tmp_path / "table.parquet").write_bytes(b"another")
    assert workspace.written(spark, "once", str(tmp_path), build).count() == 3
    assert calls == [1, 1]


def stream_of(spark, rows, schema, parts=1):
    path = workspace.new_path(spark, "source")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return live.file_stream(spark, path, spark.read.parquet(path), max_files=1)


def test_counts_wait_for_the_watermark(spark):
    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    stream = stream_of(spark, [(t(1),), (t(1, 5),), (t(2),), (t(9),)], "ts timestamp")
    path = workspace.new_path(spark, "counts")
    live.append_to(live.publication_counts(stream, "ts"), path, workspace.new_path(spark, "cp")).awaitTermination()
    got = {(r.window_start.day, r.n) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 2), (2, 1)}


def test_live_collapse_over_several_batches(spark):
    rows = [("s", i, q) for i, q in enumerate(["a", "a", "b", "b", "a", "c"])]
    stream = stream_of(spark, rows, "session_id string, seq int, question string", parts=3)
    rounds = workspace.new_path(spark, "rounds")
    live.live_round_collapse(stream, rounds, workspace.new_path(spark, "cp")).awaitTermination()
    got = [(r.round_no, r.question) for r in keyed.current(spark, rounds).orderBy("round_no").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "a"), (4, "c")]


def test_new_documents_once(spark):
    t = datetime.datetime(2024, 1, 1)
    stream = stream_of(spark, [("a", t), ("a", t), ("b", t)], "k string, ts timestamp", parts=2)
    path = workspace.new_path(spark, "docs")
    live.append_to(live.new_documents(stream, "k", "ts"), path, workspace.new_path(spark, "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_split_by_source_and_csv(spark):
    df = spark.createDataFrame([(1, "XLSX"), (2, "BULLETIN"), (3, "XLSX")], "id int, source_type string")
    path = workspace.new_path(spark, "split")
    stores.write_by_source(df, path)
    assert [r.id for r in spark.read.parquet(f"{path}/source_type=BULLETIN").collect()] == [2]
    out = workspace.new_path(spark, "csv")
    stores.write_csv(df, out)
    assert sorted(spark.read.option("header", True).csv(out).columns) == ["id", "source_type"]


def test_stream_counts_add_up_to_all_events(spark):
    from longtally.plans import catalog

    sf = "/root/testdata/sf0.001"
    counts = catalog.load()["stream_daily_counts"](spark, sf)
    assert sum(r["n"] for r in counts.collect()) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_keyed_upsert_takes_a_late_repeat_once(spark):
    schema = "key string, at int, text string"
    path, checkpoint = workspace.new_path(spark, "upsert"), workspace.new_path(spark, "upsert-checkpoint")
    source = workspace.new_path(spark, "upsert-source")
    for rows in ([("a", 1, "x"), ("b", 5, "y"), ("a", 0, "first")], [("a", 99, "late repeat"), ("c", 7, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        live.upsert_documents(stream, path, checkpoint, "key", "at").awaitTermination()
    got = sorted((r["key"], r["text"]) for r in keyed.current(spark, path).collect())
    assert got == [("a", "first"), ("b", "y"), ("c", "z")]


def watched(query, seconds=150):
    assert query.awaitTermination(seconds), "stream did not end"
    return [p for p in query.recentProgress if p.numInputRows]


def test_rounds_of_late_turns_over_many_batches(spark):
    rng = random.Random(2)
    turns = [(s, i, rng.choice([" ask  a", "ask a", "b", None, ""])) for s in "xyz" for i in range(40)] + [("w", 0, "only")]
    dealt = turns[::-1][:60] + turns
    stream = stream_of(spark, dealt, "session_id string, seq long, question string", parts=10)
    rounds = workspace.new_path(spark, "rounds")
    seen = watched(live.live_round_collapse(stream, rounds, workspace.new_path(spark, "cp"), buckets=4))
    assert len(seen) == 10 and max(p.numInputRows for p in seen) <= len(dealt) // 10 + 1  # no batch reads earlier turns
    want = trace.collapse_rounds(spark.createDataFrame(turns, "session_id string, seq long, question string")).collect()
    columns = ("session_id", "round_no", "seq", "question", "asked")
    values = lambda rows: sorted(tuple(r[c] for c in columns) for r in rows)
    assert values(keyed.current(spark, rounds).collect()) == values(want)


def test_a_session_costs_few_calls_of_its_state():
    import pandas as pd

    class Handle:
        calls = 0
        value = None

        def __getattr__(self, name):  # every state and timer call counts
            def call(*args):
                Handle.calls += 1
                if name == "update":
                    Handle.value = args[0]
                return Handle.value if name == "get" else None

            return call

        def getValueState(self, *_):
            return self

        getListState = getValueState

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 5)

    rounds = live.SessionRounds(10)
    rounds.init(Handle())
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["seq", "question"])])
    list(rounds.handleInputRows(("s",), frame([(2, "b"), (0, "a")]), Clock))
    Handle.calls = 0
    (got,) = rounds.handleInputRows(("s",), frame([(1, "a"), (2, "b"), (3, None)]), Clock)
    assert Handle.calls <= 4
    assert got[["round_no", "seq", "asked"]].values.tolist() == [[1, 1, 2], [2, 3, 2]]


def test_idle_sessions_are_closed(spark):
    schema = "session_id string, seq long, question string"
    source, rounds, checkpoint = (workspace.new_path(spark, n) for n in ("idle", "idle-rounds", "idle-cp"))
    for rows in ([("a", 0, "x"), ("b", 0, "x")], [("b", 1, "y")], [("a", 1, "late"), ("b", 2, "late")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        watched(live.live_round_collapse(spark.readStream.schema(schema).parquet(source), rounds, checkpoint, buckets=2, idle_ms=1))
    got = sorted((r.session_id, r.round_no) for r in keyed.current(spark, rounds).collect())
    assert ("a", 1) in got and ("a", 2) not in got  # closed by the timer before its late turn


def test_first_row_by_order_in_whatever_batch(spark):
    schema = "key string, at int, text string"
    source, path, checkpoint = (workspace.new_path(spark, n) for n in ("first", "first-table", "first-cp"))
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(50)]), f"t{i}") for i in range(60)]
    for i in range(6):
        spark.createDataFrame(rows[i * 10 : i * 10 + 10], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("a", 99, "too late")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = live.file_stream(spark, source, spark.read.schema(schema).parquet(source), max_files=1)
    assert len(watched(live.upsert_documents(stream, path, checkpoint, "key", "at", buckets=16))) == 7
    want = {}
    for key, at, text in rows:
        place = (at is None, at or 0, text)
        want[key] = min(want.get(key, place), place)
    assert {r["key"]: (r["at"] is None, r["at"] or 0, r["text"]) for r in keyed.current(spark, path).collect()} == want
    told = keyed.outcomes(spark, path).collect()
    assert sum(r["n"] for r in told if r["outcome"] == "inserted") == len(want)
    last = [r for r in told if r["batch"] == 6]
    assert [(r["outcome"], r["n"], r["buckets"]) for r in last] == [("unchanged", 1, 1)]  # one bucket of 16 rewritten


def test_first_rows_are_shuffled_once(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, at int, v string")
    old, new = frame([("a", 2, "x"), (None, None, "y"), ("c", 1, "z")]), frame([("a", 1, "n"), (None, 5, "m"), ("b", None, "o"), ("c", 1, "zz")])
    merged = keyed.first_by("k", "at")(old, new)
    want = {("a", 1, "n", "updated"), (None, 5, "m", "updated"), ("b", None, "o", "inserted"), ("c", 1, "z", "unchanged")}
    assert {tuple(r) for r in merged.collect()} == want
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_batch_is_applied_once_and_lost_ones_are_finished(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    path, merge = workspace.new_path(spark, "keyed"), keyed.newest("k", ["v"], F.col("v"))
    keyed.merge_batch(frame([(i, "old") for i in range(20)]), path, 0, "k", merge, 4)
    keyed.merge_batch(frame([(1, "new"), (50, "in")]), path, 1, "k", merge, 4)
    keyed.merge_batch(frame([(1, "replayed with other rows")]), path, 1, "k", merge, 4)
    files = publish.Folders(spark, path)
    values = lambda: {r.k: r.v for r in keyed.current(spark, path).collect()}
    assert values() == {i: "old" for i in range(20)} | {1: "new", 50: "in"}
    assert {(r.batch, r.outcome, r.n) for r in keyed.outcomes(spark, path).collect()} == {(0, "inserted", 20), (1, "updated", 1), (1, "inserted", 1)}
    # lost before it was complete: dropped; lost while buckets were moved: finished
    frame([(2, "half")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/_next/batch=2")
    keyed.recover(spark, path)
    assert values()[2] == "old" and not files.names(f"{path}/_next")
    bucket = next(r[0] for r in frame([(2, "x")]).select(keyed.bucket_of("k", 4)).collect())
    kept = spark.read.parquet(f"{path}/bucket={bucket}").withColumn("v", F.when(F.col("k") == 2, "moved").otherwise(F.col("v")))
    kept.withColumn("bucket", F.lit(bucket)).write.partitionBy("bucket").parquet(f"{path}/_next/batch=2")
    spark.createDataFrame([(2, "updated", 1, 1)], "batch long, outcome string, n long, buckets int").write.parquet(f"{path}/_next/batch=2/_counts")
    files.mark(f"{path}/_next/batch=2/{publish.COMPLETE}")
    files.move(f"{path}/bucket={bucket}", f"{path}/_old/batch=2/bucket={bucket}")  # here the job was lost
    keyed.recover(spark, path)
    assert values()[2] == "moved" and len(values()) == 21 and "_old" not in [n for n in files.names(path) if files.names(f"{path}/{n}")]
    assert keyed.outcomes(spark, path).where("batch = 2").count() == 1


def test_a_failing_writer_leaves_the_table(spark):
    path, backup = workspace.new_path(spark, "table"), workspace.new_path(spark, "backup")
    rows = lambda v: spark.createDataFrame([(v,)], "v int")
    rows(1).write.parquet(path)
    with pytest.raises(Exception, match="no luck"):
        stores.rebuild_table(spark, rows(2).select(F.raise_error(F.lit("no luck")).alias("v")), path, backup)
    assert spark.read.parquet(path).first().v == 1
    assert stores.rebuild_table(spark, spark.read.parquet(path).select((F.col("v") + 1).alias("v")), path, backup).first().v == 2
    assert spark.read.parquet(backup).first().v == 1
    with pytest.raises(FileExistsError):
        stores.rebuild_table(spark, rows(3), path, backup)
    # lost between the two renames
    third, files = workspace.new_path(spark, "backup"), publish.Folders(spark, path)
    aside = publish._beside(path, "next")
    rows(3).write.parquet(aside)
    files.mark(f"{aside}/{publish.COMPLETE}")
    files.move(path, third)
    publish.recover(spark, path, third)
    assert spark.read.parquet(path).first().v == 3 and spark.read.parquet(third).first().v == 2


def test_csv_files_start_with_a_mark(spark):
    path = workspace.new_path(spark, "csv")
    stores.write_csv(spark.range(6).select("id", F.lit("值").alias("名")).repartition(3), path)
    files = [r.content for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) == 3 and all(bytes(f).startswith(b"\xef\xbb\xbfid,") for f in files)


def test_status_log_folds_to_states(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    log = [
        (1, 1, "FAILED", t(0), 1), (1, 1, "FAILED", t(1), 2), (1, 1, "FAILED", t(1), 2), (2, 1, "DONE", t(0), 1), (2, 2, "XLSX_FAIL", t(2), 1), (2, 1, "FAILED", t(3), 1),
        (3, 1, "DONE", t(0), 1), (3, 1, "FAILED", t(1), 1), (4, 2, "XLSX_DONE", t(0), 1), (None, 1, "DONE", t(0), 1), (5, 1, "DONE", None, 1), (6, 1, "DONE", t(0), 1),
    ]
    state = status.current(spark.createDataFrame(log, status.LOG))
    assert {r.doc_id: (r.status, r.attempts, r.failures) for r in state.collect()} == {
        1: ("FAILED", 2, 2), 2: ("XLSX_FAIL", 2, 1), 3: ("DONE", 1, 0), 4: ("PENDING", 0, 0), 6: ("DONE", 1, 0)
    }
    records = spark.createDataFrame([(i, c) for i, c in enumerate([None, "统计月报", "统计月报", "统计月报", "统计公报", "统计分析", "统计分析"])], "doc_id long, category string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(status.to_fetch(records, state)) == [0, 1, 4, 5] and ids(status.to_fetch(records, state, most_failures=2)) == [0, 4, 5]
    assert ids(status.to_fetch(records, state, force=True)) == list(range(7))
    assert ids(status.to_read_sheets(records, state)) == [3] and ids(status.to_read_prose(records, state)) == [6]
    assert ids(status.to_read_sheets(records, state, force=True)) == [1, 2, 3]
    path = workspace.new_path(spark, "log")
    read = status.to_read_prose(records, state)
    status.append(spark.createDataFrame(log, status.LOG), path)
    status.append(status.entries(read, state, 3, F.lit("TEXT_DONE"), F.lit("2024-01-02 00:00:00")), path)
    after = status.current(spark.read.schema(status.LOG).parquet(path))
    assert ids(status.to_read_prose(records, after)) == [] and after.where("doc_id = 6").first().attempts == 2
