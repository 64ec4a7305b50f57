"""Traces, stores and streams."""

from pyspark.sql import functions as F

from ...operators import trace as tr
from ...sources import bridge as b, keyed, status, stores
from ...sources.workspace import new_path
from ...streaming import live
from ..catalog import query


@query("latest_round_steps")
def latest_round_steps(spark, sf):
    return tr.latest_rounds(b.trace(spark, sf)).select("step_id", "session_id", "round_no", "step_type")


@query("latest_report_per_round")
def latest_report_per_round(spark, sf):
    return tr.latest_step(b.trace(spark, sf), "INTERPRET", "session_id", "round_no")


@query("round_summaries")
def round_summaries(spark, sf):
    return tr.round_summary(b.trace(spark, sf))


@query("context_of_last_rounds")
def context_of_last_rounds(spark, sf):
    return tr.context(b.trace(spark, sf))


@query("collapsed_rounds")
def collapsed_rounds(spark, sf):
    return tr.collapse_rounds(b.rounds(spark, sf))


@query("rebuilt_rounds")
def rebuilt_rounds(spark, sf):
    return tr.rebuild_round(b.trace(spark, sf))


@query("rebuilt_charts")
def rebuilt_charts(spark, sf):
    charts = tr.rebuild_charts(b.chart_trace(spark, sf))
    return charts.select("session_id", "round_no", "chart_type", "title", F.array_join("columns", ",").alias("columns"), F.size("rows").alias("n_rows"))


@query("rebuilt_chart_cells")
def rebuilt_chart_cells(spark, sf):
    return tr.chart_cells(tr.rebuild_charts(b.chart_trace(spark, sf)))


@query("rebuilt_chart_series")
def rebuilt_chart_series(spark, sf):
    cells = tr.chart_cells(tr.rebuild_charts(b.chart_trace(spark, sf))).where("number IS NOT NULL")
    rows = cells.select(F.col("session_id").cast("string").alias("session"), F.concat_ws("/", "round_no", "field").alias("item"), "number", "row")
    return rows.groupBy("session", "item").agg(F.sum("number").alias("total"), F.count("*").alias("points"))


@query("step_profile")
def step_profile(spark, sf):
    return tr.step_profile(b.trace(spark, sf))


def _record_versions(spark, sf):
    rows = b.records(spark, sf).select("record_id", "title", "category", "source_url")
    old = rows.filter(F.col("record_id") % 3 != 0).groupBy("source_url").agg(
        F.min_by("title", "record_id").alias("title"), F.min_by("category", "record_id").alias("category"))
    new = rows.filter(F.col("record_id") % 5 != 0).withColumn(
        "category", F.when(F.col("record_id") % 7 == 0, F.lit("changed")).otherwise(F.col("category")))
    return old, new


@query("upsert_outcomes")
def upsert_outcomes(spark, sf):
    old, new = _record_versions(spark, sf)
    return stores.upsert_outcomes(old, new, "source_url", ["title", "category"], F.col("record_id"))


@query("upsert_counts")
def upsert_counts(spark, sf):
    old, new = _record_versions(spark, sf)
    rows = stores.upsert_outcomes(old, new, "source_url", ["title", "category"], F.col("record_id"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("insert_ignore")
def insert_ignore(spark, sf):
    raw = b.indicator_raw(spark, sf)
    keys = ["doc_id", "sheet_name", "region"]
    return stores.insert_ignore(raw.filter("id % 3 = 0"), raw.filter("id % 3 <> 0"), keys, F.col("id")).select("id")


def _stored_versions(spark, sf):
    path = new_path(spark, "records")
    old, new = _record_versions(spark, sf)
    merge = keyed.newest("source_url", ["title", "category"], F.col("record_id"))
    for batch_id, rows in enumerate((old.withColumn("record_id", F.lit(None).cast("long")), new)):
        keyed.merge_batch(rows.select("source_url", "title", "category", "record_id"), path, batch_id, "source_url", merge, buckets=8)
    return path


@query("stored_upsert")
def stored_upsert(spark, sf):
    return keyed.current(spark, _stored_versions(spark, sf)).select("source_url", "title", "category")


@query("stored_upsert_outcomes")
def stored_upsert_outcomes(spark, sf):
    return keyed.outcomes(spark, _stored_versions(spark, sf)).select("batch", "outcome", "n")


@query("stored_insert_ignore")
def stored_insert_ignore(spark, sf):
    raw, path, keys = b.indicator_raw(spark, sf), new_path(spark, "inserted"), ["doc_id", "sheet_name", "region"]
    for batch_id, rows in enumerate((raw.filter("id % 3 = 0"), raw.filter("id % 3 <> 0"))):
        keyed.merge_batch(rows, path, batch_id, keys, keyed.ignore(keys, F.col("id")), buckets=8)
    return keyed.current(spark, path).select("id")


def _states(spark, sf):
    path = new_path(spark, "status-log")
    for rows in b.status_entries(spark, sf):
        status.append(rows, path)
    return status.current(spark.read.schema(status.LOG).parquet(path))


@query("document_states")
def document_states(spark, sf):
    return _states(spark, sf).drop("at")


@query("documents_to_fetch")
def documents_to_fetch(spark, sf):
    return status.to_fetch(b.statistics(spark, sf), _states(spark, sf), most_failures=2)


@query("sheets_to_read")
def sheets_to_read(spark, sf):
    return status.to_read_sheets(b.statistics(spark, sf), _states(spark, sf))


@query("prose_to_read")
def prose_to_read(spark, sf):
    return status.to_read_prose(b.statistics(spark, sf), _states(spark, sf))


@query("pending_documents")
def pending_documents(spark, sf):
    docs = b.indicator_docs(spark, sf).select("doc_id")
    done = b.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("doc_id"))
    return stores.pending(docs, done, "doc_id")


@query("stored_by_name")
def stored_by_name(spark, sf):
    path = new_path(spark, "analysis-result")
    rows = b.records(spark, sf).groupBy(F.col("category").alias("analysis_name"), F.col("publish_unit").alias("dim_value")).agg(
        F.count(F.lit(1)).cast("double").alias("metric_value"))
    stores.replace_by_name(rows, path)
    stores.replace_by_name(rows.filter("analysis_name = '统计信息'").withColumn("metric_value", F.col("metric_value") * 10), path)
    return spark.read.parquet(path)


@query("rebuilt_table")
def rebuilt_table(spark, sf):
    path, backup = new_path(spark, "table"), new_path(spark, "table-backup")
    rows = b.records(spark, sf).select("record_id", "category")
    rows.write.parquet(path)
    now = stores.rebuild_table(spark, rows.filter("record_id % 2 = 0"), path, backup)
    return now.withColumn("side", F.lit("now")).unionByName(spark.read.parquet(backup).withColumn("side", F.lit("backup")))


@query("csv_round_trip")
def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    rows = b.indicator_raw(spark, sf).select("id", "period", "region", "indicator_name", "value")
    stores.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("dictionary_ingest")
def dictionary_ingest(spark, sf):
    path = new_path(spark, "dictionary")
    line = F.concat_ws(
        "\t", "indicator_name", "indicator_name", F.coalesce("unit", F.lit("-")), "sheet_name", F.col("id").cast("string"),
        "period", F.when(F.col("id") % 4 != 0, F.col("period")))
    b.indicator_raw(spark, sf).select(line.alias("value")).write.text(path)
    return stores.read_dictionary(spark, path).groupBy("indicator_code", "units").agg(F.count(F.lit(1)).alias("n"))


def _events(spark, sf):
    stream = live.file_stream(spark, sf, b.table(spark, sf, "events"), files="events.parquet")
    # zone-less times are read as UTC whatever the session zone is
    here = F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts")
    return stream.withColumn("ts", here.cast("timestamp"))


def _utc(column):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz")).alias(column)


def _current(spark, stream, label, *keys):
    path, checkpoint = new_path(spark, label), new_path(spark, label + "-checkpoint")
    live.keep_current(stream, path, checkpoint).awaitTermination()
    return live.current(spark, path, *keys)


@query("stream_daily_counts")
def stream_daily_counts(spark, sf):
    counts = live.publication_counts(_events(spark, sf), "ts", "1 day", "1 day", "event_type")
    return _current(spark, counts, "daily-counts", "window_start", "event_type").select(_utc("window_start"), "event_type", "n")


@query("stream_new_documents")
def stream_new_documents(spark, sf):
    # dealt by a hash into several files, one a batch: the first document of a key often comes after a later one
    landed = new_path(spark, "landed-documents")
    rows = b.table(spark, sf, "documents").select(
        F.concat_ws("/", "lang", F.floor(F.col("doc_id") / 2)).alias("source_url"), "doc_id", "text")
    rows.repartition(6, F.col("doc_id")).write.parquet(landed)
    stream = live.file_stream(spark, landed, rows, max_files=1)
    path, checkpoint = new_path(spark, "new-documents"), new_path(spark, "new-documents-checkpoint")
    live.upsert_documents(stream, path, checkpoint, "source_url", "doc_id", buckets=8).awaitTermination()
    return keyed.current(spark, path).select("source_url", "doc_id", "text")


@query("stream_alerts")
def stream_alerts(spark, sf):
    alerts = live.sanity_alerts(_events(spark, sf), "ts", "value", 1.0, 250.0, "6 hours", "1 day")
    return _current(spark, alerts, "alerts", "window_start").select(_utc("window_start"), "n", "missing", "suspect")


@query("stream_checks")
def stream_checks(spark, sf):
    # dealt into several files, one a batch, so that most windows are fed by each of them
    landed = new_path(spark, "landed-events")
    events = b.table(spark, sf, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").cast("string").alias("at"))
    events.repartition(6, F.col("event_id")).write.parquet(landed)
    stream = live.file_stream(spark, landed, events, max_files=1)
    here = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("at").cast("timestamp_ntz"))
    rows = live.window_rows(stream.withColumn("ts", here.cast("timestamp")), "ts", ["event_type"], "value", "6 hours", "60 days")
    path, checkpoint = new_path(spark, "window-rows"), new_path(spark, "window-rows-checkpoint")
    live.keep_current(rows, path, checkpoint).awaitTermination()
    found = live.window_checks(live.current(spark, path, "window_start", "event_type", "value"), "value")
    return found.select(_utc("window_start"), "check_name", "n")


@query("stream_collapsed_rounds")
def stream_collapsed_rounds(spark, sf):
    # turns of a session are dealt over the batches, so most batches bring late ones
    turns = new_path(spark, "turns")
    rows = b.rounds(spark, sf)
    rows.repartition(10, F.col("session_id") + F.col("seq") * 7).write.parquet(turns)
    stream = live.file_stream(spark, turns, rows, max_files=1)
    rounds = new_path(spark, "rounds")
    live.live_round_collapse(stream, rounds, new_path(spark, "rounds-checkpoint"), buckets=8).awaitTermination()
    return keyed.current(spark, rounds)
