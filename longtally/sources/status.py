"""Stages of document processing that can be resumed, driven by an append-only status log.

An entry (doc_id, stage, status, at, attempt) says how an attempt ended. The state of a document is what its
entries fold to; a stage takes the documents whose state it may start from, so a job that is run again goes on
where the last one stopped. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.merge import keep_first

#: Statuses, what may follow each, and those from which the first stage does not start again.
FOLLOWS = {
    "PENDING": ("DONE", "TEXT_DONE", "FAILED"),
    "FAILED": ("DONE", "TEXT_DONE", "FAILED"),
    "DONE": ("TEXT_DONE", "XLSX_DONE", "XLSX_FAIL"),
    "TEXT_DONE": (),
    "XLSX_DONE": (),
    "XLSX_FAIL": (),
}
FETCHED = ("DONE", "TEXT_DONE", "XLSX_DONE", "XLSX_FAIL")
REPORT, BULLETIN, ANALYSIS = "统计月报", "统计公报", "统计分析"
LOG = "doc_id long, stage int, status string, at timestamp, attempt int"


def may_follow(before: Column, after: Column) -> Column:
    """Whether an entry changes a document's state: no state counts as PENDING."""
    allowed = F.lit(False)
    for status, nexts in FOLLOWS.items():
        if nexts:
            allowed = allowed | ((F.coalesce(before, F.lit("PENDING")) == status) & after.isin(*nexts))
    return allowed


def current(log: DataFrame) -> DataFrame:
    """(doc_id, status, attempts, failures, at): the state that each document's log folds to.

    Entries count in order of time, stage and attempt; those that may not follow the state before them, such as one
    of a slower copy of a job, are passed over. An entry that was appended twice counts once. A document's log is
    short: its length is bounded by the attempts a stage allows.
    """
    entry = F.struct("at", "stage", "attempt", "status")
    steps = log.where("doc_id IS NOT NULL AND at IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set(entry)).alias("steps"))
    start = F.struct(
        F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("failures"), F.lit(None).cast("timestamp").alias("at")
    )

    def step(state: Column, e: Column) -> Column:
        failed = e["status"].isin("FAILED", "XLSX_FAIL")
        return F.when(may_follow(state["status"], e["status"]), F.struct(
            e["status"].alias("status"), (state["attempts"] + 1).alias("attempts"),
            (state["failures"] + failed.cast("int")).alias("failures"), e["at"].alias("at"),
        )).otherwise(state)

    return steps.select("doc_id", F.aggregate("steps", start, step).alias("s")).select("doc_id", "s.*")


def to_fetch(records: DataFrame, state: DataFrame, most_failures: int | None = None, force: bool = False) -> DataFrame:
    """Stage 1: records that were not fetched yet, failed ones again, up to a number of failures if one is given."""
    done = F.col("status").isin(*FETCHED)
    if most_failures is not None:
        done = done | (F.col("failures") >= most_failures)
    return records if force else records.join(state.where(done).select("doc_id"), "doc_id", "left_anti")


def to_read_sheets(records: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Stage 2: fetched monthly reports whose workbook was not read yet."""
    return _from_done(records, state, [REPORT], force)


def to_read_prose(records: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Stage 3: fetched bulletins and analyses whose text was not read yet."""
    return _from_done(records, state, [BULLETIN, ANALYSIS], force)


def _from_done(records: DataFrame, state: DataFrame, categories: list[str], force: bool) -> DataFrame:
    own = records.where(F.col("category").isin(categories))
    return own.join((state if force else state.where("status = 'DONE'")).select("doc_id"), "doc_id", "left_semi")


def fetched_status(category: Column, attachment: Column) -> Column:
    """Status after fetching: a monthly report without workbook has only its text to give, and that is done."""
    return F.when(attachment.isNotNull() | (category != REPORT) | category.isNull(), "DONE").otherwise("TEXT_DONE")


def entries(docs: DataFrame, state: DataFrame, stage: int, status: Column, at: Column) -> DataFrame:
    """Log entries for the documents a stage has worked on, with the number of the attempt; latest ones last."""
    tried = state.select(F.col("doc_id").alias("_of"), "attempts")
    rows = keep_first(docs, ["doc_id"], F.col("doc_id")).join(tried, F.col("doc_id") == F.col("_of"), "left")
    return rows.select(
        "doc_id", F.lit(stage).alias("stage"), status.alias("status"), at.cast("timestamp").alias("at"),
        (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt"),
    )


def append(rows: DataFrame, path: str) -> None:
    """Adds entries to the log; a job that is lost before its end adds none."""
    rows.write.mode("append").parquet(path)
