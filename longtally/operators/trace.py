"""Analysis traces: latest rounds, context, collapsed rounds, latency.

Input rows are steps (session_id, round_no, step_type, payload, status,
duration_ms, created_at, step_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions.text import squash_ascii
from .runs import running_groups


def latest_rounds(steps: DataFrame) -> DataFrame:
    """Steps of each session's last round."""
    last = steps.groupBy("session_id").agg(F.max("round_no").alias("round_no"))
    return steps.join(last, ["session_id", "round_no"], "left_semi")


def latest_step(steps: DataFrame, step_type: str, *keys: str) -> DataFrame:
    """Last step of a type per key."""
    rows = steps.filter(F.col("step_type") == step_type)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("payload", "status"), F.struct("created_at", "step_id")).alias("s")).select(*keys, "s.*")


def round_summary(steps: DataFrame) -> DataFrame:
    """Question and conclusion per round, from the first question and last interpretation."""
    place = F.struct("created_at", "step_id")
    is_type = lambda t: F.when(F.col("step_type") == t, place)
    return steps.groupBy("session_id", "round_no").agg(
        F.get_json_object(F.min_by("payload", is_type("QUESTION")), "$.text").alias("question"),
        F.get_json_object(F.max_by("payload", is_type("INTERPRET")), "$.interpretation.text").alias("conclusion"),
    )


def context(steps: DataFrame, k: int = 3) -> DataFrame:
    """The k rounds before the current one, oldest first, as one text per session.

    Only k + 1 rounds per session pass the rank filter, so the collected list is
    bounded by k.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("round_no"))
    ranked = round_summary(steps).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r").between(1, k + 1))
    line = F.concat(F.lit("Q:"), F.coalesce("question", F.lit("")), F.lit(" A:"), F.coalesce("conclusion", F.lit("")))
    earlier = ranked.filter("_r > 1").groupBy("session_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("round_no", line.alias("line")))), lambda x: x["line"]).alias("lines")
    )
    return earlier.select("session_id", F.array_join("lines", "\n").alias("context"))


def collapse_rounds(questions: DataFrame, bucket_size: int = 4096) -> DataFrame:
    """Consecutive equal questions of a session share a round; its last row is kept.

    Input (session_id, seq, question). Texts are compared after white-space
    squashing. Long sessions are numbered in buckets of ``bucket_size`` turns.
    """
    rows = questions.withColumn("norm", squash_ascii(F.col("question"))).select("session_id", "seq", "norm")
    numbered = running_groups(
        rows, ["session_id"], [F.col("seq")], F.floor(F.col("seq") / bucket_size),
        lambda previous: F.col("norm") != previous["norm"],
    )
    return numbered.groupBy("session_id", F.col("run").alias("round_no")).agg(
        F.max("seq").alias("seq"), F.max_by("norm", "seq").alias("question"), F.count(F.lit(1)).alias("asked")
    )


def rebuild_round(steps: DataFrame) -> DataFrame:
    """Latest round per session as one row: question, plan, SQL, execution, interpretation."""
    rows = latest_rounds(steps)
    place = F.struct("created_at", "step_id")
    last = lambda t: F.max_by("payload", F.when(F.col("step_type") == t, place))
    text = lambda t: F.get_json_object(last(t), "$.text")
    return rows.groupBy("session_id", "round_no").agg(
        text("QUESTION").alias("question"), text("PLAN").alias("plan"), text("SQL").alias("sql"),
        text("EXECUTE").alias("execution"),
        F.get_json_object(last("INTERPRET"), "$.interpretation.text").alias("interpretation"),
    )


def rebuild_charts(steps: DataFrame) -> DataFrame:
    """Chart of every round that has a result: (session_id, round_no, chart_type, title, columns, rows).

    Type and title come from the round's last readable plan (a table without one), columns and rows from its last
    readable result; a round whose result has no columns gives no chart. ``rows`` is an array of VARIANT, as rows
    need not have the same fields; it is empty where the result has none.
    """
    place = F.struct("created_at", "step_id")
    readable = F.try_parse_json("payload").isNotNull()
    last = lambda t: F.try_parse_json(F.max_by("payload", F.when((F.col("step_type") == t) & readable, place)))
    found = steps.where(F.col("step_type").isin("PLAN", "EXECUTE")).groupBy("session_id", "round_no").agg(
        last("PLAN").alias("plan"), last("EXECUTE").alias("result")
    )
    of = lambda v, path, kind: F.try_variant_get(v, path, kind)
    metrics = of("plan", "$.metrics", "array<string>")
    told = F.when(F.size(metrics) > 0, F.concat(F.lit("「"), F.array_join(metrics, "、"), F.lit("」"))).otherwise("")
    charts = found.select(
        "session_id", "round_no", F.coalesce(of("plan", "$.chartType", "string"), F.lit("table")).alias("chart_type"),
        F.concat(F.coalesce(of("plan", "$.targetTable", "string"), F.lit("")), told).alias("title"),
        of("result", "$.columns", "array<string>").alias("columns"),
        F.coalesce(of("result", "$.rows", "array<variant>"), F.array().cast("array<variant>")).alias("rows"),
    )
    return charts.where(F.col("columns").isNotNull())


def chart_cells(charts: DataFrame, max_rows: int = lx.STATEMENT_ROWS) -> DataFrame:
    """Cells of rebuilt charts as long rows (session_id, round_no, row, field, text, number), of the first ``max_rows`` rows each.

    A number stands in ``number``, anything else in ``text``. Fields that are null, or that a row does not have, give no cell.
    """
    rows = charts.select("session_id", "round_no", F.posexplode("rows").alias("row", "value")).where(F.col("row") < max_rows)
    cells = rows.select("session_id", "round_no", "row", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("field", "value"))
    numeric = F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    cells = cells.select(
        "session_id", "round_no", "row", "field", F.when(~numeric, F.try_variant_get("value", "$", "string")).alias("text"),
        F.when(numeric, F.try_variant_get("value", "$", "double")).alias("number"),
    )
    return cells.where(F.col("text").isNotNull() | F.col("number").isNotNull())


def step_profile(steps: DataFrame) -> DataFrame:
    """Steps, failures and latency per step type."""
    failed = F.count(F.when(F.col("status") == "FAILED", 1))
    return steps.groupBy("step_type").agg(
        F.count(F.lit(1)).alias("n"), failed.alias("failed"),
        F.round(F.sum("duration_ms") / F.count("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
    )
