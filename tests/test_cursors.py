"""Cursors over several keys, and live checks against the batch check."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from longtally.operators import cursors, quality
from longtally.streaming import live

ORDER = [("a", True), ("b", False), ("at", True), ("id", False)]
SCHEMA = "a string, b double, at timestamp, id long, cursor string"


def rows_of(ids, seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice([None, *values])
    moments = [datetime.datetime(2024, 1, 1, 0, 0, 0, us) for us in (1, 2, 999_999)]
    return [(some("x", "é\"\\", ""), some(-0.5, 1e-300, float("inf"), 2.0), some(*moments), i, "old") for i in ids]


def test_a_walk_by_cursor_meets_every_row_once_while_others_come_in(spark):
    rows = rows_of(range(0, 240, 2), 1)
    whole = spark.createDataFrame(rows, SCHEMA)
    sort = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in ORDER]
    want = [r["id"] for r in whole.orderBy(*sort).collect()]
    seen, cursor, late = [], None, rows_of(range(1, 60, 2), 2)
    for turn in range(20):
        now = spark.createDataFrame(rows + late[: turn * 4], SCHEMA)
        page = cursors.page(now, ORDER, 25, cursor).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        cursor = page[-1]["cursor"]
        assert cursor == cursors.last_cursor(spark.createDataFrame(page, SCHEMA), ORDER)
    assert [i for i in seen if i % 2 == 0] == want
    assert len(seen) == len(set(seen))


def test_cursors_of_other_orders_and_empty_pages(spark):
    df = spark.createDataFrame(rows_of(range(4), 3), SCHEMA)
    cursor = cursors.last_cursor(cursors.page(df, ORDER, 2), ORDER)
    with pytest.raises(ValueError, match="of the order"):
        cursors.page(df, ORDER[::-1], 2, cursor)
    with pytest.raises(ValueError, match="not a cursor"):
        cursors.page(df, ORDER, 2, "é")
    nothing = cursors.page(df.limit(0), ORDER, 2)
    assert nothing.count() == 0 and cursors.last_cursor(nothing, ORDER) is None
    assert cursors.page(df, ORDER, 9, cursors.last_cursor(cursors.page(df, ORDER, 9), ORDER)).count() == 0


def test_live_checks_are_those_of_the_batch_check_for_each_window(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=rng.randrange(600)), rng.choice(["x", "y", None]), rng.choice([None, -1.0, 0.0, 1.0, 2.0, 3.0, 9000.0 if i % 40 == 0 else 4.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = live.file_stream(spark, f"{tmp_path}/in", df, max_files=1)
    live.keep_current(live.window_rows(stream, "ts", ["kind"], "value", "1 hour", "1 day"), f"{tmp_path}/rows", f"{tmp_path}/c").awaitTermination()
    counted = live.current(spark, f"{tmp_path}/rows", "window_start", "kind", "value")
    got = {(r["window_start"], r["check_name"], r["n"]) for r in live.window_checks(counted, "value", row_limit=30).collect()}
    want = set()
    for hour in range(10):
        low = start + datetime.timedelta(hours=hour)
        part = df.where((F.col("ts") >= low) & (F.col("ts") < low + datetime.timedelta(hours=1))).select("kind", "value")
        want |= {(low, r["check_name"], r["n"]) for r in quality.sanity_check(part, row_limit=30).collect()}
    assert {name for _, name, _ in want} >= {"duplicates", "magnitude", "many rows"}
    assert got == want
