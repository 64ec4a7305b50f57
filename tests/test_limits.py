"""Statements that take too long end with a named error and leave the session usable."""

import time

import pytest
from pyspark.sql import functions as F

from longtally.operators import limits


def slow(spark):
    # about a second a row, in several tasks
    return spark.range(0, 400, 1, 8).select("id", F.expr("reflect('java.lang.Thread', 'sleep', 300L)").alias("x"))


def test_a_slow_statement_ends_and_the_next_one_runs(spark):
    start = time.monotonic()
    with pytest.raises(limits.StatementTimeout):
        limits.run_controlled(slow(spark), "id", seconds=2)
    assert time.monotonic() - start < 5
    rows = limits.run_controlled(spark.range(10), "id", max_rows=3)
    assert [(r.id, r.more_rows) for r in rows] == [(0, True), (1, True), (2, True)]


def test_only_its_own_jobs_are_cancelled(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(lambda: spark.range(0, 8, 1, 4).select(F.expr("uuid()").alias("u"), F.lit(1).alias("one")).count())
        with pytest.raises(limits.StatementTimeout):
            limits.within(spark, 1, lambda: slow(spark).collect())
        assert other.result() == 8


def test_other_errors_are_passed_on(spark):
    with pytest.raises(Exception, match="no such luck"):
        limits.within(spark, 30, lambda: spark.range(1).select(F.raise_error(F.lit("no such luck"))).collect())
    assert limits.within(spark, 30, lambda: 5) == 5
