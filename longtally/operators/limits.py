"""A time limit for whole statements, and the error it ends them with."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession

from .. import lexicon as lx
from .select import controlled

T = TypeVar("T")


class StatementTimeout(TimeoutError):
    """A statement did not end within its limit; its jobs were cancelled and the session is usable."""


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """What ``action`` returns, or ``StatementTimeout`` if its jobs take longer than ``seconds``.

    Jobs started by the action carry a tag of their own, and those alone are cancelled; an action whose jobs
    end in time but that is late itself, such as by planning, is an error too. Other errors are passed on.
    """
    context, tag = spark.sparkContext, f"statement-{uuid.uuid4().hex[:16]}"
    late, over = threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while True:  # jobs that start after one call are caught by the next
                context.cancelJobsWithTag(tag)
                if over.wait(0.2):
                    return

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        result = action()
    except Exception as error:  # cancelled jobs come as errors of Spark or of the JVM gateway
        if late.is_set():
            raise StatementTimeout(f"statement took longer than {seconds} s") from error
        raise
    finally:
        over.set()
        context.removeJobTag(tag)
        watcher.join()
    if late.is_set():
        raise StatementTimeout(f"statement took longer than {seconds} s")
    return result


def run_controlled(df: DataFrame, *order: Column | str, max_rows: int = lx.STATEMENT_ROWS, seconds: float = lx.STATEMENT_SECONDS) -> list:
    """The first ``max_rows`` rows in ``order`` with ``more_rows``, collected within the time limit of a statement."""
    return within(df.sparkSession, seconds, lambda: controlled(df, max_rows, *order).collect())
