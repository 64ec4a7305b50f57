"""Plan checks: what must and must not appear in the physical plans."""

import pytest

from longtally.plans import catalog

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


QUIET = [n for n in sorted(catalog.load()) if not n.startswith("stream_")]


@pytest.mark.parametrize("name", QUIET)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(catalog.load()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "BatchEvalPython"):
        assert word not in plan, word


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalog.load()["sales_trend_by_date"](spark, SF))
    assert "o_orderpriority" not in plan and "o_custkey" not in plan
    plan = plan_of(catalog.load()["classify_questions"](spark, SF))
    assert "EqualTo(role,user)" in plan


def test_no_pattern_runs_on_kept_rows(spark):
    from longtally.plans import rebuild

    plan = plan_of(rebuild.kept(spark, SF))
    for word in ("RLIKE", "regexp_extract", "regexp_replace"):
        assert word not in plan.split("SortAggregate")[0], word


def test_granularity_guard_reads_written_rows_and_parses_labels(spark):
    df = catalog.load()["granularity_guard"](spark, SF)
    plan = plan_of(df)
    assert "orders.parquet" not in plan and "customer.parquet" not in plan
    assert not [line for line in plan.splitlines() if "RLIKE" in line and "FileScan" in line]
    logical = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [i for i, line in enumerate(logical) if "Aggregate [period" in line]
    assert below and not any("RLIKE" in line for i in below for line in logical[i:i + 4])


def test_keep_first_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(catalog.load()["first_seen_with_value"](spark, SF))
