"""Every registered query against its SQL on the smallest tables, and the plans of the scale-critical ones."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
from check import normal  # noqa: E402

from specflow.catalog import load  # noqa: E402

SF = os.environ.get("SPECFLOW_TEST_SF", "/root/testdata/sf0.001")
ENTRIES = load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, db, name):
    entry = ENTRIES[name]
    got = entry.run(spark, SF).toPandas()
    if entry.sql is None:
        assert len(got)
        return
    want = db.execute(entry.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def plan(spark, name):
    frame = ENTRIES[name].run(spark, SF)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["run_summary", "route_quarantine", "error_details", "val_all", "trace_compare", "log_recent_errors", "join_range_alert", "win_cron", "dedup_rejects"])
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = ENTRIES["src_parquet"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,0.0)" in text
    assert "ReadSchema: struct<c_acctbal:double,c_mktsegment:string>" in text


def test_parse_to_route_runs_without_a_shuffle(spark):
    assert "Exchange" not in plan(spark, "route_pass")


def test_rules_read_finished_values(spark):
    """A filter on the route must not copy the rules down to the scan."""
    text = plan(spark, "route_quarantine")
    assert text.count("inline(") == 3
    assert len(text) < 60_000
