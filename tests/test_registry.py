"""The registered queries and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from scoreweave.operators import evidence
from scoreweave.plans.registry import all_oracles, all_queries
from scoreweave.plans.views import VIEWS, Tables, needed, with_views

FOLDER = "/root/testdata/sf0.001"
NO_SQL = {"M8_fit_map"}


def test_every_query_has_sql_but_the_sampled_ones():
    queries, oracles = all_queries(), all_oracles()
    assert set(queries) <= set(entry.queries()) and set(oracles) <= set(entry.oracle_sql())
    assert set(queries) - set(oracles) == NO_SQL
    assert set(oracles) <= set(queries)


def test_views_come_before_their_users():
    order = needed("SELECT * FROM predictions")
    assert order.index("scores") < order.index("test_cells") < order.index("train") < order.index("predictions")
    assert "ranges" not in order
    assert with_views("SELECT 1") == "SELECT 1" and set(order) <= set(VIEWS)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_entry_reports_the_metrics(spark):
    row = entry.entry(spark).first()
    assert row["n_samples"] > 0 and 0 < row["mae"] <= row["rmse"] and -1 <= row["krcc"] <= 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["A2_describe_items"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    scan = next(line for line in plan.splitlines() if "lineitem" in line and "FileScan" in line)
    assert "l_tax" not in scan and "l_shipdate" not in scan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_views_after_the_split_read_written_scores(spark):
    tables = Tables(spark, FOLDER)
    before = sorted(map(tuple, tables.replies.collect()))
    assert tables.parts.count() > 0
    plan = tables.replies._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and sorted(map(tuple, tables.replies.collect())) == before


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_batches_of_incremental_results_read_written_replies(spark, monkeypatch):
    plans, real = [], evidence.apply_adjustments

    def seen(fresh, replies, ranges):
        plans.append(replies._jdf.queryExecution().executedPlan().toString())
        return real(fresh, replies, ranges)

    monkeypatch.setattr(evidence, "apply_adjustments", seen)
    all_queries()["T1_incremental_results"](spark, FOLDER)
    assert len(plans) == 3 and not any("lineitem" in p or "Window" in p for p in plans)
