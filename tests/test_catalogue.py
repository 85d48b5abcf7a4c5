"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue
from tessera.sources.scratch import Scratch

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def rows(df):
    plain = lambda v: round(v, 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr([None if v != v else plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    if name not in entry.oracle_sql():
        pytest.skip("no SQL")
    ours, theirs = entry.queries()[name](spark, DIR).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["busy_components", "graph_after_deletion", "import_chains", "orphan_files", "circular_imports", "graph_totals", "most_called_functions", "graph_sql", "import_hops"])
def test_plan_of_a_question_holds_no_extraction(spark, name):
    # a cached graph puts all that builds it into the plan, at every place that reads it
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and len(plan) < 100_000


@pytest.mark.parametrize("name", ["busy_components", "graph_after_deletion", "import_chains", "orphan_files", "circular_imports", "graph_totals", "most_called_functions", "graph_sql", "import_hops"])
def test_no_join_is_left_to_be_broadcast(spark, monkeypatch, name):
    # of a large graph, too, the stored tables are small as files, and Spark would send them through the driver
    plans, save = [], Scratch.save
    noted = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(Scratch, "save", lambda self, df, to: (noted(df), save(self, df, to))[1])
    noted(entry.queries()[name](spark, DIR))
    joins = [line for plan in plans for line in plan.splitlines() if " Join " in line or line.startswith("Join ")]
    assert joins and [line for line in joins if "strategy=" not in line] == []
