"""Every registered query against its SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as contract
from check import compare, connect
from storyspark import session

ORACLE = contract.oracle_sql()
QUERIES = {name: query for name, query in contract.queries().items() if name in contract.catalog.REGISTRY}


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


#: Approximate results; tests of their own hold them against the exact ones.
WITHOUT_SQL = {"stream_slo_p95"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


#: Python runs nowhere; window functions of Spark's own streams apart, streams run the same operators batch by batch.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "InPandas", "MapInArrow")


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_and_its_jobs_stay_native_without_cross_join(spark, sf_dir, db, name, monkeypatch):
    """The rows, and the plans of the result and of every table that was staged on the way to it."""
    plans = {}
    monkeypatch.setattr(session, "on_stage", lambda stage_name, df: plans.setdefault(f"{stage_name} {len(plans)}", plan_of(df)))
    result = QUERIES[name](spark, sf_dir)
    plans["result"] = plan_of(result)
    assert [(at, word) for at, plan in plans.items() for word in UNWANTED if word in plan] == []
    if name in WITHOUT_SQL:
        assert result.count() > 0
    else:
        ok, note = compare(result, db, ORACLE[name])
        assert ok, note


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 20 and rows[0].score >= rows[-1].score


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = plan_of(QUERIES["feedback_log"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    plan = plan_of(QUERIES["score_upsert"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-20T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
