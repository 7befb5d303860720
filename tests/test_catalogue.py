import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def values(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in cols]
    assert len(found.description) == len(cols)
    assert values(tuple(r[c] for c in cols) for r in df.collect()) == values(tuple(r[i] for i in at) for r in found.fetchall())


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).collect()) == 1


def test_every_operator_has_a_query_and_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 55
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_plans_push_down_and_prune(spark, data):
    plan = QUERIES["filter_eq_scalar"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
    plan = QUERIES["heatmap_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    plan = QUERIES["top_k"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_single_key_join_over_all_customers(spark, duck, data):
    found = QUERIES["join_single_key"](spark, data)
    want = duck.execute("select count(*), count(distinct c_custkey) from customer join supplier on c_nationkey = s_nationkey").fetchone()
    assert (found.count(), found.select("c_custkey").distinct().count()) == want


def test_a_single_key_join_is_dealt_over_many_tasks(spark, duck, data, monkeypatch):
    monkeypatch.setattr(catalogue.relational, "TASK_ROWS", 2, raising=False)
    found = QUERIES["join_single_key"](spark, data)
    want = duck.execute("select c_nationkey, c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert len(found.groupBy(F.spark_partition_id()).count().collect()) > 8
