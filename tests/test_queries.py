"""Registered relational queries against their SQL, and plans that must have what they are there for."""

import pytest

from marlstone import queries
from marlstone.plans.select import plan_text
from tests.oracle import differences

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_equals_sql(spark, name):
    n, ours, theirs = differences(queries.queries()[name](spark, TABLES), queries.oracle_sql()[name], TABLES)
    assert not ours and not theirs
    assert n or name in ("group_empty", "filter_gt")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_text(queries.queries()["join_filter_pushdown"](spark, TABLES))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "GreaterThan(o_totalprice,200000.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_counts_combine_before_the_shuffle(spark):
    assert "partial_count(1)" in plan_of(queries.queries()["group_count_star"](spark, TABLES))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
