import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from weftline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry_lists_the_catalog():
    assert set(QUERIES) <= set(entry.queries())


# Queries that other packages add are tested with them.
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name in SQL:
        assert compare(spark, con, SF, fn, SQL[name]) is None
    else:
        assert fn(spark, SF).count() > 0


def test_no_cross_or_nested_loop_joins(spark):
    for name in ("vocab_encode_join", "corpus_bleu", "interleave_turns", "latency_stats", "catalogue_top1"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
