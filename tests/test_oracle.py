"""Every registered query against its SQL, on whole tables."""

import pytest

from oracle import compare, duck
from tallyrow.catalog import REGISTRY


MODELS = {"train_baseline", "score"}
FORBIDDEN = ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin")


def check_plan(df):
    """No Python, no cross join, and nothing but aggregates passes through one partition."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    for node in FORBIDDEN:
        assert not any(node in line for line in lines), node
    for above, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in above:
            assert "Scan" not in below and "Generate" not in below and "Filter" not in below, below


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, connection, sf_dir, name):
    assert compare(spark, connection, name, sf_dir, None if name in MODELS else check_plan) is None


def test_entry_has_the_three_functions(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
