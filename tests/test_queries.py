import pytest
from oracle_check import SF, check
from termweave.plans import oracle
from termweave.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, name):
    check(spark, QUERIES[name], oracle.SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_comparison_searches_whole_items(spark):
    items, docs = ({r.text for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()} for t in ("benchmark", "documents"))
    found = QUERIES["method_comparison_fuzzy"](spark, SF).collect()
    assert {r.test_name for r in found} == items
    assert {r.jaccard_match for r in found if r.jaccard_match} <= docs
