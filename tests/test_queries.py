"""Every query against its oracle on the smallest tables."""

import pytest

import oracle
from evidra.plans import queries as plans
from evidra.plans import artefacts, briefs, evaluation, oracles, postings, results  # noqa: F401  register their queries, and those of retrieval

SF = "/root/testdata/sf0.001"
NONE_HERE = {"evidence_expansion", "variant_expansion", "numeric_anchor_rescue"}  # the smallest tables hold no case; fixtures do


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_oracle(spark, name):
    assert oracle.actual(plans.QUERIES[name](spark, SF)) == oracle.expected(SF, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLE.keys()))
def test_query_runs(spark, name):
    rows = plans.QUERIES[name](spark, SF).count()
    assert rows > 0 or name in NONE_HERE


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
