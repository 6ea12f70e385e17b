"""Every registered query against its DuckDB oracle (the driver's correctness gate, locally)."""

import pytest

import __spark_entry__ as E
from activity_engine.plans.registry import queries as library_queries
from conftest import SF_MID, SF_SMALL
from tools.compare import compare_one, duck_con

QUERIES = E.queries()
ORACLES = E.oracle_sql()
# queries whose interesting branches only appear at sf0.01 (cohort, v1 split, reports)
MID = ["cohort", "cohort_rows", "fair_share", "fair_share_v2", "report_specialty_table", "specialty_split_v1",
       "per_day_gap_v1", "dq_pivot_duplicates", "follow_up_tracking", "gap_by_year",
       *[f"report_{kind}_{table}" for kind in ("system", "trust") for table in ("chart_feed", "coverage_table", "specialty_table")]]


@pytest.fixture(scope="module")
def con_small():
    return duck_con(SF_SMALL)


@pytest.fixture(scope="module")
def con_mid():
    return duck_con(SF_MID)


def test_every_query_has_an_oracle():
    # the optional training-data queries that SQL can't express are tested with their own operators
    assert set(library_queries()) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small(spark, con_small, name):
    problems, n, *_ = compare_one(spark, con_small, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", MID)
def test_mid(spark, con_mid, name):
    problems, n, *_ = compare_one(spark, con_mid, name, QUERIES[name], ORACLES[name], SF_MID)
    assert not problems, problems
    assert n > 0
