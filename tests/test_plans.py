"""Plan shape: pushdown into the scan, no Python in the plan, no accidental cartesian joins."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extract_pushes_filters_and_prunes_columns(spark):
    df = QUERIES["extract_activity"](spark, SF_SMALL)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = [l for l in plan.split("\n") if l.startswith("PushedFilters")]
    lines = next(l for l in pushed if "l_shipdate" in l)
    assert "GreaterThanOrEqual(l_shipdate,1999-04-01" in lines and "LessThan(l_shipdate,2000-04-01" in lines
    assert "In(l_returnflag, [A,R])" in lines
    assert any("In(o_orderstatus, [F,O])" in l and "Not(EqualTo(o_orderpriority,5-LOW))" in l for l in pushed)
    # only the needed lineitem columns are read
    li = [l for l in plan.split("\n") if l.startswith("ReadSchema: struct<l_orderkey")]
    assert li and all("l_extendedprice" not in l and "l_quantity" not in l for l in li)
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize(
    "name",
    ["extract_activity_3y", "extract_baseline_excl_march", "extract_march_history", "planning_baseline",
     "hrg_series_baseline", "follow_up_tracking", "activity_comparison"],
)
def test_every_fact_scan_of_an_extract_has_its_dates(spark, name):
    plan = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, SF_SMALL)._jdf.queryExecution(), "formatted")
    scans = [l for l in plan.split("\n") if l.startswith("PushedFilters") and "IsNotNull(l_orderkey)" in l]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in l and "LessThan(l_shipdate" in l for l in scans)


@pytest.mark.parametrize("name", ["gap_by_year", "fair_share", "follow_up_tracking", "per_day_gap_v1"])
def test_lookups_and_derived_tables_are_not_broadcast_by_hint(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        sides = [l for l in plan.split("\n") if "Join" in l and "rightHint=(strategy=broadcast)" in l]
        # calendar and working-day tables, the one-row scalars and the test mapping's own 25 rows only
        assert all("working_days" in l or "month_name_short" in l or "h_date" in l or "regionkey" in l or "nationkey" in l
                   or "Cross" in l or "month_commencing" in l for l in sides), sides
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["calendar", "monthly_working_days", "holiday_events", "target_year_scalars"])
def test_calendar_queries_read_the_dates_of_the_fact(spark, name):
    assert "l_shipdate" in executed(QUERIES[name](spark, SF_SMALL))


def test_a_month_without_a_pivot_column_fails(spark):
    from activity_engine.operators.gap import months_wide

    good = spark.createDataFrame([("a", "Apr", 1.0)], "k string, month_name_short string, v double")
    assert months_wide(good, ["k"], "v").first()["Apr"] == 1.0
    bad = spark.createDataFrame([("a", None, 1.0)], "k string, month_name_short string, v double")
    with pytest.raises(Exception, match="without a pivot column"):
        months_wide(bad, ["k"], "v").collect()


@pytest.mark.parametrize("name", ["gap_by_year", "fair_share", "follow_up_tracking", "report_specialty_table", "scalar_text"])
def test_no_python_and_no_cartesian(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = executed(df)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "FlatMapGroupsInPandas"):
        assert bad not in plan, (name, bad)
    # nested-loop joins only as the cross join with the one-row scalar aggregate
    bnlj = [l for l in plan.split("\n") if "BroadcastNestedLoopJoin" in l]
    assert all("BuildRight, Cross" in l for l in bnlj), bnlj


def test_month_pivot_has_explicit_values(spark):
    df = QUERIES["gap_per_day_wide"](spark, SF_SMALL)
    assert df.columns == ["icb", "provider", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Jan", "Feb", "Mar"]


def test_prepared_fact_prunes_partitions_and_gives_the_same_extract(spark, tmpdir_path):
    from activity_engine.operators.extract import extract_activity
    from activity_engine.params import test_params as make_params
    from activity_engine.sources.testmap import load_tables, prepare_fact

    p = make_params()
    prepare_fact(spark, SF_SMALL, tmpdir_path, p)
    prepared = load_tables(spark, SF_SMALL, p, prepared=tmpdir_path)
    derived = load_tables(spark, SF_SMALL, p)
    a = extract_activity(prepared, p)
    b = extract_activity(derived, p)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = spark._jvm.PythonSQLUtils.explainString(a._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(der_financial_year" in plan and "1999/00" in plan


def test_fact_aggregates_are_pre_aggregated_before_the_shuffle(spark):
    # a provider holding a third of all rows ships one partial row per task and key, not its rows
    for name in ("extract_activity", "follow_up_tracking"):
        df = QUERIES[name](spark, SF_SMALL)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        partial = [l for l in plan.split("\n") if l.startswith("Functions [1]: [partial_count(")]
        assert partial, name
