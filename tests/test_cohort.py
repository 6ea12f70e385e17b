"""Threshold edges of the cohort rule (D21), on literal rows."""

from activity_engine.operators.fairshare import cohort, cohort_flags, cohort_rows
from activity_engine.params import Params

COLS = ("month_name_short string, fin_month int, icb string, provider string, treatment_function_code string, "
        "treatment_function string, speciality_activity double, total_activity double, baseline double, "
        "target double, variance double, proportion_of_total double")
MONTHS = ["Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Jan", "Feb", "Mar"]


def rows(provider, tfc, n_months, spec, total, icb="I"):
    return [(MONTHS[i], i + 1, icb, provider, tfc, tfc, spec, total, 10.0, 7.5, 1.0, spec / total) for i in range(n_months)]


def test_tally_must_exceed_eight(spark):
    data = rows("P", "100", 8, 50.0, 100.0) + rows("Q", "100", 9, 50.0, 100.0)
    got = {r.provider for r in cohort(spark.createDataFrame(data, COLS), Params()).collect()}
    assert got == {"Q"}


def test_share_exactly_one_percent_is_in(spark):
    # provider total = 12 * 1000; TFC 100 has 120 = exactly 1 %, TFC 110 slightly less
    data = rows("P", "100", 12, 10.0, 1000.0) + rows("P", "110", 12, 9.99, 1000.0)
    got = {r.treatment_function_code for r in cohort(spark.createDataFrame(data, COLS), Params()).collect()}
    assert got == {"100"}


def test_average_branch(spark):
    # share far below 1 %, but 2000 a month on average
    data = rows("P", "100", 12, 2000.0, 1e9) + rows("P", "110", 12, 1999.0, 1e9)
    got = {r.treatment_function_code for r in cohort(spark.createDataFrame(data, COLS), Params()).collect()}
    assert got == {"100"}


def test_tally_counts_rows_not_months(spark):
    # one provider name under two systems: 6 months each -> 12 rows -> passes
    data = rows(None, "100", 6, 50.0, 100.0, icb="A") + rows(None, "100", 6, 50.0, 100.0, icb="B")
    got = cohort(spark.createDataFrame(data, COLS), Params()).collect()
    assert {r.icb for r in got} == {"A", "B"} and all(r.month_tally == 12 for r in got)


def test_cohort_shares_sum_to_one_and_reductions_to_variance(spark):
    data = rows("P", "100", 12, 60.0, 100.0) + rows("P", "110", 12, 40.0, 100.0)
    df = spark.createDataFrame(data, COLS)
    cr = cohort_rows(cohort_flags(df, Params())).groupBy("month_name_short").agg(
        {"cohort_proportion": "sum", "monthly_reduction": "sum"}
    ).collect()
    for r in cr:
        assert abs(r["sum(cohort_proportion)"] - 1.0) < 1e-12
        assert abs(r["sum(monthly_reduction)"] - 1.0) < 1e-12
