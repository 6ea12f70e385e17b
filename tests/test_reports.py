"""Report tables on literal rows."""

from __future__ import annotations

from activity_engine.operators.reports import specialty_table


def test_rows_that_share_a_description_stay_apart(spark):
    rows = [("Kent", "P", None, 10.0, 10.0, 1.0, 1.0), ("Kent", "P", None, 20.0, 30.0, 1.0, 1.0)]
    fair = spark.createDataFrame(
        rows,
        "icb string, provider string, treatment_function string, avg_monthly_activity double, "
        "share_of_monthly_variance double, avg_activity_per_wd double, share_of_daily_variance double",
    )
    got = specialty_table(fair).collect()
    assert sorted((r.row_kind, r.treatment_function, r.average_monthly_activity, r.proportion_text) for r in got if r.row_kind == "row") == [
        ("row", None, 10.0, "25.0%"),
        ("row", None, 20.0, "75.0%"),
    ]
    assert [(r.treatment_function, r.share_of_monthly_reduction, r.proportion_text) for r in got if r.row_kind == "total"] == [
        ("Total", 40.0, "100.0%")
    ]
