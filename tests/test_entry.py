import os

import __spark_entry__ as E
from activity_engine.params import test_params as make_params
from activity_engine.plans.run import run_reports
from activity_engine.sources.testmap import load_tables
from conftest import SF_SMALL


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["icb", "provider", "baseline", "actual", "target", "variance", "percent_vs_actual", "variance_per_wd"]
    assert df.count() >= 0


def test_report_run_writes_every_output(spark, tmpdir_path):
    p = make_params()
    written = run_reports(spark, load_tables(spark, SF_SMALL, p), p, tmpdir_path)
    assert {"gap_by_year", "fair_share", "systems", "trusts", "baseline_and_goal"} <= set(written)
    systems = os.listdir(written["systems"])
    assert any(d.startswith("report=") for d in systems)
    assert spark.read.parquet(written["gap_by_year"]).count() > 0
    for table in ("chart_feed", "coverage_table", "specialty_table"):
        assert {f"systems_{table}", f"trusts_{table}"} <= set(written)
    chart = spark.read.parquet(written["systems_chart_feed"])
    assert chart.where("report = 'all_regions'").count() == spark.read.parquet(written["report_chart_feed"]).count() > 0
    assert {"report", "title"} <= set(spark.read.parquet(written["report_scope"]).columns)


def test_report_run_cli_with_prepared_fact(spark, tmpdir_path, capsys):
    from activity_engine.plans.run import main

    out = os.path.join(tmpdir_path, "out")
    prep = os.path.join(tmpdir_path, "prepared")
    main(["--sf-dir", SF_SMALL, "--out", out, "--prepare", prep])
    printed = capsys.readouterr().out
    assert "gap_by_year\t" in printed and "trusts\t" in printed
    assert any(d.startswith("der_financial_year=") for d in os.listdir(os.path.join(prep, "attendance")))
    assert spark.read.parquet(os.path.join(out, "fair_share")).columns[:3] == ["icb", "provider", "treatment_function"]
