"""Extracts made together, the fact's laid-out copy, and date spans kept by file."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from activity_engine.operators import extract as ex
from activity_engine.params import test_params as make_params
from activity_engine.plans.pipeline import Pipeline
from activity_engine.plans.registry import pipeline, queries
from activity_engine.session import ENGINE_CONF, configure
from activity_engine.sources import testmap
from activity_engine.sources.layout import DateSpans, PreparedFact, state_of
from activity_engine.sources.testmap import SCHEMAS, load_tables, prepare_fact
from conftest import SF_SMALL

QUERIES = queries()


def formatted(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def fact_scans(spark, df) -> int:
    """Scans of lineitem that run: a reused exchange's own scan isn't printed again."""
    plan = formatted(spark, df)
    return sum("l_shipdate" in x for x in plan.split("\n") if x.startswith("ReadSchema"))


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def static_plans(spark, monkeypatch):
    """The planned tree with its reused exchanges, which an adaptive plan finds only as it runs."""
    monkeypatch.setitem(ENGINE_CONF, "spark.sql.adaptive.enabled", "false")
    configure(spark)
    yield
    monkeypatch.undo()
    configure(spark)


def test_the_older_method_scans_the_fact_once(spark, static_plans):
    pl = pipeline(spark, SF_SMALL)
    assert fact_scans(spark, pl.per_day_gap_v1) == 1
    assert fact_scans(spark, pl.extracts_together) == 1


def test_extracts_together_are_the_extracts(spark):
    p = make_params()
    t = load_tables(spark, SF_SMALL, p)
    together = ex.extract_together(t, p, ex.extract_scopes(p))
    alone = {
        "actual": ex.extract_activity(t, p),
        "three_years": ex.extract_activity_3y(t, p),
        "excl_march": ex.extract_baseline_excl_march(t, p),
        "history": ex.extract_march_history(t, p),
    }
    for scope, df in alone.items():
        assert sorted(map(repr, ex.one_scope(together, scope).collect())) == sorted(map(repr, df.collect())), scope
    none = ex.extract_together(t, p, {"later": ex.ExtractScope(("2030/31",))})
    assert none.count() == 0


def test_the_prepared_cost_join_has_no_exchange(spark, tmp_path, no_broadcast, static_plans):
    p = make_params()
    prepare_fact(spark, SF_SMALL, str(tmp_path), p, buckets=4)
    t = load_tables(spark, SF_SMALL, p, prepared=str(tmp_path))
    plan = ex.follow_up_tracking(t, p)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    depth = lambda x: re.search(r"[A-Za-z]", x.replace("*(", "")).start()
    at = next(k for k, x in enumerate(lines) if "SortMergeJoin" in x and "_c_ident" in x)
    below = [x for x in lines[at + 1 :]]
    sides = []
    for x in below:
        if depth(x) <= depth(lines[at]):
            break
        sides.append(x)
    assert sides and not any("Exchange" in x for x in sides)
    assert sum("Bucketed: true" in x for x in sides) == 2
    derived = ex.follow_up_tracking(load_tables(spark, SF_SMALL, p), p)
    assert sorted(map(repr, ex.follow_up_tracking(t, p).collect())) == sorted(map(repr, derived.collect()))


def test_a_session_that_did_not_write_the_layout_names_its_buckets(spark, tmp_path):
    p = make_params()
    prepare_fact(spark, SF_SMALL, str(tmp_path), p, buckets=3)
    fact = PreparedFact(spark, str(tmp_path), 8)
    before = fact.table("attendance_cost").count()
    spark.sql(f"DROP TABLE {fact._name('attendance_cost')}")
    again = PreparedFact(spark, str(tmp_path), 8).table("attendance_cost")
    assert again.count() == before > 0
    assert "SelectedBucketsCount: 3 out of 3" in formatted(spark, again.groupBy("opa_ident", "year_key").count())


def test_the_layout_is_the_derived_fact_with_a_bucket_for_each_part_of_the_lines(spark, tmp_path, monkeypatch):
    """The fact is joined and dealt once, narrow; buckets, each one task's, grow with the lines; the rows are the derived ones."""
    folder, out = str(tmp_path / "tables"), str(tmp_path / "out")
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    odd = lines.limit(40)
    for c in ("l_shipdate", "l_returnflag", "l_discount", "l_tax", "l_linenumber"):
        odd = odd.withColumn(c, F.when(F.col("l_orderkey") % 3 > 0, F.col(c)))
    _with_lines(spark, folder, lines.unionByName(odd).unionByName(lines.limit(9)).repartition(2))
    stored = sum(r.length for r in testmap.files_of(spark, f"{folder}/lineitem.parquet").collect())
    monkeypatch.setattr(testmap, "BUCKET_BYTES", -(-stored // 11))
    p = make_params()
    prepare_fact(spark, folder, out, p)
    derived, t = load_tables(spark, folder, p), load_tables(spark, folder, p, prepared=out)
    assert "SelectedBucketsCount: 11 out of 11" in formatted(spark, t.attendance_cost.groupBy("opa_ident", "year_key").count())
    for name in PreparedFact.TABLES:
        want, got = getattr(derived, name), getattr(t, name)
        assert got.where("not (year_key <=> der_financial_year)").count() == 0
        got = got.select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name
        assert dict(got.dtypes) == dict(want.dtypes)


def test_the_cost_table_is_made_of_the_attendance_rows(spark, tmp_path, no_broadcast, static_plans):
    p = make_params()
    prepare_fact(spark, SF_SMALL, str(tmp_path), p, buckets=4)
    plan = testmap._cost_of(PreparedFact(spark, str(tmp_path), 4).table("attendance"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Bucketed: true" in plan
    # what travels to the buckets: no text but the provider's code
    dealt = formatted(spark, testmap._dealt_attendance(testmap._Raw(spark, SF_SMALL), 4))
    assert dealt.count("REPARTITION_BY_NUM") >= 1 and dealt.count("l_returnflag") > 0


def test_an_unfinished_layout_is_not_taken(spark, tmp_path):
    fact = PreparedFact(spark, str(tmp_path / "x"), 2)
    assert not fact.complete
    cost = spark.createDataFrame([(1, "2000/01", "WF")], "opa_ident long, der_financial_year string, hrg_code_other string")
    broken = cost.select("opa_ident", F.raise_error(F.lit("lost")).cast("string").alias("der_financial_year"))
    with pytest.raises(Exception, match="lost"):
        fact.write(attendance=cost, attendance_cost=broken)
    assert not fact.complete
    assert fact.write(attendance=cost, attendance_cost=cost).complete


def test_a_lookup_of_years_prunes_partitions_at_run_time(spark, tmp_path, static_plans):
    p = make_params()
    prepare_fact(spark, SF_SMALL, str(tmp_path), p, buckets=2)
    t = load_tables(spark, SF_SMALL, p, prepared=str(tmp_path))
    years = spark.createDataFrame([("one", "1999/00"), ("other", "1996/97")], "scope string, scope_year string")
    df = ex.attendances_by_scope(t, years, ["one"])
    plan = formatted(spark, df)
    filters = next(x for x in plan.split("\n") if "PartitionFilters" in x and "der_financial_year" in x)
    assert "dynamicpruning" in filters
    assert {r.der_financial_year for r in df.collect()} == {"1999/00"}


@pytest.mark.parametrize("name", ["gap_by_year", "fair_share", "report_specialty_table", "activity_comparison"])
def test_no_plan_scans_the_dates_for_the_calendar(spark, name):
    plan = formatted(spark, QUERIES[name](spark, SF_SMALL))
    assert "struct<l_shipdate:timestamp_ntz>" not in plan


def _with_lines(spark, folder, lines):
    """A copy of the small tables whose lineitem is a folder of files (contents alone: the originals may be read-only)."""
    for name in SCHEMAS:
        df = lines if name == "lineitem" else spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        df.write.parquet(f"{folder}/{name}.parquet")


def test_date_spans_follow_the_files(spark, tmp_path):
    folder = str(tmp_path / "tables")
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    _with_lines(spark, folder, lines)
    path = f"{folder}/lineitem.parquet"
    spans = DateSpans(spark, str(tmp_path / "kept"))
    low, high = spans.of(path, "l_shipdate", SCHEMAS["lineitem"])
    want = lines.agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first()
    assert (low, high) == tuple(want)
    before = state_of(spark, path)
    assert before == state_of(spark, path)
    late = lines.limit(1).withColumn("l_shipdate", F.lit("2012-01-15").cast("timestamp_ntz"))
    late.write.mode("append").parquet(path)
    assert state_of(spark, path) != before
    assert spans.of(path, "l_shipdate", SCHEMAS["lineitem"]) == (low, dt.date(2012, 1, 15))
    # another process reads what was kept; only the new file was scanned the second time
    kept = spark.read.schema(DateSpans.SCHEMA).parquet(str(tmp_path / "kept" / "date-spans" / "l_shipdate"))
    n = len(spark.read.parquet(path).inputFiles())
    assert kept.count() == n
    DateSpans._known.clear()
    assert spans.of(path, "l_shipdate", SCHEMAS["lineitem"])[1] == dt.date(2012, 1, 15)
    assert kept.count() == n == spark.read.schema(DateSpans.SCHEMA).parquet(str(tmp_path / "kept" / "date-spans" / "l_shipdate")).count()
    # and rewritten files no longer count
    lines.limit(5).coalesce(1).write.mode("overwrite").parquet(path)
    assert spans.of(path, "l_shipdate", SCHEMAS["lineitem"])[1] < dt.date(2012, 1, 1)


def test_a_later_file_widens_the_calendar_of_every_plan(spark, tmp_path):
    folder = str(tmp_path / "tables")
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    _with_lines(spark, folder, lines)
    assert QUERIES["calendar"](spark, folder).agg(F.max("date")).first()[0] == dt.date(2002, 3, 31)
    before = {r.fin_year for r in QUERIES["monthly_working_days"](spark, folder).collect()}
    gap = sorted(map(repr, QUERIES["gap_by_year"](spark, folder).collect()))
    early = pipeline(spark, folder).bounds
    late = lines.limit(1).withColumn("l_shipdate", F.lit("2012-01-15").cast("timestamp_ntz"))
    late.write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert QUERIES["calendar"](spark, folder).agg(F.max("date")).first()[0] == dt.date(2012, 3, 31)
    assert {r.fin_year for r in QUERIES["monthly_working_days"](spark, folder).collect()} > before
    one = spark.range(1)
    ends = [one.select(b[1].alias("d")).first().d for b in (early, pipeline(spark, folder).bounds)]
    assert ends == [dt.date(2002, 3, 31), dt.date(2012, 3, 31)]
    assert sorted(map(repr, QUERIES["gap_by_year"](spark, folder).collect())) == gap


def test_an_empty_fact_has_an_empty_calendar(spark, tmp_path):
    folder = str(tmp_path / "tables")
    _with_lines(spark, folder, spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where("false"))
    pl = pipeline(spark, folder)
    assert pl.calendar.count() == 0 and pl.gap_by_year.count() == 0


# -- provisional month -----------------------------------------------------------
def _csv_like(spark, months):
    rows = [(m, "100", "Surgery", "RXH", "QNX", 10.0) for m in months]
    return spark.createDataFrame(rows, "month_commencing date, treatment_function_code string, treatment_function string, "
                                       "der_provider_code string, stp_code string, activity double")


def _provisional_pipeline(spark, months, base_months, month):
    from activity_engine.params import Params
    from activity_engine.plans.files_pipeline import from_frames

    base = spark.createDataFrame([("RXH", "Provider", m, 20.0) for m in base_months],
                                 "orgcode string, orgtype string, month_commencing date, value double")
    lookup = spark.createDataFrame([("RXH", "Trust", "A TRUST", "QNX")],
                                   "provider_code string, provider_short_name string, acute_full_name string, stp_code string")
    systems = spark.createDataFrame([("QNX", "NHS S", "S")], "stp_code string, stp_name string, short_name string")
    p = Params(acutes=("RXH",), provisional_month=month)
    return from_frames(spark, _csv_like(spark, months), base, lookup, systems, p)


def test_the_references_provisional_march(spark):
    """2023-03-01 as the reference has it: the newest month goes, with March 2020 and the year's March."""
    march = dt.date(2023, 3, 1)
    months = [dt.date(2022 + (m < 4), m, 1) for m in range(1, 13)]
    base = [dt.date(2019 + (m < 4), m, 1) for m in range(1, 13)]
    on = _provisional_pipeline(spark, [*months, None], base, march)
    off = _provisional_pipeline(spark, [*months, None, dt.date(2023, 4, 1)], base, march)
    never = _provisional_pipeline(spark, months, base, None)
    assert on.settled_actuals.count() == 11 and off.settled_actuals.count() == 14 and never.settled_actuals.count() == 12
    assert {r.month_commencing for r in on.settled_baseline.collect()} == set(base) - {dt.date(2020, 3, 1)}
    assert off.settled_baseline.count() == 12
    scalars = [pl.target_scalars.first() for pl in (on, off, never)]
    assert [s.month_count for s in scalars] == [11, 12, 12] and scalars[1] == scalars[2]
    march_days = never.monthly_working_days.where("month_commencing = date'2024-03-01'").first().working_days
    assert scalars[0].total_wd == scalars[2].total_wd - march_days
    assert {r.month_name_short for r in on.gap_by_month.collect()} == {r.month_name_short for r in never.gap_by_month.collect()} - {"Mar"}
    # the workbook has no such rule
    assert on.baseline_and_goal.count() == 12


def test_one_condition_serves_all_three(spark, static_plans):
    plan = formatted(spark, QUERIES["provisional_gap_by_year"](spark, SF_SMALL))
    # the newest month is found once: later uses of the subquery are references to it
    assert plan.count("ReusedSubquery") >= 2
