
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as fd
from ..functions.formatting import date_text, percent_text, thousands
from ..functions.semantics import left_join, round_half_even
from ..functions.text import provider_code, title_case_nhs
from ..operators import extract as ex
from ..operators import fairshare as fs
from ..params import Params, test_params
from ..session import checkpoint_dir
from ..sinks.writers import ORDER, add_tracking, manifest, publish, published, ranked, tracking_table, write_table
from ..sources import files
from .pipeline import Pipeline
from .registry import QueryFn, _p, _q, finalize, pipeline


# -- join-level queries (J1-J17) -------------------------------------------------
def join_names(pl: Pipeline) -> DataFrame:
    """J4 + J6: each acute (provider code, STP) pair with names by code and by its own STP."""
    pairs = pl.actuals.select("der_provider_code", "stp_code").distinct()
    lk = pl.t.provider_lookup.select(
        "provider_code", "provider_short_name", "acute_full_name", F.col("stp_code").alias("lookup_stp_code")
    )
    j = left_join(pairs, lk, {"der_provider_code": "provider_code"})
    return left_join(j, pl.t.system_lookup, ["stp_code"])


def join_composite_lookup(pl: Pipeline) -> DataFrame:
    """Provider names by (code, STP); rows whose STP differs from the lookup's miss."""
    pairs = pl.specialty_share.groupBy("provider_code", "stp_code").agg(F.count(F.lit(1)).alias("rows"))
    lk = pl.t.provider_lookup.select("provider_code", "stp_code", "provider_short_name")
    j = left_join(pairs, lk, ["provider_code", "stp_code"])
    return j.withColumn("matched", F.col("provider_short_name").isNotNull())


def join_case_key(pl: Pipeline) -> DataFrame:
    """Attendances (extract scope, any region) joined to the hierarchy on the CASE key."""
    p = pl.p
    att = pl.t.attendance.where(
        F.col("first_attendance").isin("2", "4")
        & F.col("attendance_status").isin("5", "6")
        & F.col("der_financial_year").isin(p.actual_fy)
        & F.col("der_provider_code").startswith("R")
    )
    att = att.select(
        "der_provider_code", provider_code("der_provider_code", p.join_rules).alias("hierarchy_key")
    )
    h = pl.t.provider_hierarchy.select("organisation_code", "stp_code", "region_code")
    j = att.join(h, att.hierarchy_key == h.organisation_code, "left")
    return j.groupBy("der_provider_code", "hierarchy_key", "organisation_code", "stp_code", "region_code").agg(
        F.count(F.lit(1)).alias("attendances")
    )


def join_cost_flags(pl: Pipeline) -> DataFrame:
    """Attendance left join cost on (opa_ident, financial year), counted by year and WF flag."""
    a = pl.t.attendance.select("opa_ident", "der_financial_year")
    c = pl.t.attendance_cost.select(
        F.col("opa_ident").alias("_i"), F.col("der_financial_year").alias("_fy"), "hrg_code_other"
    )
    j = a.join(c, (a.opa_ident == c._i) & (a.der_financial_year == c._fy), "left")
    flag = F.when(F.col("hrg_code_other").like("WF%"), F.lit("Y")).otherwise(F.lit("N"))
    return j.groupBy("der_financial_year", flag.alias("wf_flag")).agg(
        F.count(F.lit(1)).alias("attendances"), F.count("hrg_code_other").alias("with_cost")
    )


# -- scalar-function queries (X1-X24) ---------------------------------------------
def scalar_calendar(pl: Pipeline) -> DataFrame:
    """Calendar functions on every distinct appointment date."""
    d = pl.t.attendance.select("appointment_date").distinct()
    a = F.col("appointment_date")
    fm = fd.fin_month(a)
    return d.select(
        a.alias("date"),
        F.dayofmonth(a).alias("day_num"),
        fd.weekday_abbr(a).alias("day_name"),
        F.dayofweek(a).alias("weekday_num"),
        F.month(a).alias("month_num"),
        F.year(a).alias("year_num"),
        fd.month_abbr(a).alias("month_name_short"),
        fd.fin_year(a, "-").alias("fin_year"),
        fd.fin_year(a, "/").alias("fin_year_sql"),
        fm.alias("fin_month"),
        fd.first_of_month(a).alias("month_commencing"),
        fd.activity_month(a).alias("activity_month"),
        fd.yyyymm_to_iso(fd.activity_month(a)).alias("month_text"),
        fd.month_of_fin_month(fm, pl.p.actual_fy_start_year).alias("month_of_actual"),
    )


def scalar_text(pl: Pipeline) -> DataFrame:
    """String functions on the distinct provider / TFC / HRG codes."""
    t = pl.t.attendance.select("der_provider_code", "treatment_function_code", "core_hrg").distinct()
    ref = pl.t.tfc_ref.select(F.col("treatment_function_code").alias("_tfc"), "treatment_function_desc")
    t = t.join(ref, t.treatment_function_code == ref._tfc, "left")
    h = pl.t.provider_hierarchy.select(F.col("organisation_code").alias("_org"), "organisation_name", "stp_name")
    left3 = F.substring("der_provider_code", 1, 3)
    t = t.join(h, left3 == h._org, "left")
    c = F.col("der_provider_code")
    return t.select(
        "der_provider_code",
        "treatment_function_code",
        "core_hrg",
        left3.alias("left3"),
        F.substring(c, -2, 2).alias("right2"),
        F.expr("substring(der_provider_code, 2)").alias("tail"),
        F.expr("substring(treatment_function_desc, 5)").alias("treatment_function"),
        F.concat(c, F.col("treatment_function_code")).alias("pair_key"),
        F.lower(c).alias("lower_code"),
        F.col("core_hrg").startswith("WF").alias("is_wf"),
        c.like("R%").alias("is_r"),
        title_case_nhs(F.concat(F.lit("NHS "), F.col("stp_name"), F.lit(" "), F.col("organisation_name"))).alias("title"),
    )


def scalar_format(pl: Pipeline) -> DataFrame:
    """Date text, half-even rounding, percentage and thousands text on planning rows."""
    p = pl.t.planning.where(F.col("planningref") == pl.p.planning_ref)
    v = F.col("value")
    return p.select(
        "orgcode",
        "dimdatestart",
        "orgtype",
        "sourcetype",
        date_text("dimdatestart", "dd/MM/yyyy").alias("date_dmy"),
        date_text("dimdatestart", "ddMMyyyy").alias("date_stamp"),
        round_half_even(v / 8.0, 1).alias("value_8th_1dp"),
        round_half_even(v / 8.0, 0).alias("value_8th_0dp"),
        percent_text(v / 1000.0).alias("value_permille_pct"),
        thousands(v * 1000.0, 0).alias("value_thousands"),
    )


# -- sinks and files read back (K2-K4, O1-O3, S1-S5) --------------------------------------
def _ordered(attr: str, order: str) -> QueryFn:
    """A final table with each row's place in its order, after rounding (so that equal values tie)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked(finalize(getattr(pipeline(spark, sf_dir), attr)), ORDER[order])

    return run


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tracking_in_batches(pl: Pipeline) -> DataFrame:
    """K4: the tracking table from one batch for each tracking year, merged by key; the last batch is added twice."""
    spark = pl.t.attendance.sparkSession
    path = _scratch(spark, "tracking")
    fys = pl.p.tracking_fys
    for fy in (*fys, fys[-1]):
        one = ex.follow_up_tracking(pl.t, pl.p.with_(tracking_fys=(fy,)))
        add_tracking(one, path, fy.replace("/", "-"))
    return tracking_table(spark, path, one.columns)


def published_specialty_table(pl: Pipeline) -> DataFrame:
    """K2: the systems' specialty tables as a reader of the published folder gets them, with the manifest's counts."""
    spark = pl.t.attendance.sparkSession
    root, day = _scratch(spark, "published"), dt.date(2024, 1, 31)
    publish(spark, finalize(pl.system_report("specialty_table")), root, "systems", day)
    rows = published(spark, root, "systems", day)
    counts = manifest(spark, root).where("rows > 0").select("report", F.col("rows").alias("report_rows"))
    # one row for each report: regions and systems
    return rows.withColumn("report", F.col("report").cast("string")).join(F.broadcast(counts), "report")


def _csv_of_extract(pl: Pipeline) -> str:
    """The actuals extract as the reference's CSV file, with cells that can't be read: text in place of every third
    count, and an impossible date for counts of 2, 6, 10 and so on."""
    path = _scratch(pl.t.attendance.sparkSession, "extract-csv")
    e = pl.extract
    bad = e.withColumn("text", F.when(F.col("activity") % 3 == 0, F.lit("n/a")).otherwise(F.col("activity").cast("string")))
    bad = bad.withColumn(
        "day", F.when(F.col("activity") % 4 == 2, F.lit("31/02/1999")).otherwise(F.date_format("month_commencing", "dd/MM/yyyy"))
    )
    out = bad.select(
        F.col("day").alias("Month_commencing"),
        F.col("treatment_function_code").alias("Treatment_Function_Code"),
        F.col("treatment_function").alias("Treatment_Function"),
        F.col("der_provider_code").alias("Der_Provider_Code"),
        F.col("stp_code").alias("STP_Code"),
        F.col("text").alias("Activity"),
    )
    write_table(out, path, fmt="csv")
    return path


def csv_extract_activity(pl: Pipeline) -> DataFrame:
    """The extract read back from CSV; what can't be read is NULL."""
    return files.read_activity_csv(pl.t.attendance.sparkSession, _csv_of_extract(pl))


def csv_problems(pl: Pipeline) -> DataFrame:
    """What could not be read, by column and text."""
    found = files.csv_problems(pl.t.attendance.sparkSession, _csv_of_extract(pl), files.ACTIVITY_SCHEMA)
    return found.groupBy("col", "expected", "actual").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("file", "row").alias("records"))


def fixed_calendar_params() -> Params:
    """A calendar of fixed dates that ends within a December, as the reference's does, inside the data's span."""
    return test_params().with_(calendar_start=dt.date(1996, 1, 1), calendar_end=dt.date(2000, 12, 26))


def provisional_params() -> tuple[Params, Params]:
    """The last month of the actual year as the provisional one, and one that a later month has settled."""
    p = test_params()
    months = p.actual_fy_months()
    return p.with_(provisional_month=months[-1]), p.with_(provisional_month=months[5])


def build() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {}

    # calendar (D1, D2, S7, S8, A10)
    # these are made of the dates alone, so they read them
    q["calendar"] = _p("calendar", stored_span=False)
    q["monthly_working_days"] = _p("monthly_working_days", stored_span=False)
    q["holiday_events"] = _p("holidays", stored_span=False)
    q["target_year_scalars"] = _p("target_scalars", stored_span=False)

    # extracts (D3-D10, P6)
    q["normalise_provider"] = _p("normalise_provider")
    q["extract_activity"] = _p("extract")
    q["extract_activity_3y"] = _p("extract_3y")
    q["extract_baseline_excl_march"] = _p("extract_excl_march")
    q["extract_march_history"] = _p("extract_history")
    q["planning_baseline"] = _p("baseline")
    q["hrg_series_baseline"] = _p("hrg_series_baseline")
    q["follow_up_tracking"] = _p("follow_up_tracking")
    q["follow_up_tracking_rolled"] = _p("follow_up_tracking_rolled")
    q["lower_columns"] = _q(lambda pl: ex.lower_columns(ex.with_sql_headers(pl.extract)))

    q["extracts_together"] = _p("extracts_together")

    # the fact's laid-out copy: year partitions and buckets of the cost key
    q["prepared_extract_activity"] = _p("extract", prepared=True)
    q["prepared_extracts_together"] = _p("extracts_together", prepared=True)
    q["prepared_follow_up_tracking"] = _p("follow_up_tracking", prepared=True)
    q["prepared_attendances_by_scope"] = _p("attendances_by_scope", prepared=True)
    q["prepared_gap_by_year"] = _p("gap_by_year", prepared=True)

    # provisional month (A13): cut while it is the newest, kept once a later one is in
    cut, kept = provisional_params()
    for name, p in (("provisional", cut), ("settled", kept)):
        q[f"{name}_year_scalars"] = _p("target_scalars", params=p)
        q[f"{name}_gap_by_year"] = _p("gap_by_year", params=p)
        q[f"{name}_fair_share"] = _p("fair_share", params=p)

    # provider level
    q["provider_month_totals"] = _p("provider_month_totals")
    q["join_working_days"] = _p("join_working_days")
    q["rebase_working_days"] = _p("rebased")
    q["target"] = _p("target")
    q["stack_periods"] = _p("stacked")
    q["gap_by_month"] = _p("gap_by_month")
    q["append_variance"] = _p("with_variance")
    q["enrich_names"] = _p("enriched")
    q["gap_by_month_per_day"] = _p("gap_by_month_per_day")
    q["gap_per_day_wide"] = _p("gap_per_day_wide")
    q["gap_by_year"] = _p("gap_by_year")
    q["gap_by_year_code"] = _p("gap_by_year_code")
    q["baseline_and_goal"] = _p("baseline_and_goal")

    # specialty level
    q["specialty_share"] = _p("specialty_share")
    q["specialty_gap"] = _p("specialty_gap")
    q["cohort"] = _p("cohort")
    q["semi_cohort"] = _q(lambda pl: fs.cohort_members(pl.cohort_flags))
    q["cohort_rows"] = _p("cohort_rows")
    q["cohort_coverage"] = _p("cohort_coverage")
    q["cohort_monthly_per_day"] = _p("cohort_monthly_per_day")
    q["fair_share"] = _p("fair_share")
    q["specialty_gap_per_day_wide"] = _p("specialty_gap_per_day_wide")

    # older methods
    q["activity_comparison"] = _p("activity_comparison")
    q["march_counterfactual"] = _p("march_counterfactual")
    q["per_day_gap_v1"] = _p("per_day_gap_v1")
    q["specialty_split_v1"] = _p("specialty_split_v1")
    q["gap_by_month_per_day_v2"] = _p("gap_by_month_per_day", v2=True)
    q["fair_share_v2"] = _p("fair_share", v2=True)
    q["cohort_coverage_v2"] = _p("cohort_coverage", v2=True)

    # reports (D37-D42)
    q["report_chart_feed"] = _p("report_chart_feed")
    q["report_gap_table"] = _p("report_gap_table")
    q["report_coverage_table"] = _p("report_coverage_table")
    q["report_specialty_table"] = _p("report_specialty_table")
    q["report_scope"] = _p("report_scope")
    q["report_system_feed"] = _p("report_system_feed")
    q["report_trust_feed"] = _p("report_trust_feed")
    for table in ("chart_feed", "coverage_table", "specialty_table"):
        q[f"report_system_{table}"] = _q(lambda pl, table=table: pl.system_report(table))
        q[f"report_trust_{table}"] = _q(lambda pl, table=table: pl.trust_report(table))

    # orders (O1-O3), published and incremental tables (K2-K4), files read back
    for attr, order in (
        ("extract", "extract"), ("monthly_working_days", "monthly_working_days"), ("gap_by_month", "gap_by_month"),
        ("cohort_rows", "cohort_rows"), ("fair_share", "fair_share"), ("gap_per_day_wide", "wide_by_april"),
        ("specialty_gap_per_day_wide", "wide_by_april"), ("baseline", "planning_baseline"),
    ):
        q[f"ordered_{attr}"] = _ordered(attr, order)
    q["tracking_in_batches"] = _q(tracking_in_batches)
    q["published_specialty_table"] = _q(published_specialty_table)
    q["csv_extract_activity"] = _q(csv_extract_activity)
    q["csv_problems"] = _q(csv_problems)
    q["activity_by_working_day"] = _p("activity_by_working_day", params=fixed_calendar_params())
    q["per_day_long_v1"] = _p("per_day_long_v1")
    q["dq_duplicated_cells"] = _p("dq_duplicated_cells")

    # data quality (D11, R guard)
    q["dq_months_reported"] = _p("dq_months_reported")
    q["dq_pivot_duplicates"] = _p("dq_pivot_duplicates")

    # joins and scalar functions
    q["join_names"] = _q(join_names)
    q["join_composite_lookup"] = _q(join_composite_lookup)
    q["join_case_key"] = _q(join_case_key)
    q["join_cost_flags"] = _q(join_cost_flags)
    q["scalar_calendar"] = _q(scalar_calendar)
    q["scalar_text"] = _q(scalar_text)
    q["scalar_format"] = _q(scalar_format)
    return q
