"""The reference's scripts as one lazy dependency graph of DataFrames.

``Pipeline(tables, params)`` exposes every intermediate table of the main
method (v3), the workbook, the three-year comparison and the older v1 / v2
methods as cached properties.  Building a property only builds a logical plan;
nothing runs until an action.  Shared sub-plans (the extract, the calendar)
are the same DataFrame objects, so Spark reuses their exchanges within a plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as cal_ops
from ..operators import extract as ex
from ..operators import fairshare as fs
from ..operators import gap as gp
from ..operators import legacy as lg
from ..operators import quality as qa
from ..operators import reports as rp
from ..params import FIN_MONTHS, Params
from ..sources.tables import Tables


#: The tables in each system's and trust's report.
REPORT_TABLES = ("chart_feed", "gap_table", "coverage_table", "specialty_table")


class Pipeline:
    def __init__(self, tables: Tables, params: Params, *, target_fy: str | None = None, target_label: str | None = None,
                 by_icb: bool = True):
        self.t = tables
        self.p = params
        self.target_fy = target_fy or params.target_wd_fy
        self.label = target_label or params.target_label
        self.by_icb = by_icb
        #: Cells of the input files that could not be read, where the inputs are files.
        self.problems: DataFrame | None = None

    def variant_v2(self) -> "Pipeline":
        """The older (v2) method: 2022-23 working days, 'ambition', cohort without icb (built once)."""
        if "_v2" in self.__dict__:
            return self.__dict__["_v2"]
        v2 = Pipeline(self.t, self.p, target_fy=self.p.v2_target_wd_fy, target_label=self.p.v2_target_label, by_icb=False)
        # the calendar and the extracts do not depend on the method: share the same plans
        for name in ("bounds", "date_dim", "holidays", "calendar", "monthly_working_days", "extract", "actuals", "baseline"):
            v2.__dict__[name] = getattr(self, name)
        self.__dict__["_v2"] = v2
        return v2

    # -- calendar ------------------------------------------------------------
    @cached_property
    def bounds(self):
        return cal_ops.resolve_bounds(self.t, self.p)

    @cached_property
    def holidays(self) -> DataFrame:
        return cal_ops.holiday_events(self.t, self.p, self.bounds)

    @cached_property
    def calendar(self) -> DataFrame:
        return cal_ops.calendar(self.t, self.p, self.bounds)

    @cached_property
    def date_dim(self) -> cal_ops.DateDim:
        """Per-date calendar attributes computed in place (no calendar join)."""
        return cal_ops.DateDim(*self.bounds)

    @cached_property
    def monthly_working_days(self) -> DataFrame:
        mwd = cal_ops.monthly_working_days(self.calendar)
        # with a stored range the calendar is known before the plan is made
        return mwd if self.t.calendar_range is None else cal_ops.as_values(mwd)

    @cached_property
    def target_scalars(self) -> DataFrame:
        mwd = self.monthly_working_days
        if self.provisional is not None:
            mwd = cal_ops.without_month(mwd, self.provisional, self.p.provisional_month.strftime("%b"), "month_name_short")
        return cal_ops.year_scalars(mwd, self.target_fy)

    # -- extracts ------------------------------------------------------------
    @cached_property
    def extract(self) -> DataFrame:
        return ex.extract_activity(self.t, self.p)

    @cached_property
    def actuals(self) -> DataFrame:
        return self._before_excluded(gp.as_csv_actuals(self.extract))

    def _before_excluded(self, actuals: DataFrame) -> DataFrame:
        if self.p.exclude_from_month is None:
            return actuals
        return actuals.where(F.col("month_commencing") < self.p.exclude_from_month)

    @cached_property
    def baseline(self) -> DataFrame:
        return ex.planning_baseline(self.t, self.p)

    # -- provisional month (A13): one condition for actuals, baseline and year scalars
    @cached_property
    def provisional(self):
        month = self.p.provisional_month
        return None if month is None else cal_ops.is_provisional(self.actuals, month)

    @cached_property
    def settled_actuals(self) -> DataFrame:
        return cal_ops.without_month(self.actuals, self.provisional, self.p.provisional_month)

    @cached_property
    def settled_baseline(self) -> DataFrame:
        if self.provisional is None:
            return self.baseline
        return cal_ops.without_month(self.baseline, self.provisional, self.p.provisional_baseline_month)

    # -- provider level (v3) -------------------------------------------------
    @cached_property
    def provider_month_totals(self) -> DataFrame:
        return gp.provider_month_totals(self.settled_actuals, self.t.acutes)

    @cached_property
    def rebased(self) -> DataFrame:
        return gp.rebase_working_days(self.settled_baseline, self.monthly_working_days, self.target_fy)

    @cached_property
    def target(self) -> DataFrame:
        return gp.target(self.rebased, self.p.target_factor, self.label)

    @cached_property
    def stacked(self) -> DataFrame:
        return gp.stack_periods(self.rebased, self.provider_month_totals, self.p.target_factor, self.date_dim, self.label)

    @cached_property
    def gap_by_month(self) -> DataFrame:
        return gp.gap_by_month(self.stacked, self.label)

    @cached_property
    def with_variance(self) -> DataFrame:
        return gp.append_variance(self.stacked, self.gap_by_month)

    @cached_property
    def enriched(self) -> DataFrame:
        return gp.enrich_names(self.with_variance, self.t.provider_lookup, self.t.system_lookup, int(self.p.actual_fy[:4]))

    @cached_property
    def enriched_stacked(self) -> DataFrame:
        """Names on the distinct stacked rows (the variance rows left out)."""
        rows = gp.distinct_stacked_rows(self.rebased, self.provider_month_totals, self.p.target_factor, self.date_dim, self.label)
        return gp.enrich_names(rows, self.t.provider_lookup, self.t.system_lookup, int(self.p.actual_fy[:4]))

    @cached_property
    def gap_by_month_per_day(self) -> DataFrame:
        return gp.gap_by_month_per_day(self.enriched_stacked, self.monthly_working_days, self.target_fy, self.label)

    @cached_property
    def gap_per_day_wide(self) -> DataFrame:
        return gp.gap_per_day_wide(self.gap_by_month_per_day)

    @cached_property
    def gap_by_year(self) -> DataFrame:
        return gp.gap_by_year(self.gap_by_month_per_day, self.target_scalars, self.label)

    @cached_property
    def gap_by_year_code(self) -> DataFrame:
        return gp.gap_by_year_code(self.gap_by_month, self.target_scalars, self.label)

    # -- specialty level -------------------------------------------------------
    @cached_property
    def specialty_share(self) -> DataFrame:
        return fs.specialty_share(self.settled_actuals, self.t.acutes, self.date_dim)

    @cached_property
    def specialty_gap(self) -> DataFrame:
        return fs.specialty_gap(self.specialty_share, self.gap_by_month, self.t.provider_lookup, self.t.system_lookup, self.label)

    @cached_property
    def cohort_flags(self) -> DataFrame:
        return fs.cohort_flags(self.specialty_gap, self.p, by_icb=self.by_icb)

    @cached_property
    def cohort(self) -> DataFrame:
        return fs.cohort(self.specialty_gap, self.p, by_icb=self.by_icb, flags=self.cohort_flags)

    @cached_property
    def cohort_rows(self) -> DataFrame:
        return fs.cohort_rows(self.cohort_flags)

    @cached_property
    def cohort_coverage(self) -> DataFrame:
        return fs.cohort_coverage(self.cohort, by_icb=self.by_icb)

    @cached_property
    def cohort_monthly_per_day(self) -> DataFrame:
        return fs.cohort_monthly_per_day(self.cohort_rows, self.monthly_working_days, self.target_fy, self.label)

    @cached_property
    def fair_share(self) -> DataFrame:
        if self.by_icb:
            return fs.fair_share(self.cohort_rows, self.target_scalars, self.label)
        return fs.fair_share_v2(self.cohort_rows, self.target_scalars, self.label)

    @cached_property
    def specialty_gap_per_day_wide(self) -> DataFrame:
        return fs.specialty_gap_per_day_wide(self.cohort_monthly_per_day)

    # -- workbook, comparison, v1 ---------------------------------------------
    @cached_property
    def baseline_and_goal(self) -> DataFrame:
        return gp.baseline_and_goal(self.baseline, self.monthly_working_days, self.target_fy, self.p.workbook_target_factor)

    @cached_property
    def activity_comparison(self) -> DataFrame:
        return lg.activity_comparison(self.extract_3y, self.date_dim)

    @cached_property
    def march_counterfactual(self) -> DataFrame:
        return lg.march_counterfactual(
            gp.as_csv_actuals(self.extract_history), self.t.acutes, self.monthly_working_days, self.p
        )

    @cached_property
    def per_day_gap_v1(self) -> DataFrame:
        return lg.v1_wide(self.per_day_rows_v1, self.p)

    @cached_property
    def per_day_long_v1(self) -> DataFrame:
        return lg.per_day_long_v1(self.per_day_rows_v1, self.p)

    @cached_property
    def per_day_rows_v1(self) -> DataFrame:
        counterfactual = lg.march_counterfactual(self.v1_extract("history"), self.t.acutes, self.monthly_working_days, self.p)
        return lg.per_day_rows_v1(
            self.v1_extract("excl_march"),
            counterfactual,
            self._before_excluded(self.v1_extract("actual")),
            self.t,
            self.date_dim,
            self.monthly_working_days,
            self.p,
        )

    @cached_property
    def specialty_split_v1(self) -> DataFrame:
        return lg.specialty_split_v1(self.actuals, self.t, self.monthly_working_days, self.p)

    # -- other extracts ----------------------------------------------------------
    @cached_property
    def extract_3y(self) -> DataFrame:
        return ex.extract_activity_3y(self.t, self.p)

    @cached_property
    def extracts_together(self) -> DataFrame:
        """The four extracts (D4-D7) with their scope, from one scan of the fact."""
        return ex.extract_together(self.t, self.p, ex.extract_scopes(self.p))

    @cached_property
    def v1_extracts(self) -> DataFrame:
        """The three extracts that the older per-day method takes, from one scan of the fact."""
        scopes = ex.extract_scopes(self.p)
        return ex.extract_together(self.t, self.p, {k: scopes[k] for k in ("actual", "excl_march", "history")})

    def v1_extract(self, scope: str) -> DataFrame:
        given = {"actual": "extract", "excl_march": "extract_excl_march", "history": "extract_history"}[scope]
        # an extract that was given (from CSV) or computed before is taken as it is
        found = self.__dict__[given] if given in self.__dict__ else ex.one_scope(self.v1_extracts, scope)
        return gp.as_csv_actuals(found)

    @cached_property
    def attendances_by_scope(self) -> DataFrame:
        spark = self.t.attendance.sparkSession
        scopes = ex.extract_scopes(self.p)
        return ex.attendances_by_scope(self.t, ex.scope_years(spark, scopes), list(scopes))

    @cached_property
    def extract_excl_march(self) -> DataFrame:
        return ex.extract_baseline_excl_march(self.t, self.p)

    @cached_property
    def extract_history(self) -> DataFrame:
        return ex.extract_march_history(self.t, self.p)

    @cached_property
    def hrg_series_baseline(self) -> DataFrame:
        return ex.hrg_series_baseline(self.t, self.p)

    @cached_property
    def follow_up_tracking(self) -> DataFrame:
        return ex.follow_up_tracking(self.t, self.p)

    @cached_property
    def follow_up_tracking_rolled(self) -> DataFrame:
        return ex.follow_up_tracking(self.t, self.p, rolled=True)

    @cached_property
    def normalise_provider(self) -> DataFrame:
        return ex.normalise_provider(self.t.attendance, self.p)

    @cached_property
    def join_working_days(self) -> DataFrame:
        return gp.join_working_days(self.baseline, self.monthly_working_days, self.target_fy)

    # -- reports -------------------------------------------------------------------
    @cached_property
    def report_scope(self) -> DataFrame:
        return rp.report_scope(self.t.system_lookup, self.t.provider_lookup, self.t.acutes, self.p)

    @cached_property
    def report_chart_feed(self) -> DataFrame:
        return rp.chart_feed(self.enriched, self.label)

    @cached_property
    def report_gap_table(self) -> DataFrame:
        return rp.gap_table(self.gap_by_year, self.label)

    @cached_property
    def report_coverage_table(self) -> DataFrame:
        return rp.coverage_table(self.cohort_coverage)

    @cached_property
    def report_specialty_table(self) -> DataFrame:
        return rp.specialty_table(self.fair_share)

    @cached_property
    def report_system_feed(self) -> DataFrame:
        return self.system_report("gap_table")

    @cached_property
    def report_trust_feed(self) -> DataFrame:
        return self.trust_report("gap_table")

    def system_report(self, table: str) -> DataFrame:
        """One of ``REPORT_TABLES``, a copy per system report and one for the region (K2)."""
        return rp.system_feed(getattr(self, f"report_{table}"), self.report_scope, self.p)

    def trust_report(self, table: str) -> DataFrame:
        """One of ``REPORT_TABLES``, the rows of each trust's report (K3)."""
        return rp.trust_feed(getattr(self, f"report_{table}"), self.report_scope)

    @cached_property
    def activity_by_working_day(self) -> DataFrame:
        return cal_ops.activity_by_working_day(self.t.attendance, self.calendar)

    # -- data quality ----------------------------------------------------------------
    @cached_property
    def dq_months_reported(self) -> DataFrame:
        return qa.months_reported(lg.history_per_provider_month(
            gp.as_csv_actuals(self.extract_history), self.t.acutes, self.monthly_working_days))

    @cached_property
    def dq_duplicated_cells(self) -> DataFrame:
        ids = ["icb", "provider", "treatment_function"]
        lists = qa.pivot_lists(self.cohort_monthly_per_day, ids, "month_name_short", list(FIN_MONTHS), "wd_variance_by_spec")
        return qa.duplicated_cells(lists, ids, list(FIN_MONTHS))

    @cached_property
    def dq_pivot_duplicates(self) -> DataFrame:
        parts = [
            qa.pivot_duplicates("gap_by_month", self.stacked, ["month_name_short", "fin_month", "provider_code"], "period"),
            qa.pivot_duplicates(
                "gap_by_month_per_day",
                self.enriched,
                ["month_name_short", "fin_month", "provider", "acute_full_name", "icb", "month_of_actual"],
                "period",
            ),
            qa.pivot_duplicates("gap_per_day_wide", self.gap_by_month_per_day, ["icb", "provider"], "month_name_short"),
            qa.pivot_duplicates(
                "specialty_gap_per_day_wide",
                self.cohort_monthly_per_day,
                ["icb", "provider", "treatment_function"],
                "month_name_short",
            ),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
