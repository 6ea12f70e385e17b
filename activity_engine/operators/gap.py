"""Baseline rebasing, target, stacked periods and gap tables.

Inputs here are monthly aggregates (providers x months), so every join to the
calendar / working-day tables is a broadcast of a table bounded by the
calendar range, and the pivots use explicit value lists (no extra job to
discover the values).  Null rules follow the reference (dplyr): joins match
NULL keys, plain sums are strict, yearly sums skip NULL and NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_of_fin_month
from ..functions.semantics import left_join, listed, pivot_strict, ratio, strict_sum, sum_na_rm, union_distinct
from ..params import FIN_MONTHS
from .calendar import attach_calendar, trimmed_working_days, year_working_days

def only_acutes(df: DataFrame, acutes: DataFrame, code_col: str = "der_provider_code") -> DataFrame:
    """``filter(code %in% acutes)``; the acute list is bounded (one row per trust)."""
    a = acutes.select(F.col("provider_code").alias("_acute"))
    return df.join(a, df[code_col] == a._acute, "left_semi")


def as_csv_actuals(extract: DataFrame) -> DataFrame:
    """The extract as the R scripts see it after ``read_csv``: activity is a double."""
    return extract.withColumn("activity", F.col("activity").cast("double"))


def provider_month_totals(actuals: DataFrame, acutes: DataFrame) -> DataFrame:
    """Acute activity per provider and month, labelled 'actual'."""
    a = only_acutes(actuals, acutes)
    return a.groupBy("month_commencing", "der_provider_code").agg(strict_sum("activity").alias("activity")).select(
        "month_commencing",
        F.col("der_provider_code").alias("provider_code"),
        "activity",
        F.lit("actual").alias("period"),
    )


def join_working_days(baseline: DataFrame, mwd: DataFrame, target_fy: str) -> DataFrame:
    """J1 + J2: the baseline with its own month's and the target year's working days."""
    b = left_join(baseline, trimmed_working_days(mwd), ["month_commencing"], broadcast=True)
    b = b.withColumnsRenamed({"working_days": "working_days_base", "value": "activity"})
    return left_join(b, year_working_days(mwd, target_fy), ["month_name_short"], broadcast=True)


def rebase_working_days(baseline: DataFrame, mwd: DataFrame, target_fy: str) -> DataFrame:
    """Baseline activity / own-month working days x target-year working days."""
    b = join_working_days(baseline, mwd, target_fy)
    return b.select(
        "month_commencing",
        F.col("orgcode").alias("provider_code"),
        (ratio("activity", "working_days_base") * F.col("working_days_target")).alias("activity"),
        F.lit("baseline").alias("period"),
    )


def target(rebased: DataFrame, factor: float, label: str = "target") -> DataFrame:
    """The rebased baseline times the target factor."""
    return rebased.select(
        "month_commencing", "provider_code", (F.col("activity") * F.lit(factor)).alias("activity"), F.lit(label).alias("period")
    )


def baseline_and_goal(baseline: DataFrame, mwd: DataFrame, target_fy: str, factor: float) -> DataFrame:
    """The workbook table: rebased baseline and its goal."""
    b = join_working_days(baseline, mwd, target_fy)
    adj = ratio("activity", "working_days_base") * F.col("working_days_target")
    return b.withColumn("adj_activity", adj).withColumn("target", F.col("adj_activity") * F.lit(factor))


def baseline_and_target_rows(rebased: DataFrame, factor: float, label: str = "target") -> DataFrame:
    """D13 + D14 in one pass: each rebased row as a 'baseline' row and a target row.

    Equal to the union of ``rebased`` and ``target(rebased)``; the baseline is
    scanned once instead of twice.
    """
    two = F.explode(
        F.array(
            F.struct(F.col("activity").alias("a"), F.lit("baseline").alias("p")),
            F.struct((F.col("activity") * F.lit(factor)).alias("a"), F.lit(label).alias("p")),
        )
    ).alias("r")
    return rebased.select("month_commencing", "provider_code", two).select(
        "month_commencing", "provider_code", F.col("r.a").alias("activity"), F.col("r.p").alias("period")
    )


def distinct_stacked_rows(rebased: DataFrame, actual: DataFrame, factor: float, cal, label: str = "target") -> DataFrame:
    """The stacked rows after the reference's later distinct union (D17), without the variance rows.

    ``distinct(project(distinct(u)))`` equals ``distinct(project(u))``, so one
    distinct over the projected union replaces two.
    """
    rows = baseline_and_target_rows(rebased, factor, label).unionByName(actual)
    rows = attach_calendar(rows, "month_commencing", cal, ["month_name_short", "fin_month"])
    return rows.select("month_name_short", "fin_month", "provider_code", "activity", "period").distinct()


def stack_periods(rebased: DataFrame, actual: DataFrame, factor: float, cal: DataFrame, label: str = "target") -> DataFrame:
    """Baseline, actual and target rows (a distinct union) keyed by month label.

    The reference takes two distinct unions; a distinct union does not depend
    on order or grouping, so one is enough.  The year is dropped, so the
    baseline year and the actual year line up by month name and financial month.
    """
    rows = baseline_and_target_rows(rebased, factor, label).unionByName(actual).distinct()
    rows = attach_calendar(rows, "month_commencing", cal, ["month_name_short", "fin_month"])
    return rows.select("month_name_short", "fin_month", "provider_code", "activity", "period")


def pivot_periods(df: DataFrame, ids: list[str], periods: list[str], target_label: str) -> DataFrame:
    """``pivot_wider(names_from = period)`` (``pivot_strict``) then ``variance = actual - target``.

    A duplicated id would become a list column in the reference; here the
    cell is the strict sum of the duplicates (equal to the value when unique;
    ``dq_pivot_duplicates`` reports such ids).
    """
    wide = pivot_strict(df, ids, "period", periods, "activity")
    return wide.withColumn("variance", F.col("actual") - F.col(target_label))


def gap_by_month(stacked: DataFrame, target_label: str = "target") -> DataFrame:
    """One row per month label and provider code: baseline, actual, target, variance."""
    return pivot_periods(
        stacked, ["month_name_short", "fin_month", "provider_code"], ["baseline", "actual", target_label], target_label
    )


def append_variance(stacked: DataFrame, gap: DataFrame) -> DataFrame:
    """The variance as a fourth period, distinct union with the stacked rows."""
    v = gap.select(
        "month_name_short", "fin_month", "provider_code", F.col("variance").alias("activity"), F.lit("variance").alias("period")
    )
    return union_distinct(stacked, v)


def enrich_names(rows: DataFrame, provider_lookup: DataFrame, system_lookup: DataFrame, actual_fy_start: int) -> DataFrame:
    """Provider and system names instead of codes, plus the month of the actual year."""
    r = left_join(rows, provider_lookup, ["provider_code"])
    r = left_join(r, system_lookup, ["stp_code"])
    r = r.withColumnsRenamed({"provider_short_name": "provider", "short_name": "icb"}).drop(
        "stp_name", "stp_code", "provider_code"
    )
    return r.withColumn("month_of_actual", month_of_fin_month("fin_month", actual_fy_start))


def gap_by_month_per_day(enriched: DataFrame, mwd: DataFrame, target_fy: str, target_label: str = "target") -> DataFrame:
    """The enriched rows pivoted again, with per-working-day columns of the target year.

    The reference pivots the rows including the appended variance period and
    then recomputes ``variance``; the variance rows carry no new ids, so
    ``enriched`` may equally be the enriched *distinct stacked* rows (no
    variance rows), which keeps one copy of the stacked plan.
    """
    ids = ["month_name_short", "fin_month", "provider", "acute_full_name", "icb", "month_of_actual"]
    wide = pivot_periods(enriched, ids, ["baseline", "actual", target_label], target_label)
    wide = left_join(wide, year_working_days(mwd, target_fy, "wd_target"), ["month_name_short"], broadcast=True)
    return wide.select(
        "month_name_short",
        "fin_month",
        "icb",
        "provider",
        "baseline",
        "actual",
        target_label,
        "variance",
        ratio("actual", "wd_target").alias("activity_per_wd"),
        ratio(target_label, "wd_target").alias(f"{target_label}_per_wd"),
        ratio("variance", "wd_target").alias("variance_per_wd"),
    )


def months_wide(df: DataFrame, ids: list[str], value: str) -> DataFrame:
    """R2: month labels to twelve columns Apr..Mar (explicit list, no discovery job).

    A row without a month label has no column: it fails the query.
    """
    df = df.withColumn("month_name_short", listed("month_name_short", FIN_MONTHS))
    return pivot_strict(df, ids, "month_name_short", list(FIN_MONTHS), value)


def gap_per_day_wide(per_day: DataFrame) -> DataFrame:
    """Variance per working day, one column per month, per icb and provider."""
    return months_wide(per_day, ["icb", "provider"], "variance_per_wd")


def _with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    # scalars is a one-row aggregate: a broadcast of one row
    return df.crossJoin(F.broadcast(scalars))


def gap_by_year(per_day: DataFrame, scalars: DataFrame, target_label: str = "target") -> DataFrame:
    """Yearly totals per icb and provider (NULL and NaN skipped), variance, percent."""
    y = per_day.groupBy("icb", "provider").agg(
        sum_na_rm("baseline").alias("baseline"),
        sum_na_rm("actual").alias("actual"),
        sum_na_rm(target_label).alias(target_label),
    )
    y = _with_scalars(y, scalars.select("total_wd"))
    var = F.col("actual") - F.col(target_label)
    return y.select(
        "icb",
        "provider",
        "baseline",
        "actual",
        target_label,
        var.alias("variance"),
        ratio(var, "actual").alias("percent_vs_actual"),
        ratio(var, "total_wd").alias("variance_per_wd"),
    )


def gap_by_year_code(gap: DataFrame, scalars: DataFrame, target_label: str = "target") -> DataFrame:
    """Yearly totals per provider code; ``actual/target - 1``."""
    y = gap.groupBy("provider_code").agg(
        sum_na_rm("baseline").alias("baseline"),
        sum_na_rm("actual").alias("actual"),
        sum_na_rm(target_label).alias(target_label),
    )
    y = _with_scalars(y, scalars.select("total_wd"))
    var = F.col("actual") - F.col(target_label)
    return y.select(
        "provider_code",
        "baseline",
        "actual",
        target_label,
        var.alias("variance"),
        (ratio("actual", target_label) - F.lit(1.0)).alias("perc_variance"),
        ratio(var, "total_wd").alias("variance_per_wd"),
    )
