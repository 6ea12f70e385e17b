"""The three-year comparison (D32) and the older per-working-day method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_of_fin_month
from ..functions.semantics import left_join, listed, pivot_strict, ratio, round_half_even, strict_sum, union_distinct
from ..params import Params
from ..sources.tables import Tables
from .calendar import attach_calendar
from .gap import only_acutes


def activity_comparison(actuals_3y: DataFrame, cal: DataFrame) -> DataFrame:
    """Three years of activity by month, provider (3 characters) and STP."""
    a = actuals_3y.withColumn("activity", F.col("activity").cast("double"))
    a = attach_calendar(
        a, "month_commencing", cal, ["year_num", "month_name_short", "fin_year", "fin_month"], first_of_month_only=True
    )
    keys = ["month_commencing", "year_num", "fin_year", "month_name_short", "fin_month", "der_provider_code", "stp_code"]
    a = a.select(*keys[:5], F.substring("der_provider_code", 1, 3).alias("der_provider_code"), "stp_code", "activity")
    return a.groupBy(*keys).agg(strict_sum("activity").alias("activity"))


def _no_spec(df: DataFrame, acutes: DataFrame) -> DataFrame:
    return (
        only_acutes(df, acutes)
        .groupBy("month_commencing", "der_provider_code", "stp_code")
        .agg(strict_sum("activity").alias("activity"))
    )


def _wd(mwd: DataFrame) -> DataFrame:
    return mwd.select("month_commencing", "working_days")


def _per_day(df: DataFrame, mwd: DataFrame) -> DataFrame:
    j = left_join(df, _wd(mwd), ["month_commencing"], broadcast=True)
    return j.withColumn("activity", ratio("activity", "working_days")).drop("working_days")


def history_per_provider_month(history: DataFrame, acutes: DataFrame, mwd: DataFrame) -> DataFrame:
    """The history's provider-month totals with their working days (input of D33 and D11)."""
    return left_join(_no_spec(history, acutes), _wd(mwd), ["month_commencing"], broadcast=True)


def march_counterfactual(history: DataFrame, acutes: DataFrame, mwd: DataFrame, params: Params) -> DataFrame:
    """Per-working-day activity of the history's February and March rows,
    summed per provider and STP and divided by ``march_divisor``, dated on the
    excluded March."""
    h = history_per_provider_month(history, acutes, mwd)
    h = h.withColumn("wd_adjusted", ratio("activity", "working_days"))
    h = h.groupBy("der_provider_code", "stp_code").agg(strict_sum("wd_adjusted").alias("activity"))
    return h.select(
        F.lit(params.march_counterfactual_date).alias("month_commencing"),
        "der_provider_code",
        "stp_code",
        (F.col("activity") / F.lit(params.march_divisor)).alias("activity"),
    )


def per_day_long_v1(rows: DataFrame, params: Params) -> DataFrame:
    """D34 in long form: the distinct rows with the wide form's variance appended as a
    period of its own, and the date of the actual year's month that each belongs to."""
    variance = v1_wide(rows, params).select(
        "fin_month", "month", "provider", "icb", F.col("variance").alias("activity"), F.lit("variance").alias("period")
    )
    return union_distinct(rows, variance).withColumn(
        "month_of_actual", month_of_fin_month(F.col("fin_month"), params.actual_fy_start_year)
    )


def v1_wide(rows: DataFrame, params: Params) -> DataFrame:
    """The rows with a column for each period; ``variance = actual - ambition``."""
    label = params.v2_target_label
    wide = pivot_strict(rows, ["fin_month", "month", "provider", "icb"], "period", ["baseline", "actual", label], "activity")
    return wide.withColumn("variance", F.col("actual") - F.col(label))


def per_day_rows_v1(
    baseline_excl_march: DataFrame,
    march_cf: DataFrame,
    actuals: DataFrame,
    tables: Tables,
    cal: DataFrame,
    mwd: DataFrame,
    params: Params,
) -> DataFrame:
    """The stacked rows of D34: activity per working day by month label, provider, system and period.

    The provider lookup is matched on the code alone (this method predates the
    composite lookup); each row keeps its own STP.
    """
    label = params.v2_target_label
    base = union_distinct(_per_day(_no_spec(baseline_excl_march, tables.acutes), mwd), march_cf)
    amb = base.withColumn("activity", F.col("activity") * F.lit(params.target_factor)).withColumn("period", F.lit(label))
    base = base.withColumn("period", F.lit("baseline"))
    act = _per_day(_no_spec(actuals, tables.acutes), mwd).withColumn("period", F.lit("actual"))
    rows = union_distinct(union_distinct(base, act), amb)
    rows = attach_calendar(rows, "month_commencing", cal, ["month_name_short", "fin_month"])
    pl = tables.provider_lookup.select("provider_code", "provider_short_name")
    rows = left_join(rows, pl, {"der_provider_code": "provider_code"})
    sl = tables.system_lookup.select("stp_code", "short_name")
    rows = left_join(rows, sl, ["stp_code"])
    return rows.select(
        "fin_month",
        F.col("month_name_short").alias("month"),
        F.col("provider_short_name").alias("provider"),
        F.col("short_name").alias("icb"),
        "activity",
        "period",
    )


def specialty_split_v1(actuals: DataFrame, tables: Tables, mwd: DataFrame, params: Params) -> DataFrame:
    """Each specialty's share of the per-day reduction by month (one column
    per month of the actual year), the row total (NULL/NaN skipped) and its
    average over ``v1_year_divisor`` months, both rounded to 1 decimal."""
    acute = only_acutes(actuals, tables.acutes)
    totals = left_join(_no_spec(actuals, tables.acutes), _wd(mwd), ["month_commencing"], broadcast=True)
    totals = totals.withColumnRenamed("activity", "total_activity")
    p = left_join(acute, totals, ["month_commencing", "der_provider_code", "stp_code"])
    pl = tables.provider_lookup.select("provider_code", "provider_short_name")
    p = left_join(p, pl, {"der_provider_code": "provider_code"})
    sl = tables.system_lookup.select("stp_code", "short_name")
    p = left_join(p, sl, ["stp_code"])
    wd_total = ratio("total_activity", "working_days")
    amb = wd_total * F.lit(params.target_factor)
    prop = ratio("activity", "total_activity")
    p = p.select(
        F.col("short_name").alias("icb"),
        F.col("provider_short_name").alias("provider"),
        "treatment_function",
        listed("month_commencing", params.actual_fy_months()).alias("month_commencing"),
        round_half_even((wd_total - amb) * prop, 1).alias("reduction_per_day"),
    )
    months = params.actual_fy_months()
    month_cols = [str(m) for m in months]
    wide = pivot_strict(p, ["icb", "provider", "treatment_function"], "month_commencing", months, "reduction_per_day",
                        month_cols)
    total = None
    for m in month_cols:
        v = F.when(F.col(f"`{m}`").isNull() | F.isnan(F.col(f"`{m}`")), F.lit(0.0)).otherwise(F.col(f"`{m}`"))
        total = v if total is None else total + v
    wide = wide.withColumn("total", total)
    return wide.withColumn("average_needed", round_half_even(F.col("total") / F.lit(params.v1_year_divisor), 1))
