"""Specialty shares, the cohort of larger specialties and their fair share.

All inputs are provider x specialty x month rows.  Group totals that the
reference gets by joining a table to its own aggregate are window sums here
(one shuffle on the group key instead of an aggregate plus a join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import left_join, ratio, round_half_even, strict_sum, strict_sum_over
from ..params import Params
from .calendar import attach_calendar, year_working_days
from .gap import months_wide, only_acutes


def specialty_share(actuals: DataFrame, acutes: DataFrame, cal: DataFrame) -> DataFrame:
    """Each acute specialty row as a share of its provider-month total."""
    a = only_acutes(actuals, acutes)
    w = Window.partitionBy("month_commencing", "der_provider_code")
    a = a.select(
        "month_commencing",
        "treatment_function_code",
        "treatment_function",
        "der_provider_code",
        "stp_code",
        F.col("activity").alias("speciality_activity"),
        strict_sum_over("activity", w).alias("total_activity"),
    )
    a = attach_calendar(a, "month_commencing", cal, ["month_name_short", "fin_month"])
    return a.select(
        "month_name_short",
        "fin_month",
        "stp_code",
        F.col("der_provider_code").alias("provider_code"),
        "treatment_function_code",
        "treatment_function",
        "speciality_activity",
        "total_activity",
        ratio("speciality_activity", "total_activity").alias("proportion_of_total"),
    )


def specialty_gap(
    share: DataFrame, gap: DataFrame, provider_lookup: DataFrame, system_lookup: DataFrame, target_label: str = "target"
) -> DataFrame:
    """The monthly gap columns on each specialty row, then names.

    The provider name comes from a composite (code, STP) lookup, so a row whose
    STP differs from the lookup's gets a NULL provider.
    """
    g = gap.select("month_name_short", "fin_month", "provider_code", "baseline", "actual", target_label, "variance")
    s = left_join(share, g, ["month_name_short", "fin_month", "provider_code"])
    pl = provider_lookup.select("provider_code", "stp_code", "provider_short_name")
    s = left_join(s, pl, ["provider_code", "stp_code"])
    sl = system_lookup.select("stp_code", "short_name")
    s = left_join(s, sl, ["stp_code"])
    return s.select(
        "month_name_short",
        "fin_month",
        F.col("short_name").alias("icb"),
        F.col("provider_short_name").alias("provider"),
        "treatment_function_code",
        "treatment_function",
        "speciality_activity",
        "total_activity",
        "baseline",
        target_label,
        "variance",
        "proportion_of_total",
    )


def cohort_flags(spec_gap: DataFrame, params: Params, *, by_icb: bool = True) -> DataFrame:
    """D21 on every specialty row, in one pass over the rows (window aggregates).

    Adds the group's yearly activity (by icb, provider, TFC; by provider, TFC
    without icb), the provider total over distinct (month, provider, total)
    rows, the row tally per (provider, TFC), the share and the monthly average,
    ``in_cohort`` (the row's group passes) and ``pair_in_cohort`` (some group
    with the row's (provider, TFC) passes: the reference's semi join on the
    pair).  The rows are read once instead of once per aggregate.
    """
    keys = ["icb", "provider", "treatment_function_code"] if by_icb else ["provider", "treatment_function_code"]
    pair = Window.partitionBy("provider", "treatment_function_code")
    one_per_total = Window.partitionBy("month_name_short", "provider", "total_activity").orderBy("treatment_function_code")
    per_provider = Window.partitionBy("provider")
    # Every window here (and the cohort-row window and yearly sums after it) is keyed by a
    # superset of the provider: one exchange by provider serves them all.  A provider has at
    # most months x specialties rows, so even a hot provider is a small task.
    # Columns are added a layer at a time: each step analyses the plan below it once more.
    f = spec_gap.repartition("provider").withColumns(
        {
            "_spec_year": strict_sum_over("speciality_activity", Window.partitionBy(*keys)),
            "_tally": F.count(F.lit(1)).over(pair),
            "_first": F.row_number().over(one_per_total) == 1,
        }
    )
    firsts = F.count(F.when(F.col("_first"), F.lit(1))).over(per_provider)
    first_totals = F.when(F.col("_first"), F.col("total_activity"))
    total = F.when(F.count(first_totals).over(per_provider) == firsts, F.sum(first_totals).over(per_provider))
    f = f.withColumn("_prov_total", total)
    share, average = ratio("_spec_year", "_prov_total"), ratio("_spec_year", "_tally")
    passes = (F.col("_tally") > params.min_month_tally) & ((share >= params.min_share) | (average >= params.min_avg_monthly))
    f = f.withColumns({"_share": share, "_avg": average, "in_cohort": F.coalesce(passes, F.lit(False))})
    return f.withColumn("pair_in_cohort", F.max(F.col("in_cohort").cast("int")).over(pair) == 1)


def cohort(spec_gap: DataFrame, params: Params, *, by_icb: bool = True, flags: DataFrame | None = None) -> DataFrame:
    """Specialties reported in more than ``min_month_tally`` rows and either
    at least ``min_share`` of the provider's activity or ``min_avg_monthly`` a month.

    The tally counts rows (a provider code spanning two STPs counts twice),
    the provider total sums distinct (month, provider, total) rows.
    """
    keys = ["icb", "provider", "treatment_function_code"] if by_icb else ["provider", "treatment_function_code"]
    f = flags if flags is not None else cohort_flags(spec_gap, params, by_icb=by_icb)
    return f.where(F.col("in_cohort")).select(
        *keys,
        F.col("_spec_year").alias("speciality_activity"),
        F.col("_prov_total").alias("total_activity"),
        F.col("_share").alias("proportion_of_activity"),
        F.col("_tally").alias("month_tally"),
        F.col("_avg").alias("avg_monthly_activity"),
    ).distinct()


def cohort_members(flags: DataFrame) -> DataFrame:
    """Specialty rows whose (provider, TFC) pair is in the cohort (NULL matches NULL)."""
    return flags.where(F.col("pair_in_cohort")).drop(
        "_spec_year", "_tally", "_first", "_prov_total", "_share", "_avg", "in_cohort", "pair_in_cohort"
    )


def cohort_rows(flags: DataFrame) -> DataFrame:
    """Cohort rows with the cohort's monthly total, share and monthly reduction."""
    rows = cohort_members(flags)
    w = Window.partitionBy("month_name_short", "fin_month", "icb", "provider")
    rows = rows.withColumn("cohort_activity", strict_sum_over("speciality_activity", w))
    proportion = ratio("speciality_activity", "cohort_activity")
    return rows.withColumns({"cohort_proportion": proportion, "monthly_reduction": F.col("variance") * proportion})


def cohort_coverage(coh: DataFrame, *, by_icb: bool = True) -> DataFrame:
    """Share of each provider's activity that its cohort covers."""
    keys = ["icb", "provider"] if by_icb else ["provider"]
    return coh.groupBy(*keys).agg(strict_sum("proportion_of_activity").alias("cohort_activity"))


def cohort_monthly_per_day(rows: DataFrame, mwd: DataFrame, target_fy: str, target_label: str = "target") -> DataFrame:
    """Per-working-day activity and variance of each cohort row, and its share."""
    r = left_join(rows, year_working_days(mwd, target_fy, "wd_target"), ["month_name_short"], broadcast=True)
    variance_per_wd = ratio("variance", "wd_target")
    return r.select(
        "icb",
        "provider",
        "month_name_short",
        "treatment_function_code",
        "treatment_function",
        "total_activity",
        "baseline",
        target_label,
        "variance",
        variance_per_wd.alias("variance_per_wd"),
        "cohort_activity",
        "cohort_proportion",
        "monthly_reduction",
        "wd_target",
        "speciality_activity",
        ratio("speciality_activity", "wd_target").alias("activity_per_wd"),
        (variance_per_wd * F.col("cohort_proportion")).alias("wd_variance_by_spec"),
    )


def _yearly(rows: DataFrame, scalars: DataFrame, target_label: str) -> DataFrame:
    keys = ["icb", "provider", "treatment_function_code", "treatment_function"]
    sums = ["total_activity", "baseline", target_label, "variance", "cohort_activity", "speciality_activity"]
    y = rows.groupBy(*keys).agg(*[strict_sum(c).alias(c) for c in sums])
    # one row of scalars (months and working days of the target year)
    return y.crossJoin(F.broadcast(scalars))


def fair_share(rows: DataFrame, scalars: DataFrame, target_label: str = "target", *, rounded: bool = True) -> DataFrame:
    """Each cohort specialty's yearly share of the provider's reduction.

    Averages divide by the number of target-year months and its working days;
    variance and cohort activity are summed only over months the specialty
    reported.  The four measures are rounded to 1 decimal (half-even).
    """
    y = _yearly(rows, scalars, target_label)
    cp = ratio("speciality_activity", "cohort_activity")
    measures = {
        "avg_monthly_activity": ratio("speciality_activity", "month_count"),
        "share_of_monthly_variance": ratio("variance", "month_count") * cp,
        "avg_activity_per_wd": ratio("speciality_activity", "total_wd"),
        "share_of_daily_variance": ratio("variance", "total_wd") * cp,
    }
    if rounded:
        measures = {name: round_half_even(m, 1) for name, m in measures.items()}
    return y.select("icb", "provider", "treatment_function", *[m.alias(name) for name, m in measures.items()])


def fair_share_v2(rows: DataFrame, scalars: DataFrame, target_label: str = "ambition") -> DataFrame:
    """D36 (v2 form of D25): per-working-day measures only, unrounded."""
    y = _yearly(rows, scalars, target_label)
    return y.select(
        "icb",
        "provider",
        "treatment_function",
        ratio("speciality_activity", "total_wd").alias("avg_activity_per_wd"),
        (ratio("variance", "total_wd") * ratio("speciality_activity", "cohort_activity")).alias("avg_variance_from_ambition"),
    )


def specialty_gap_per_day_wide(monthly: DataFrame) -> DataFrame:
    """Each cohort specialty's daily share of the variance, one column per month."""
    return months_wide(monthly, ["icb", "provider", "treatment_function"], "wd_variance_by_spec")
