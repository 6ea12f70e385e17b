"""Report tables and report scopes.

The reference renders one HTML report per system (plus one for the region)
and one per acute trust in a driver loop.  Here each report table carries a
``report`` column and all copies are produced by one job, written partitioned
by it (see ``sinks``); no loop over reports runs on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import percent_text
from ..functions.semantics import ratio, round_half_even, strict_sum, strict_sum_over
from ..functions.text import title_case_nhs
from ..params import Params


def chart_feed(enriched: DataFrame, target_label: str = "target") -> DataFrame:
    """Baseline, actual and target rows by month of the actual year and provider."""
    return enriched.where(F.col("period").isin("baseline", "actual", target_label)).select(
        "icb", "provider", "month_of_actual", "period", "activity"
    )


def gap_table(gap_by_year: DataFrame, target_label: str = "target") -> DataFrame:
    """Yearly gap rounded to whole numbers, percentage text and a RAG flag.

    The flag compares the unrounded values: red when actual is above the
    baseline, highlight when equal, green when below, NULL if either is missing.
    """
    a, b = F.col("actual"), F.col("baseline")
    rag = F.when(a > b, F.lit("red")).when(a == b, F.lit("highlight")).when(a < b, F.lit("green"))
    return gap_by_year.select(
        "icb",
        "provider",
        round_half_even("baseline", 0).alias("baseline"),
        round_half_even("actual", 0).alias("actual"),
        round_half_even(target_label, 0).alias(target_label),
        round_half_even("variance", 0).alias("variance"),
        percent_text("percent_vs_actual").alias("percent_vs_actual"),
        rag.alias("rag"),
    )


def coverage_table(coverage: DataFrame) -> DataFrame:
    """Share of each provider's activity inside its cohort, as percentage text."""
    keys = [c for c in ("icb", "provider") if c in coverage.columns]
    return coverage.select(*keys, percent_text("cohort_activity").alias("percentage_represented"))


MEASURES = (
    ("avg_monthly_activity", "average_monthly_activity"),
    ("share_of_monthly_variance", "share_of_monthly_reduction"),
    ("avg_activity_per_wd", "average_daily_activity"),
    ("share_of_daily_variance", "share_of_daily_reduction"),
)


def specialty_table(fair: DataFrame) -> DataFrame:
    """Per provider, the fair-share rows rounded to whole numbers, each row's
    share of the monthly reduction (W3) and a 'Total' row (strict sums, A11).

    Rows stay as they are, also where several share a description (the fair
    share is per code, and unmatched codes have none); each provider's total is
    added to them.  Rows without a provider name are left out, as the per-trust
    filter does.
    """
    f = fair.where(F.col("provider").isNotNull()).select(
        "icb", "provider", "treatment_function", *[round_half_even(a, 0).alias(b) for a, b in MEASURES]
    )
    w = Window.partitionBy("icb", "provider")
    f = f.withColumn(
        "proportion_contributed",
        ratio("share_of_monthly_reduction", strict_sum_over("share_of_monthly_reduction", w)),
    )
    nums = [b for _, b in MEASURES] + ["proportion_contributed"]
    rows = f.select("icb", "provider", "treatment_function", *nums, F.lit("row").alias("row_kind"))
    totals = f.groupBy("icb", "provider").agg(
        F.lit("Total").alias("treatment_function"),
        *[strict_sum(c).alias(c) for c in nums],
        F.lit("total").alias("row_kind"),
    )
    return rows.unionByName(totals).withColumn("proportion_text", percent_text("proportion_contributed"))


def report_scope(system_lookup: DataFrame, provider_lookup: DataFrame, acutes: DataFrame, params: Params) -> DataFrame:
    """One row per report: each system except the excluded one, the region, each acute trust."""
    systems = system_lookup.where(F.col("short_name") != params.excluded_system).select(
        F.lit("system").alias("report_level"),
        F.col("short_name").alias("report"),
        title_case_nhs("stp_name").alias("title"),
    )
    region = systems.sparkSession.range(1).select(
        F.lit("region").alias("report_level"),
        F.lit(params.region_report_name).alias("report"),
        F.lit(params.region_report_title).alias("title"),
    )
    a = acutes.select(F.col("provider_code").alias("_acute"))
    trusts = provider_lookup.join(a, provider_lookup.provider_code == a._acute, "left_semi").select(
        F.lit("trust").alias("report_level"),
        F.col("provider_short_name").alias("report"),
        F.col("acute_full_name").alias("title"),
    )
    return systems.unionByName(region).unionByName(trusts)


def scope_filter(table: DataFrame, level: str, value: str | None, params: Params) -> DataFrame:
    """the rows of one report: a system (``icb``), a trust (``provider``), or
    everything for the region report.  Equality drops NULL names, as the
    reference's ``filter`` does."""
    if level == "region" or (level == "system" and value == params.region_report_name):
        return table
    col = {"system": "icb", "trust": "provider"}[level]
    return table.where(F.col(col) == value)


def system_feed(table: DataFrame, scope: DataFrame, params: Params) -> DataFrame:
    """D42 (K2): one copy of ``table`` per system report plus the whole table for the region.

    The table is planned once: each row is labelled with its system's report, if it has one, and the region's.
    """
    s = scope.where(F.col("report_level") == "system").select(F.col("report").alias("_sys")).distinct()
    reports = F.array_compact(F.array("_sys", F.lit(params.region_report_name)))
    return table.join(s, table.icb == s._sys, "left").withColumn("report", F.explode(reports)).drop("_sys")


def trust_feed(table: DataFrame, scope: DataFrame) -> DataFrame:
    """D42 (K3): the rows of each acute trust, labelled with the trust's report."""
    t = scope.where(F.col("report_level") == "trust").select(F.col("report").alias("_trust")).distinct()
    return table.join(t, table.provider == t._trust, "inner").withColumnRenamed("_trust", "report")
