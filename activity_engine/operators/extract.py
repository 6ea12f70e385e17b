"""Extracts from the attendance fact (the reference's T-SQL, D3-D10).

These are the only operators that touch attendance-level rows.  Each is one
scan of the fact with its predicates written on raw columns (so Catalyst
pushes them below the joins and, where the column is stored, into the Parquet
scan), joins to the small reference tables, and a hash aggregate
with map-side partial aggregation.  SQL semantics: plain ``=`` joins and
three-valued ``NOT IN`` (a NULL code fails it).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_text_first_of_month, first_of_month, yyyymm_to_iso
from ..functions.text import provider_code
from ..params import Params
from ..sources.tables import Scope, Tables, fin_year_dates


def normalise_provider(attendance: DataFrame, params: Params) -> DataFrame:
    """D3: each raw provider code with its reported code and its hierarchy key.

    The two rule lists differ (the select list has one more prefix rule), so a
    remapped code can still join the hierarchy under its original key.
    """
    raw = attendance.select("der_provider_code").distinct()
    return raw.select(
        F.col("der_provider_code").alias("raw_provider_code"),
        provider_code("der_provider_code", params.select_rules).alias("provider_code"),
        provider_code("der_provider_code", params.select_rules, else_len=3).alias("provider_code_3"),
        provider_code("der_provider_code", params.join_rules).alias("hierarchy_key"),
    )


def _scope(att: DataFrame, params: Params, fys: Sequence[str]) -> DataFrame:
    c = F.col
    return att.where(
        c("first_attendance").isin("2", "4")
        & c("attendance_status").isin("5", "6")
        & c("der_financial_year").isin(*fys)
        & ~c("treatment_function_code").isin(*params.excluded_tfc)
        & (c("administrative_category") == "01")
        & c("core_hrg").startswith("WF")
        & c("der_provider_code").startswith("R")
    )


def extract_activity(
    tables: Tables,
    params: Params,
    fys: Sequence[str] | None = None,
    *,
    provider_len: int | None = None,
    extra_filter=None,
) -> DataFrame:
    """Follow-up attendances without procedure counted by month, TFC, provider, STP.

    ``provider_len=3`` gives the three-year variant (D5), whose ELSE branch
    keeps 3 characters; it groups by the select expression.  ``extra_filter``
    is a predicate on raw attendance columns (D6, D7).
    """
    fys = list(fys or [params.actual_fy])
    raw = Scope(fin_year_dates(fys), ("2", "4"), ("5", "6"), "01")
    att = _scope(tables.fact("attendance", raw), params, fys)
    if extra_filter is not None:
        att = att.where(extra_filter)
    att = att.select(
        first_of_month("appointment_date").alias("month_commencing"),
        "treatment_function_code",
        provider_code("der_provider_code", params.select_rules, else_len=provider_len).alias("der_provider_code"),
        provider_code("der_provider_code", params.join_rules).alias("_hier_key"),
    )
    tfc = tables.tfc_ref.select(
        F.col("treatment_function_code").alias("_tfc_code"),
        F.expr("substring(treatment_function_desc, 5)").alias("treatment_function"),
    )
    hier = tables.provider_hierarchy.where(F.col("region_code") == params.region_code).select(
        F.col("organisation_code").alias("_org"), "stp_code"
    )
    # The WHERE on the hierarchy's region makes the outer join an inner one.
    joined = att.join(tfc, att.treatment_function_code == tfc._tfc_code, "left").join(
        hier, F.col("_hier_key") == hier._org, "inner"
    )
    return joined.groupBy(
        "month_commencing", "treatment_function_code", "treatment_function", "der_provider_code", "stp_code"
    ).agg(F.count(F.lit(1)).alias("activity"))


@dataclass(frozen=True)
class ExtractScope:
    """One extract of several made together: its years, months and form of the provider code."""

    years: tuple[str, ...]
    months: Callable[[Column], Column] | None = None  # condition on der_activity_month
    provider_len: int | None = None

    def holds(self) -> Column:
        inside = F.col("der_financial_year").isin(*self.years)
        return inside & self.months(F.col("der_activity_month")) if self.months else inside


def extract_scopes(params: Params) -> dict[str, ExtractScope]:
    """The four activity extracts (D4-D7) by name."""
    return {
        "actual": ExtractScope((params.actual_fy,)),
        "three_years": ExtractScope(params.three_year_fys, provider_len=3),
        "excl_march": ExtractScope((params.baseline_fy,), lambda m: ~m.isin(params.excluded_month)),
        "history": ExtractScope(params.history_fys, lambda m: F.substring(m, -2, 2).isin("02", "03")),
    }


EXTRACT_KEYS = ("month_commencing", "treatment_function_code", "treatment_function", "der_provider_code", "stp_code")


def extract_together(tables: Tables, params: Params, scopes: dict[str, ExtractScope]) -> DataFrame:
    """D4-D7 in one pass: the rows of several extracts with the ``scope`` that each belongs to.

    The fact is scanned once over all the scopes' years. One hash aggregate counts
    an attendance under every scope that holds it; the small result is turned into
    a row for each scope. A plan that takes several scopes from this frame shares
    the aggregate's exchange, as the scope is told only after it.
    """
    years = sorted({y for s in scopes.values() for y in s.years})
    raw = Scope(fin_year_dates(years), ("2", "4"), ("5", "6"), "01")
    att = _scope(tables.fact("attendance", raw), params, years)
    att = att.where(reduce(or_, [s.holds() for s in scopes.values()]))
    forms = sorted({s.provider_len or 0 for s in scopes.values()})
    code = {n: f"_code_{n}" for n in forms}
    att = att.select(
        first_of_month("appointment_date").alias("month_commencing"),
        "treatment_function_code",
        *[provider_code("der_provider_code", params.select_rules, else_len=n or None).alias(code[n]) for n in forms],
        provider_code("der_provider_code", params.join_rules).alias("_hier_key"),
        *[F.when(s.holds(), F.lit(1)).alias(f"_in_{name}") for name, s in scopes.items()],
    )
    tfc = tables.tfc_ref.select(
        F.col("treatment_function_code").alias("_tfc_code"),
        F.expr("substring(treatment_function_desc, 5)").alias("treatment_function"),
    )
    hier = tables.provider_hierarchy.where(F.col("region_code") == params.region_code).select(
        F.col("organisation_code").alias("_org"), "stp_code"
    )
    joined = att.join(tfc, att.treatment_function_code == tfc._tfc_code, "left").join(
        hier, F.col("_hier_key") == hier._org, "inner"
    )
    counted = joined.groupBy("month_commencing", "treatment_function_code", "treatment_function", *code.values(), "stp_code").agg(
        *[F.count(f"_in_{name}").alias(f"_n_{name}") for name in scopes]
    )
    each = F.array(
        *[
            F.struct(F.lit(name).alias("scope"), F.col(code[s.provider_len or 0]).alias("der_provider_code"), F.col(f"_n_{name}").alias("activity"))
            for name, s in scopes.items()
        ]
    )
    rows = counted.select("month_commencing", "treatment_function_code", "treatment_function", "stp_code", F.explode(each).alias("x"))
    rows = rows.where(F.col("x.activity") > 0).select("x.scope", *EXTRACT_KEYS[:3], "x.der_provider_code", "stp_code", "x.activity")
    if len(forms) > 1:  # rows of one short code under several long ones
        rows = rows.groupBy("scope", *EXTRACT_KEYS).agg(F.sum("activity").alias("activity"))
    return rows


def one_scope(together: DataFrame, scope: str) -> DataFrame:
    """One extract out of several made together."""
    return together.where(F.col("scope") == scope).select(*EXTRACT_KEYS, "activity")


def scope_years(spark: SparkSession, scopes: dict[str, ExtractScope]) -> DataFrame:
    """The years of each scope as a lookup table: a few rows."""
    rows = [(name, year) for name, s in scopes.items() for year in s.years]
    return spark.createDataFrame(rows, "scope string, scope_year string")


def attendances_by_scope(tables: Tables, years: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Attendances of the wanted scopes by year and attendance type, their years coming from a lookup table.

    On a fact partitioned by financial year the join prunes partitions at run time:
    only the years that the lookup has for these scopes are read, whoever maintains it.
    """
    years = years.where(F.col("scope").isin(*scopes))
    att = tables.attendance.select("der_financial_year", "der_activity_month", "first_attendance", "der_provider_code")
    j = att.join(F.broadcast(years), att.der_financial_year == years.scope_year)  # a few rows for each scope
    return j.groupBy("scope", "der_financial_year", "first_attendance").agg(
        F.count(F.lit(1)).alias("attendances"),
        F.countDistinct("der_activity_month").alias("months"),
        F.countDistinct("der_provider_code").alias("providers"),
    )


def extract_activity_3y(tables: Tables, params: Params) -> DataFrame:
    """Three financial years, provider codes cut to 3 characters."""
    return extract_activity(tables, params, params.three_year_fys, provider_len=3)


def extract_baseline_excl_march(tables: Tables, params: Params) -> DataFrame:
    """Baseline year without the excluded month."""
    return extract_activity(
        tables, params, [params.baseline_fy], extra_filter=~F.col("der_activity_month").isin(params.excluded_month)
    )


def extract_march_history(tables: Tables, params: Params) -> DataFrame:
    """February and March of the history years."""
    return extract_activity(
        tables,
        params,
        params.history_fys,
        extra_filter=F.substring(F.col("der_activity_month"), -2, 2).isin("02", "03"),
    )


def planning_baseline(tables: Tables, params: Params) -> DataFrame:
    """Monthly baseline values of the region's providers from the planning table."""
    # planning labels a year by its second calendar year
    years = fin_year_dates([str(int(params.planning_dimfyear) - 1)])
    p = tables.fact("planning", Scope(years))
    return p.where(
        (F.col("planningref") == params.planning_ref)
        & (F.col("regioncode") == params.region_code)
        & F.col("sourcetype").isNull()
        & F.col("dimfyear").isin(params.planning_dimfyear)
        & (F.col("orgtype") == params.planning_orgtype)
    ).select("orgcode", "orgtype", F.col("dimdatestart").alias("month_commencing"), "value")


def hrg_series_baseline(tables: Tables, params: Params) -> DataFrame:
    """Follow-up WF activity of the acute providers in a month range (no aggregation)."""
    after = int(params.hrg_month_to[:4]) * 12 + int(params.hrg_month_to[4:])  # months up to the range's end
    dates = (dt.date(int(params.hrg_month_from[:4]), int(params.hrg_month_from[4:]), 1), dt.date(after // 12, after % 12 + 1, 1))
    h = tables.fact("hrg_time_series", Scope((dates,), ("2", "4")))
    acutes = tables.acutes.select(F.col("provider_code").alias("_acute"))
    h = h.where(
        (F.col("activity_type") == "OPA")
        & (F.col("der_appointment_type") == "FUp")
        & F.col("hrg").startswith("WF")
        & F.col("der_activity_month").between(params.hrg_month_from, params.hrg_month_to)
    )
    h = h.join(acutes, h.provider_or_is_ccg_code_a == acutes._acute, "left_semi")
    return h.select(
        yyyymm_to_iso("der_activity_month").alias("month_commencing"),
        F.col("provider_or_is_ccg_code_a").alias("provider_code"),
        "stp_ics",
        "centralised_nhse_commissioned",
        "tfc",
        "activity",
    )


def _tracking_case(code, params: Params, value_of) -> F.Column:
    expr = None
    for codes, target, name in params.tracking_merges:
        v = value_of(target, name)
        expr = F.when(code.isin(*codes), v) if expr is None else expr.when(code.isin(*codes), v)
    return expr


def follow_up_tracking(tables: Tables, params: Params, *, rolled: bool = False) -> DataFrame:
    """Monthly follow-up tracking rows with scope, type and procedure flags.

    Grouped, like the source, by the raw status, attendance type, procedure
    count and cost HRG, so rows that look the same can repeat.  ``rolled``
    re-aggregates over the visible columns.  The cost join is the only
    fact-to-fact join in the engine: a shuffle join on ``tables.cost_key``, or a
    join of buckets without an exchange on the prepared layout.
    """
    c = F.col
    years = fin_year_dates(params.tracking_fys)
    att = tables.fact("attendance", Scope(years, ("1", "2", "3", "4"), ("5", "6"), "01")).where(
        (c("administrative_category") == "01")
        & c("attendance_status").isin("5", "6")
        & c("first_attendance").isin("1", "2", "3", "4")
        & (c("treatment_function_code") != "812")
        & c("der_financial_year").isin(*params.tracking_fys)
        & ~c("der_activity_month").isin(params.excluded_month)
        & c("der_provider_code").like("R%")
    )
    code = c("der_provider_code")
    att = att.select(
        *dict.fromkeys(("opa_ident", "der_financial_year", *tables.cost_key)),
        "der_provider_code",
        "treatment_function_code",
        "attendance_status",
        "first_attendance",
        "der_number_procedure",
        date_text_first_of_month("appointment_date").alias("activity_month_year"),
        provider_code(code, (), exact_rules=params.tracking_key_exact, r_prefix_len=3).alias("_hier_key"),
    )
    # the join needs equal years, so only the tracking years of the cost table can match
    ident, year = tables.cost_key
    cost = tables.fact("attendance_cost", Scope(years)).where(c("der_financial_year").isin(*params.tracking_fys)).select(
        c(ident).alias("_c_ident"), c(year).alias("_c_fy"), "hrg_code_other"
    )
    hier = tables.provider_hierarchy.where(c("region_code") == params.tracking_region_code).select(
        c("organisation_code").alias("_org"), "organisation_name", "stp_code", "stp_name"
    )
    j = att.join(cost, (c(ident) == cost._c_ident) & (c(year) == cost._c_fy), "left")
    # tfc_ref is joined in the source but none of its columns is used; it is unique per code
    j = j.join(hier, j._hier_key == hier._org, "inner")
    mapped_code = _tracking_case(code, params, lambda t, n: F.lit(t)).otherwise(code)
    mapped_name = _tracking_case(code, params, lambda t, n: F.lit(n)).otherwise(c("organisation_name"))
    grouped = j.groupBy(
        "activity_month_year",
        "der_financial_year",
        mapped_code.alias("provider_org_code_mapped"),
        mapped_name.alias("provider_name_mapped"),
        "treatment_function_code",
        "attendance_status",
        "first_attendance",
        "der_number_procedure",
        "hrg_code_other",
        "stp_code",
        "stp_name",
    ).agg(F.count("opa_ident").alias("appointments"))
    seen = c("attendance_status").isin("5", "6")
    out = grouped.select(
        "activity_month_year",
        F.when(c("der_financial_year") == params.baseline_fy, F.lit("Y")).otherwise(F.lit("N")).alias("is_baseline"),
        "provider_org_code_mapped",
        c("stp_code").alias("ics_code"),
        c("stp_name").alias("ics_name"),
        "provider_name_mapped",
        c("treatment_function_code").alias("tfc"),
        F.when(~c("treatment_function_code").isin(*params.excluded_tfc), F.lit("Y")).otherwise(F.lit("N")).alias("tfc_scope"),
        F.when(seen & c("first_attendance").isin("1", "2"), F.lit("F2F")).otherwise(F.lit("NF2F")).alias("appointment_type"),
        F.when(seen & c("first_attendance").isin("1", "3"), F.lit("First")).otherwise(F.lit("Follow_Up")).alias("attendance_type"),
        F.when(c("der_number_procedure") > 0, F.lit("Procedure")).otherwise(F.lit("No_Procedure")).alias("procedure"),
        F.when(c("hrg_code_other").like("WF%"), F.lit("Y")).otherwise(F.lit("N")).alias("wf_flag"),
        "appointments",
    )
    if rolled:
        keys = [x for x in out.columns if x != "appointments"]
        out = out.groupBy(*keys).agg(F.sum("appointments").alias("appointments"))
    return out


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[x.lower() for x in df.columns])


SQL_HEADERS = ("Month_commencing", "Treatment_Function_Code", "Treatment_Function", "Der_Provider_Code", "STP_Code", "Activity")


def with_sql_headers(extract: DataFrame) -> DataFrame:
    """The extract as the database returns it (mixed-case headers of the CSV files)."""
    return extract.toDF(*SQL_HEADERS)
