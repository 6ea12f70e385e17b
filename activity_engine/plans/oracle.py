"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the reference's own SQL and its R steps, not from the Spark
code: T-SQL style CASE expressions, ``IS NOT DISTINCT FROM`` for the R-side
joins, conditional aggregation for pivots.  Each query is one statement: a
``WITH`` list holding only the CTEs it needs (dependencies resolved here),
then a final SELECT that rounds doubles to 6 decimals like ``finalize``.
"""

from __future__ import annotations

import datetime as dt

from ..params import FIN_MONTHS, Params, test_params
from ..sources import testmap as tm


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def fy_start(d: str) -> str:
    return f"(CASE WHEN month({d}) >= 4 THEN year({d}) ELSE year({d}) - 1 END)"


def fy_label(d: str, sep: str) -> str:
    y = fy_start(d)
    return f"(CAST({y} AS VARCHAR) || {q(sep)} || substr(CAST({y} + 1 AS VARCHAR), 3, 2))"


def fin_month(d: str) -> str:
    return f"CAST(CASE WHEN month({d}) <= 3 THEN month({d}) + 9 ELSE month({d}) - 3 END AS INTEGER)"


def first_of_month(d: str) -> str:
    return f"CAST(date_trunc('month', {d}) AS DATE)"


def nn(k: str) -> str:
    return f"lpad(CAST({k} AS VARCHAR), 2, '0')"


def strict(x: str) -> str:
    return f"(CASE WHEN count({x}) = count(*) THEN sum({x}) END)"


def narm(x: str) -> str:
    return f"coalesce(sum(CASE WHEN NOT isnan({x}) THEN {x} END), 0.0)"


def pv(col: str, value: str, x: str) -> str:
    """Strict-sum pivot cell for ``col = value``."""
    hit = f"{col} = {q(value)}"
    return (
        f"(CASE WHEN count(CASE WHEN {hit} THEN 1 END) = count(CASE WHEN {hit} THEN {x} END) "
        f"THEN sum(CASE WHEN {hit} THEN {x} END) END)"
    )


def case_map(col: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in pairs) + " END"


def provider_case(code: str, rules, else_len: int | None = None) -> str:
    parts = [f"WHEN right({code}, 2) = '00' THEN left({code}, 3)"]
    parts += [f"WHEN left({code}, 3) = {q(a)} THEN {q(b)}" for a, b in rules]
    other = f"left({code}, {else_len})" if else_len else code
    return "CASE " + " ".join(parts) + f" ELSE {other} END"


def re(x: str, digits: int) -> str:
    """Half-even rounding of a double (R ``round``)."""
    return f"round_even(CAST({x} AS DOUBLE), {digits})"


def pct(x: str) -> str:
    """R ``percent(x, 1, format = 'f')`` of formattable: 100 * x to 1 digit and '%'; 'Inf' / '-Inf', NULL for NA/NaN."""
    r = re(f"({x}) * 100", 1)
    return (
        f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN NULL "
        f"WHEN ({x}) = CAST('infinity' AS DOUBLE) THEN 'Inf' "
        f"WHEN ({x}) = CAST('-infinity' AS DOUBLE) THEN '-Inf' "
        f"ELSE printf('%.1f', CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END) || '%' END)"
    )


def titlecase(x: str) -> str:
    words = f"list_transform(string_split(lower({x}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2))"
    return f"regexp_replace(array_to_string({words}, ' '), '^(.*?)Nhs', '\\1NHS')"


def nse(a: str, b: str, cols) -> str:
    """Null-safe equality on several columns (dplyr join keys)."""
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


def rounded(cols) -> str:
    if not cols:
        return "*"
    # a zero prints as 0.0, never -0.0 (Spark's decimal rounding has no negative zero)
    return "* REPLACE (" + ", ".join(
        f'CASE WHEN "{c}" = 0 THEN CAST(0 AS DOUBLE) ELSE round("{c}", 6) END AS "{c}"' for c in cols
    ) + ")"


#: Columns from left to right of the tables that have a final order; ties are broken in this order.
COLUMNS = {
    "extract": ["month_commencing", "treatment_function_code", "treatment_function", "der_provider_code", "stp_code", "activity"],
    "monthly_working_days": ["month_name_short", "month_num", "year_num", "month_commencing", "fin_year", "fin_month", "working_days"],
    "gap_by_month": ["month_name_short", "fin_month", "provider_code", "baseline", "actual", "target", "variance"],
    "cohort_rows": ["month_name_short", "fin_month", "icb", "provider", "treatment_function_code", "treatment_function",
                    "speciality_activity", "total_activity", "baseline", "target", "variance", "proportion_of_total",
                    "cohort_activity", "cohort_proportion", "monthly_reduction"],
    "fair_share": ["icb", "provider", "treatment_function", "avg_monthly_activity", "share_of_monthly_variance",
                   "avg_activity_per_wd", "share_of_daily_variance"],
    "gap_per_day_wide": ["icb", "provider", *FIN_MONTHS],
    "specialty_gap_per_day_wide": ["icb", "provider", "treatment_function", *FIN_MONTHS],
    "baseline": ["orgcode", "orgtype", "month_commencing", "value"],
}


class Oracle:
    def __init__(self, p: Params | None = None):
        self.p = p or test_params()
        self.ctes: dict[str, tuple[str, tuple[str, ...]]] = {}
        self._define()
        self._define_specialty()
        self._define_other()

    # -- assembly -----------------------------------------------------------
    def add(self, name: str, sql: str, *deps: str) -> None:
        self.ctes[name] = (sql, deps)

    def build(self, final: str, *deps: str) -> str:
        order: list[str] = []

        def visit(n: str):
            if n in order:
                return
            for d in self.ctes[n][1]:
                visit(d)
            order.append(n)

        for d in deps:
            visit(d)
        if not order:
            return final
        return "WITH " + ",\n".join(f"{n} AS (\n{self.ctes[n][0]}\n)" for n in order) + "\n" + final

    def select(self, cte: str, doubles=(), cols: str | None = None) -> str:
        return self.build(f"SELECT {rounded(doubles) if cols is None else cols} FROM {cte}", cte)

    # -- definitions ----------------------------------------------------------
    def _define(self) -> None:  # noqa: C901 - one list of CTEs
        p = self.p
        A = self.add

        # logical tables (FIXTURES.md section 2)
        A(
            "att_base",
            f"""SELECT l.l_orderkey * 10 + l.l_linenumber AS opa_ident,
       CAST(l.l_shipdate AS DATE) AS appointment_date,
       {case_map('l.l_returnflag', tm.RETURNFLAG_TO_FIRST_ATTENDANCE)} AS first_attendance,
       CASE WHEN l.l_discount <> 0 THEN CAST(round(l.l_discount * 100) AS INTEGER) % 3 END AS der_number_procedure,
       l.l_tax, l.l_linestatus,
       {case_map('o.o_orderstatus', tm.ORDERSTATUS_TO_ATTENDANCE_STATUS)} AS attendance_status,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN '02' ELSE '01' END AS administrative_category,
       o.o_orderpriority,
       {case_map('p.p_type', tm.PART_TYPE_TO_TFC)} AS treatment_function_code,
       CASE WHEN p.p_size <= 40 THEN 'WF01A' ELSE 'AA01A' END AS core_hrg,
       s.s_nationkey,
       'R' || {nn('s.s_nationkey')} || CASE WHEN s.s_suppkey % 4 = 1 THEN '00' WHEN s.s_suppkey % 4 = 3 THEN '01' ELSE '' END AS der_provider_code
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
        )
        A(
            "att",
            f"""SELECT *, {fy_label('appointment_date', '/')} AS der_financial_year,
       strftime(appointment_date, '%Y%m') AS der_activity_month FROM att_base""",
            "att_base",
        )
        A(
            "tfc_ref",
            f"""SELECT code AS treatment_function_code, code || ':' || p_type AS treatment_function_desc
FROM (SELECT DISTINCT p_type, {case_map('p_type', tm.PART_TYPE_TO_TFC)} AS code FROM part) t
WHERE code IS NOT NULL AND code <> '140'""",
        )
        A(
            "hier",
            f"""SELECT 'R' || {nn('n.n_nationkey')} AS organisation_code, n.n_name AS organisation_name,
       'Q' || CAST(r.r_regionkey AS VARCHAR) AS stp_code, r.r_name AS stp_name,
       CASE WHEN r.r_regionkey IN (0, 1, 2) THEN 'Y0' ELSE 'Y1' END AS region_code
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
        )
        A(
            "att_cost",
            """SELECT opa_ident, der_financial_year, min(core_hrg) AS hrg_code_other
FROM att WHERE l_tax > 0 GROUP BY opa_ident, der_financial_year""",
            "att",
        )
        A(
            "planning",
            f"""SELECT 'R' || {nn('c.s_nationkey')} AS orgcode,
       CASE WHEN c.s_nationkey < 20 THEN 'Provider' ELSE 'ICB' END AS orgtype,
       c.dimdatestart, CAST(c.n AS DOUBLE) AS value,
       CASE WHEN c.o_orderpriority = '1-URGENT' THEN 'E.M.38' ELSE 'E.M.10' END AS planningref,
       CASE WHEN nr.n_regionkey IN (0, 1, 2) THEN 'Y0' ELSE 'Y1' END AS regioncode,
       CASE WHEN c.l_linestatus = 'F' THEN NULL ELSE 'Plan' END AS sourcetype,
       CAST({fy_start('c.dimdatestart')} + 1 AS VARCHAR) AS dimfyear
FROM (SELECT {first_of_month('CAST(l.l_shipdate AS DATE)')} AS dimdatestart, s.s_nationkey, o.o_orderpriority,
             l.l_linestatus, count(*) AS n
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
      GROUP BY ALL) c
JOIN nation nr ON c.s_nationkey = nr.n_nationkey""",
        )
        A(
            "hrg_ts",
            f"""SELECT c.der_activity_month, 'R' || {nn('c.s_nationkey')} AS provider_or_is_ccg_code_a,
       'Q' || CAST(n.n_regionkey AS VARCHAR) AS stp_ics, c.centralised_nhse_commissioned, c.tfc, c.activity,
       'OPA' AS activity_type, c.der_appointment_type, c.hrg
FROM (SELECT der_activity_month, s_nationkey,
             CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS centralised_nhse_commissioned,
             treatment_function_code AS tfc,
             CASE WHEN first_attendance IN ('2', '4') THEN 'FUp' ELSE 'First' END AS der_appointment_type,
             core_hrg AS hrg, count(*) AS activity
      FROM att GROUP BY ALL) c JOIN nation n ON c.s_nationkey = n.n_nationkey""",
            "att",
        )
        A(
            "provider_lookup",
            f"""SELECT 'R' || {nn('n_nationkey')} AS provider_code, n_name AS provider_short_name,
       'TRUST ' || n_name AS acute_full_name,
       CASE WHEN n_nationkey = 5 THEN 'Q1' ELSE 'Q' || CAST(n_regionkey AS VARCHAR) END AS stp_code
FROM nation WHERE n_nationkey <> 10""",
        )
        A(
            "system_lookup",
            """SELECT 'Q' || CAST(r_regionkey AS VARCHAR) AS stp_code, 'NHS ' || r_name || ' BOARD' AS stp_name,
       CASE WHEN r_regionkey = 4 THEN 'Non_SE' ELSE r_name END AS short_name FROM region""",
        )
        A("acutes", f"SELECT 'R' || {nn('n_nationkey')} AS provider_code FROM nation WHERE n_nationkey < 20")

        # calendar (D1, D2)
        span = f"""SELECT make_date({fy_start('lo')}, 4, 1) AS start_date, make_date({fy_start('hi')} + 1, 3, 31) AS end_date
FROM (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem) s"""
        fixed = f"SELECT DATE {q(str(p.calendar_start))} AS start_date, DATE {q(str(p.calendar_end))} AS end_date"
        A("cal_bounds", span if p.calendar_start is None else fixed)
        extra = " UNION ALL ".join(f"SELECT DATE {q(d)} AS date" for d in p.extra_holidays) or "SELECT NULL::DATE AS date WHERE false"
        A(
            "holidays",
            f"""{extra}
UNION ALL
SELECT unnest([make_date(y, 1, 1), make_date(y, 12, 25), make_date(y, 12, 26)]) AS date
FROM (SELECT unnest(range(year(start_date), year(end_date) + 1)) AS y FROM cal_bounds) yy""",
            "cal_bounds",
        )
        A(
            "calendar",
            f"""SELECT d AS date, CAST(day(d) AS INTEGER) AS day_num, strftime(d, '%a') AS day_name,
       CAST(month(d) AS INTEGER) AS month_num, CAST(year(d) AS INTEGER) AS year_num,
       strftime(d, '%b') AS month_name, strftime(d, '%b') AS month_name_short,
       {fy_label('d', '-')} AS fin_year, {fin_month('d')} AS fin_month,
       CASE WHEN dayofweek(d) IN (0, 6) OR d IN (SELECT date FROM holidays) THEN 'no' ELSE 'yes' END AS working_day
FROM (SELECT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS d FROM cal_bounds) days""",
            "cal_bounds",
            "holidays",
        )
        A(
            "mwd",
            """SELECT month_name_short, month_num, year_num, make_date(year_num, month_num, 1) AS month_commencing,
       fin_year, fin_month, count(*) AS working_days
FROM calendar WHERE working_day = 'yes'
GROUP BY month_name_short, month_num, year_num, fin_year, fin_month""",
            "calendar",
        )
        for suffix, fy in (("", p.target_wd_fy), ("_v2", p.v2_target_wd_fy)):
            A(f"wd_target{suffix}", f"SELECT month_name_short, working_days FROM mwd WHERE fin_year = {q(fy)}", "mwd")
            A(
                f"scalars{suffix}",
                f"""SELECT count(*) AS month_count, CAST(coalesce(sum(working_days), 0) AS DOUBLE) AS total_wd
FROM mwd WHERE fin_year = {q(fy)}""",
                "mwd",
            )

        # extracts (D4-D9)
        def extract_sql(fys, else_len=None, extra_where=""):
            sel = provider_case("a.der_provider_code", p.select_rules, else_len)
            key = provider_case("a.der_provider_code", p.join_rules)
            return f"""SELECT {first_of_month('a.appointment_date')} AS month_commencing, a.treatment_function_code,
       substr(t.treatment_function_desc, 5) AS treatment_function,
       {sel} AS der_provider_code, h.stp_code, count(*) AS activity
FROM att a
LEFT JOIN tfc_ref t ON a.treatment_function_code = t.treatment_function_code
LEFT JOIN hier h ON ({key}) = h.organisation_code
WHERE a.first_attendance IN ('2', '4') AND a.attendance_status IN ('5', '6')
  AND a.der_financial_year IN {in_list(fys)}
  AND a.treatment_function_code NOT IN {in_list(p.excluded_tfc)}
  AND h.region_code = {q(p.region_code)} AND a.administrative_category = '01'
  AND left(a.core_hrg, 2) = 'WF' AND left(a.der_provider_code, 1) = 'R' {extra_where}
GROUP BY ALL"""

        A("extract", extract_sql([p.actual_fy]), "att", "tfc_ref", "hier")
        A("extract_3y", extract_sql(p.three_year_fys, 3), "att", "tfc_ref", "hier")
        A(
            "extract_excl_march",
            extract_sql([p.baseline_fy], None, f"AND a.der_activity_month NOT IN ({q(p.excluded_month)})"),
            "att",
            "tfc_ref",
            "hier",
        )
        A(
            "extract_history",
            extract_sql(p.history_fys, None, "AND right(a.der_activity_month, 2) IN ('02', '03')"),
            "att",
            "tfc_ref",
            "hier",
        )
        A(
            "actuals",
            """SELECT month_commencing, treatment_function_code, treatment_function, der_provider_code, stp_code,
       CAST(activity AS DOUBLE) AS activity FROM extract""",
            "extract",
        )
        A(
            "baseline",
            f"""SELECT orgcode, orgtype, dimdatestart AS month_commencing, value FROM planning
WHERE planningref = {q(p.planning_ref)} AND regioncode = {q(p.region_code)} AND sourcetype IS NULL
  AND dimfyear IN ({q(p.planning_dimfyear)}) AND orgtype = {q(p.planning_orgtype)}""",
            "planning",
        )

        cols = "month_commencing, treatment_function_code, treatment_function, der_provider_code, stp_code, activity"
        parts = {"actual": "extract", "three_years": "extract_3y", "excl_march": "extract_excl_march", "history": "extract_history"}
        A("together", " UNION ALL ".join(f"SELECT {q(k)} AS scope, {cols} FROM {x}" for k, x in parts.items()), *parts.values())
        years = {"actual": [p.actual_fy], "three_years": p.three_year_fys, "excl_march": [p.baseline_fy], "history": p.history_fys}
        A(
            "by_scope",
            " UNION ALL ".join(
                f"""SELECT {q(k)} AS scope, der_financial_year, first_attendance, count(*) AS attendances,
       count(DISTINCT der_activity_month) AS months, count(DISTINCT der_provider_code) AS providers
FROM att WHERE der_financial_year IN {in_list(y)} GROUP BY der_financial_year, first_attendance"""
                for k, y in years.items()
            ),
            "att",
        )

        # provider level (D12-D18, D26, D28-D30), for the current and the v2 method
        A(
            "pmt",
            f"""SELECT month_commencing, der_provider_code AS provider_code, {strict('activity')} AS activity,
       'actual' AS period
FROM actuals WHERE der_provider_code IN (SELECT provider_code FROM acutes)
GROUP BY month_commencing, der_provider_code""",
            "actuals",
            "acutes",
        )
        for sfx, label in (("", p.target_label), ("_v2", p.v2_target_label)):
            A(
                f"bl_wd{sfx}",
                f"""SELECT b.orgcode, b.orgtype, b.month_commencing, b.value AS activity, m.month_name_short, m.fin_year,
       m.working_days AS working_days_base, w.working_days AS working_days_target
FROM baseline b
LEFT JOIN mwd m ON b.month_commencing IS NOT DISTINCT FROM m.month_commencing
LEFT JOIN wd_target{sfx} w ON m.month_name_short IS NOT DISTINCT FROM w.month_name_short""",
                "baseline",
                "mwd",
                f"wd_target{sfx}",
            )
            A(
                f"rebased{sfx}",
                f"""SELECT month_commencing, orgcode AS provider_code,
       activity / working_days_base * working_days_target AS activity, 'baseline' AS period FROM bl_wd{sfx}""",
                f"bl_wd{sfx}",
            )
            A(
                f"target_rows{sfx}",
                f"""SELECT month_commencing, provider_code, activity * CAST({p.target_factor} AS DOUBLE) AS activity,
       {q(label)} AS period FROM rebased{sfx}""",
                f"rebased{sfx}",
            )
            A(
                f"stacked{sfx}",
                f"""SELECT c.month_name_short, c.fin_month, u.provider_code, u.activity, u.period
FROM (SELECT * FROM rebased{sfx} UNION SELECT * FROM pmt UNION SELECT * FROM target_rows{sfx}) u
LEFT JOIN calendar c ON u.month_commencing IS NOT DISTINCT FROM c.date""",
                f"rebased{sfx}",
                "pmt",
                f"target_rows{sfx}",
                "calendar",
            )
            A(
                f"gbm{sfx}",
                f"""SELECT *, actual - {label} AS variance FROM (
  SELECT month_name_short, fin_month, provider_code,
         {pv('period', 'baseline', 'activity')} AS baseline,
         {pv('period', 'actual', 'activity')} AS actual,
         {pv('period', label, 'activity')} AS {label}
  FROM stacked{sfx} GROUP BY month_name_short, fin_month, provider_code) w""",
                f"stacked{sfx}",
            )
            A(
                f"with_var{sfx}",
                f"""SELECT month_name_short, fin_month, provider_code, activity, period FROM stacked{sfx}
UNION
SELECT month_name_short, fin_month, provider_code, variance AS activity, 'variance' AS period FROM gbm{sfx}""",
                f"stacked{sfx}",
                f"gbm{sfx}",
            )
            y0 = p.actual_fy_start_year
            A(
                f"enriched{sfx}",
                f"""SELECT v.month_name_short, v.fin_month, v.activity, v.period, pl.provider_short_name AS provider,
       pl.acute_full_name, sl.short_name AS icb,
       CASE WHEN v.fin_month < 10 THEN make_date({y0}, v.fin_month + 3, 1)
            WHEN v.fin_month > 9 THEN make_date({y0 + 1}, v.fin_month - 9, 1) END AS month_of_actual
FROM with_var{sfx} v
LEFT JOIN provider_lookup pl ON v.provider_code IS NOT DISTINCT FROM pl.provider_code
LEFT JOIN system_lookup sl ON pl.stp_code IS NOT DISTINCT FROM sl.stp_code""",
                f"with_var{sfx}",
                "provider_lookup",
                "system_lookup",
            )
            A(
                f"gbmpd{sfx}",
                f"""SELECT w.month_name_short, w.fin_month, w.icb, w.provider, w.baseline, w.actual, w.{label},
       w.actual - w.{label} AS variance,
       w.actual / t.working_days AS activity_per_wd,
       w.{label} / t.working_days AS {label}_per_wd,
       (w.actual - w.{label}) / t.working_days AS variance_per_wd
FROM (SELECT month_name_short, fin_month, provider, acute_full_name, icb, month_of_actual,
             {pv('period', 'baseline', 'activity')} AS baseline,
             {pv('period', 'actual', 'activity')} AS actual,
             {pv('period', label, 'activity')} AS {label}
      FROM enriched{sfx}
      GROUP BY month_name_short, fin_month, provider, acute_full_name, icb, month_of_actual) w
LEFT JOIN wd_target{sfx} t ON w.month_name_short IS NOT DISTINCT FROM t.month_name_short""",
                f"enriched{sfx}",
                f"wd_target{sfx}",
            )
            months = ",\n       ".join(f'{pv("month_name_short", m, "variance_per_wd")} AS "{m}"' for m in FIN_MONTHS)
            A(
                f"gap_per_day_wide{sfx}",
                f"SELECT icb, provider,\n       {months}\nFROM gbmpd{sfx} GROUP BY icb, provider",
                f"gbmpd{sfx}",
            )
            A(
                f"gap_by_year{sfx}",
                f"""SELECT y.icb, y.provider, y.baseline, y.actual, y.{label}, y.actual - y.{label} AS variance,
       (y.actual - y.{label}) / y.actual AS percent_vs_actual,
       (y.actual - y.{label}) / s.total_wd AS variance_per_wd
FROM (SELECT icb, provider, {narm('baseline')} AS baseline, {narm('actual')} AS actual, {narm(label)} AS {label}
      FROM gbmpd{sfx} GROUP BY icb, provider) y CROSS JOIN scalars{sfx} s""",
                f"gbmpd{sfx}",
                f"scalars{sfx}",
            )
            A(
                f"gap_by_year_code{sfx}",
                f"""SELECT y.provider_code, y.baseline, y.actual, y.{label}, y.actual - y.{label} AS variance,
       y.actual / y.{label} - 1.0 AS perc_variance,
       (y.actual - y.{label}) / s.total_wd AS variance_per_wd
FROM (SELECT provider_code, {narm('baseline')} AS baseline, {narm('actual')} AS actual, {narm(label)} AS {label}
      FROM gbm{sfx} GROUP BY provider_code) y CROSS JOIN scalars{sfx} s""",
                f"gbm{sfx}",
                f"scalars{sfx}",
            )

        if p.provisional_month is not None:
            self._cut_provisional_month()

    def _cut_provisional_month(self) -> None:
        """The reference's guard: if the newest month is not after the provisional one, that month goes from the
        actuals, its counterpart from the baseline, and its working days from the year's totals."""
        p = self.p
        self.add("cut", f"SELECT coalesce(max(month_commencing) <= DATE {q(str(p.provisional_month))}, true) AS yes FROM extract", "extract")
        for name, day in (("actuals", p.provisional_month), ("baseline", p.provisional_baseline_month)):
            sql, deps = self.ctes[name]
            kept = f"SELECT x.* FROM ({sql}) x, cut WHERE NOT cut.yes OR x.month_commencing <> DATE {q(str(day))}"
            self.ctes[name] = (kept, (*deps, "cut"))
        label = q(p.provisional_month.strftime("%b"))
        self.ctes["scalars"] = (
            f"""SELECT count(*) AS month_count, CAST(coalesce(sum(working_days), 0) AS DOUBLE) AS total_wd
FROM mwd, cut WHERE fin_year = {q(p.target_wd_fy)} AND (NOT cut.yes OR month_name_short <> {label})""",
            ("mwd", "cut"),
        )

    def _define_specialty(self) -> None:  # noqa: C901
        p = self.p
        A = self.add
        acute = "der_provider_code IN (SELECT provider_code FROM acutes)"
        # Share of the provider-month total, by a join to the totals
        A(
            "ss",
            f"""SELECT c.month_name_short, c.fin_month, a.stp_code, a.der_provider_code AS provider_code,
       a.treatment_function_code, a.treatment_function, a.activity AS speciality_activity,
       t.activity AS total_activity, a.activity / t.activity AS proportion_of_total
FROM (SELECT * FROM actuals WHERE {acute}) a
LEFT JOIN pmt t ON a.month_commencing IS NOT DISTINCT FROM t.month_commencing
               AND a.der_provider_code IS NOT DISTINCT FROM t.provider_code
LEFT JOIN calendar c ON a.month_commencing IS NOT DISTINCT FROM c.date""",
            "actuals",
            "acutes",
            "pmt",
            "calendar",
        )
        for sfx, label, by_icb in (("", p.target_label, True), ("_v2", p.v2_target_label, False)):
            A(
                f"sg{sfx}",
                f"""SELECT s.month_name_short, s.fin_month, sl.short_name AS icb, pl.provider_short_name AS provider,
       s.treatment_function_code, s.treatment_function, s.speciality_activity, s.total_activity,
       g.baseline, g.{label}, g.variance, s.proportion_of_total
FROM ss s
LEFT JOIN gbm{sfx} g ON {nse('s', 'g', ['month_name_short', 'fin_month', 'provider_code'])}
LEFT JOIN provider_lookup pl ON {nse('s', 'pl', ['provider_code', 'stp_code'])}
LEFT JOIN system_lookup sl ON s.stp_code IS NOT DISTINCT FROM sl.stp_code""",
                "ss",
                f"gbm{sfx}",
                "provider_lookup",
                "system_lookup",
            )
            keys = ["icb", "provider", "treatment_function_code"] if by_icb else ["provider", "treatment_function_code"]
            kl = ", ".join(keys)
            A(
                f"coh{sfx}",
                f"""SELECT * FROM (
  SELECT sp.*, tt.total_activity, sp.speciality_activity / tt.total_activity AS proportion_of_activity,
         ty.month_tally, sp.speciality_activity / ty.month_tally AS avg_monthly_activity
  FROM (SELECT {kl}, {strict('speciality_activity')} AS speciality_activity FROM sg{sfx} GROUP BY {kl}) sp
  LEFT JOIN (SELECT provider, {strict('total_activity')} AS total_activity
             FROM (SELECT DISTINCT month_name_short, provider, total_activity FROM sg{sfx}) d GROUP BY provider) tt
         ON sp.provider IS NOT DISTINCT FROM tt.provider
  LEFT JOIN (SELECT provider, treatment_function_code, count(*) AS month_tally
             FROM sg{sfx} GROUP BY provider, treatment_function_code) ty
         ON {nse('sp', 'ty', ['provider', 'treatment_function_code'])}
) x
WHERE month_tally > {p.min_month_tally}
  AND (proportion_of_activity >= {p.min_share} OR avg_monthly_activity >= {p.min_avg_monthly})""",
                f"sg{sfx}",
            )
            A(
                f"members{sfx}",
                f"""SELECT * FROM sg{sfx} s WHERE EXISTS (
  SELECT 1 FROM coh{sfx} c WHERE {nse('c', 's', ['provider', 'treatment_function_code'])})""",
                f"sg{sfx}",
                f"coh{sfx}",
            )
            A(
                f"crows{sfx}",
                f"""SELECT m.*, t.cohort_activity, m.speciality_activity / t.cohort_activity AS cohort_proportion,
       m.variance * (m.speciality_activity / t.cohort_activity) AS monthly_reduction
FROM members{sfx} m
LEFT JOIN (SELECT month_name_short, fin_month, icb, provider, {strict('speciality_activity')} AS cohort_activity
           FROM members{sfx} GROUP BY month_name_short, fin_month, icb, provider) t
       ON {nse('m', 't', ['month_name_short', 'fin_month', 'icb', 'provider'])}""",
                f"members{sfx}",
            )
            ck = "icb, provider" if by_icb else "provider"
            A(
                f"coverage{sfx}",
                f"SELECT {ck}, {strict('proportion_of_activity')} AS cohort_activity FROM coh{sfx} GROUP BY {ck}",
                f"coh{sfx}",
            )
            A(
                f"cmpd{sfx}",
                f"""SELECT r.icb, r.provider, r.month_name_short, r.treatment_function_code, r.treatment_function,
       r.total_activity, r.baseline, r.{label}, r.variance, r.variance / w.working_days AS variance_per_wd,
       r.cohort_activity, r.cohort_proportion, r.monthly_reduction, w.working_days AS wd_target,
       r.speciality_activity, r.speciality_activity / w.working_days AS activity_per_wd,
       r.variance / w.working_days * r.cohort_proportion AS wd_variance_by_spec
FROM crows{sfx} r LEFT JOIN wd_target{sfx} w ON r.month_name_short IS NOT DISTINCT FROM w.month_name_short""",
                f"crows{sfx}",
                f"wd_target{sfx}",
            )
            sums = ", ".join(
                f"{strict(c)} AS {c}"
                for c in ("total_activity", "baseline", label, "variance", "cohort_activity", "speciality_activity")
            )
            A(
                f"fsy{sfx}",
                f"""SELECT icb, provider, treatment_function_code, treatment_function, {sums}
FROM crows{sfx} GROUP BY icb, provider, treatment_function_code, treatment_function""",
                f"crows{sfx}",
            )
            share = "(y.speciality_activity / y.cohort_activity)"
            if by_icb:
                A(
                    "fair",
                    f"""SELECT y.icb, y.provider, y.treatment_function,
       {re('y.speciality_activity / s.month_count', 1)} AS avg_monthly_activity,
       {re(f'y.variance / s.month_count * {share}', 1)} AS share_of_monthly_variance,
       {re('y.speciality_activity / s.total_wd', 1)} AS avg_activity_per_wd,
       {re(f'y.variance / s.total_wd * {share}', 1)} AS share_of_daily_variance
FROM fsy y CROSS JOIN scalars s""",
                    "fsy",
                    "scalars",
                )
            else:
                A(
                    "fair_v2",
                    f"""SELECT y.icb, y.provider, y.treatment_function,
       y.speciality_activity / s.total_wd AS avg_activity_per_wd,
       y.variance / s.total_wd * {share} AS avg_variance_from_ambition
FROM fsy_v2 y CROSS JOIN scalars_v2 s""",
                    "fsy_v2",
                    "scalars_v2",
                )
        months = ",\n       ".join(f'{pv("month_name_short", m, "wd_variance_by_spec")} AS "{m}"' for m in FIN_MONTHS)
        A(
            "sgpdw",
            f"SELECT icb, provider, treatment_function,\n       {months}\nFROM cmpd GROUP BY icb, provider, treatment_function",
            "cmpd",
        )

    def _define_other(self) -> None:  # noqa: C901
        p = self.p
        A = self.add
        acute = "der_provider_code IN (SELECT provider_code FROM acutes)"
        t = p.target_label
        # workbook (D31)
        A(
            "bag",
            f"""SELECT *, activity / working_days_base * working_days_target AS adj_activity,
       activity / working_days_base * working_days_target * CAST({p.workbook_target_factor} AS DOUBLE) AS target
FROM bl_wd""",
            "bl_wd",
        )
        # D3
        A(
            "normalise",
            f"""SELECT der_provider_code AS raw_provider_code,
       {provider_case('der_provider_code', p.select_rules)} AS provider_code,
       {provider_case('der_provider_code', p.select_rules, 3)} AS provider_code_3,
       {provider_case('der_provider_code', p.join_rules)} AS hierarchy_key
FROM (SELECT DISTINCT der_provider_code FROM att) d""",
            "att",
        )
        # D9
        A(
            "hrg_baseline",
            f"""SELECT left(der_activity_month, 4) || '-' || right(der_activity_month, 2) || '-' || '01' AS month_commencing,
       provider_or_is_ccg_code_a AS provider_code, stp_ics, centralised_nhse_commissioned, tfc, activity
FROM hrg_ts
WHERE provider_or_is_ccg_code_a IN (SELECT provider_code FROM acutes) AND activity_type = 'OPA'
  AND der_appointment_type = 'FUp' AND left(hrg, 2) = 'WF'
  AND der_activity_month BETWEEN {q(p.hrg_month_from)} AND {q(p.hrg_month_to)}""",
            "hrg_ts",
            "acutes",
        )
        # D10
        code = "a.der_provider_code"
        merged_code = "CASE " + " ".join(f"WHEN {code} IN {in_list(c)} THEN {q(tg)}" for c, tg, _ in p.tracking_merges) + f" ELSE {code} END"
        merged_name = "CASE " + " ".join(f"WHEN {code} IN {in_list(c)} THEN {q(nm)}" for c, _, nm in p.tracking_merges) + " ELSE f.organisation_name END"
        key = (
            "CASE "
            + " ".join(f"WHEN {code} = {q(a)} THEN {q(b)}" for a, b in p.tracking_key_exact)
            + f" WHEN right({code}, 2) = '00' THEN left({code}, 3) WHEN left({code}, 1) = 'R' THEN left({code}, 3) ELSE {code} END"
        )
        month_text = "strftime(date_trunc('month', a.appointment_date), '%d/%m/%Y')"
        A(
            "tracking",
            f"""SELECT {month_text} AS activity_month_year,
       CASE WHEN a.der_financial_year = {q(p.baseline_fy)} THEN 'Y' ELSE 'N' END AS is_baseline,
       {merged_code} AS provider_org_code_mapped,
       f.stp_code AS ics_code, f.stp_name AS ics_name,
       {merged_name} AS provider_name_mapped,
       a.treatment_function_code AS tfc,
       CASE WHEN a.treatment_function_code NOT IN {in_list(p.excluded_tfc)} THEN 'Y' ELSE 'N' END AS tfc_scope,
       CASE WHEN a.attendance_status IN ('5', '6') AND a.first_attendance IN ('1', '2') THEN 'F2F' ELSE 'NF2F' END AS appointment_type,
       CASE WHEN a.attendance_status IN ('5', '6') AND a.first_attendance IN ('1', '3') THEN 'First' ELSE 'Follow_Up' END AS attendance_type,
       CASE WHEN a.der_number_procedure > 0 THEN 'Procedure' ELSE 'No_Procedure' END AS procedure,
       CASE WHEN c.hrg_code_other LIKE 'WF%' THEN 'Y' ELSE 'N' END AS wf_flag,
       count(a.opa_ident) AS appointments
FROM att a
LEFT JOIN att_cost c ON a.opa_ident = c.opa_ident AND a.der_financial_year = c.der_financial_year
LEFT JOIN tfc_ref d ON d.treatment_function_code = a.treatment_function_code
LEFT JOIN hier f ON f.organisation_code = {key}
WHERE a.administrative_category = '01' AND a.attendance_status IN ('5', '6')
  AND a.first_attendance IN ('1', '2', '3', '4') AND a.treatment_function_code <> '812'
  AND a.der_financial_year IN {in_list(p.tracking_fys)} AND a.der_activity_month NOT IN ({q(p.excluded_month)})
  AND f.region_code = {q(p.tracking_region_code)} AND a.der_provider_code LIKE 'R%'
GROUP BY {month_text}, a.der_financial_year, {merged_code}, {merged_name}, a.treatment_function_code,
         a.attendance_status, a.first_attendance, a.der_number_procedure, c.hrg_code_other, f.stp_code, f.stp_name""",
            "att",
            "att_cost",
            "tfc_ref",
            "hier",
        )
        vis = ("activity_month_year, is_baseline, provider_org_code_mapped, ics_code, ics_name, provider_name_mapped, "
               "tfc, tfc_scope, appointment_type, attendance_type, procedure, wf_flag")
        A(
            "tracking_rolled",
            f"SELECT {vis}, CAST(sum(appointments) AS BIGINT) AS appointments FROM tracking GROUP BY {vis}",
            "tracking",
        )
        # D32
        A(
            "comparison",
            f"""SELECT a.month_commencing, c.year_num, c.fin_year, c.month_name_short, c.fin_month,
       left(a.der_provider_code, 3) AS der_provider_code, a.stp_code,
       {strict('CAST(a.activity AS DOUBLE)')} AS activity
FROM extract_3y a LEFT JOIN (SELECT * FROM calendar WHERE day_num = 1) c
     ON a.month_commencing IS NOT DISTINCT FROM c.date
GROUP BY a.month_commencing, c.year_num, c.fin_year, c.month_name_short, c.fin_month,
         left(a.der_provider_code, 3), a.stp_code""",
            "extract_3y",
            "calendar",
        )

        # D33-D35 (older method)
        def no_spec(src: str) -> str:
            return f"""SELECT month_commencing, der_provider_code, stp_code, {strict('CAST(activity AS DOUBLE)')} AS activity
FROM {src} WHERE {acute} GROUP BY month_commencing, der_provider_code, stp_code"""

        A(
            "hist_pm",
            f"""SELECT h.*, m.working_days FROM ({no_spec('extract_history')}) h
LEFT JOIN mwd m ON h.month_commencing IS NOT DISTINCT FROM m.month_commencing""",
            "extract_history",
            "acutes",
            "mwd",
        )
        A(
            "mcf",
            f"""SELECT DATE {q(p.march_counterfactual_date.isoformat())} AS month_commencing, der_provider_code, stp_code,
       {strict('activity / working_days')} / CAST({p.march_divisor} AS DOUBLE) AS activity
FROM hist_pm GROUP BY der_provider_code, stp_code""",
            "hist_pm",
        )
        A(
            "v1_base",
            f"""SELECT b.month_commencing, b.der_provider_code, b.stp_code, b.activity / m.working_days AS activity
FROM ({no_spec('extract_excl_march')}) b LEFT JOIN mwd m ON b.month_commencing IS NOT DISTINCT FROM m.month_commencing
UNION
SELECT month_commencing, der_provider_code, stp_code, activity FROM mcf""",
            "extract_excl_march",
            "acutes",
            "mwd",
            "mcf",
        )
        A(
            "v1_act",
            f"""SELECT b.month_commencing, b.der_provider_code, b.stp_code, b.activity / m.working_days AS activity
FROM ({no_spec('actuals')}) b LEFT JOIN mwd m ON b.month_commencing IS NOT DISTINCT FROM m.month_commencing""",
            "actuals",
            "acutes",
            "mwd",
        )
        amb = p.v2_target_label
        A(
            "v1_rows",
            f"""SELECT month_commencing, der_provider_code, stp_code, activity, 'baseline' AS period FROM v1_base
UNION SELECT month_commencing, der_provider_code, stp_code, activity, 'actual' AS period FROM v1_act
UNION SELECT month_commencing, der_provider_code, stp_code, activity * CAST({p.target_factor} AS DOUBLE) AS activity,
             {q(amb)} AS period FROM v1_base""",
            "v1_base",
            "v1_act",
        )
        A(
            "v1_named",
            """SELECT c.fin_month, c.month_name_short AS month, pl.provider_short_name AS provider, sl.short_name AS icb,
       r.activity, r.period
FROM v1_rows r
LEFT JOIN calendar c ON r.month_commencing IS NOT DISTINCT FROM c.date
LEFT JOIN provider_lookup pl ON r.der_provider_code IS NOT DISTINCT FROM pl.provider_code
LEFT JOIN system_lookup sl ON r.stp_code IS NOT DISTINCT FROM sl.stp_code""",
            "v1_rows",
            "calendar",
            "provider_lookup",
            "system_lookup",
        )
        A(
            "v1_wide",
            f"""SELECT *, actual - {amb} AS variance FROM (
  SELECT fin_month, month, provider, icb,
         {pv('period', 'baseline', 'activity')} AS baseline,
         {pv('period', 'actual', 'activity')} AS actual,
         {pv('period', amb, 'activity')} AS {amb}
  FROM (SELECT c.fin_month, c.month_name_short AS month, pl.provider_short_name AS provider, sl.short_name AS icb,
               r.activity, r.period
        FROM v1_rows r
        LEFT JOIN calendar c ON r.month_commencing IS NOT DISTINCT FROM c.date
        LEFT JOIN provider_lookup pl ON r.der_provider_code IS NOT DISTINCT FROM pl.provider_code
        LEFT JOIN system_lookup sl ON r.stp_code IS NOT DISTINCT FROM sl.stp_code) x
  GROUP BY fin_month, month, provider, icb) w""",
            "v1_rows",
            "calendar",
            "provider_lookup",
            "system_lookup",
        )
        A(
            "v1_tot",
            f"""SELECT t.month_commencing, t.der_provider_code, t.stp_code, t.activity AS total_activity, m.working_days
FROM ({no_spec('actuals')}) t LEFT JOIN mwd m ON t.month_commencing IS NOT DISTINCT FROM m.month_commencing""",
            "actuals",
            "acutes",
            "mwd",
        )
        wdt = "(t.total_activity / t.working_days)"
        A(
            "v1_split_rows",
            f"""SELECT sl.short_name AS icb, pl.provider_short_name AS provider, a.treatment_function, a.month_commencing,
       {re(f'({wdt} - {wdt} * CAST({p.target_factor} AS DOUBLE)) * (a.activity / t.total_activity)', 1)} AS reduction_per_day
FROM (SELECT * FROM actuals WHERE {acute}) a
LEFT JOIN v1_tot t ON {nse('a', 't', ['month_commencing', 'der_provider_code', 'stp_code'])}
LEFT JOIN provider_lookup pl ON a.der_provider_code IS NOT DISTINCT FROM pl.provider_code
LEFT JOIN system_lookup sl ON a.stp_code IS NOT DISTINCT FROM sl.stp_code""",
            "actuals",
            "acutes",
            "v1_tot",
            "provider_lookup",
            "system_lookup",
        )
        mnames = [m.isoformat() for m in p.actual_fy_months()]
        cells = ",\n       ".join(f'{pv("month_commencing", m, "reduction_per_day")} AS "{m}"' for m in mnames)
        total = " + ".join(f'(CASE WHEN "{m}" IS NULL OR isnan("{m}") THEN 0.0 ELSE "{m}" END)' for m in mnames)
        A(
            "v1_split",
            f"""SELECT *, {re(f'total / CAST({p.v1_year_divisor} AS DOUBLE)', 1)} AS average_needed FROM (
  SELECT *, {total} AS total FROM (
    SELECT icb, provider, treatment_function,
       {cells}
    FROM v1_split_rows GROUP BY icb, provider, treatment_function) w) x""",
            "v1_split_rows",
        )

        # reports (D37-D42)
        A(
            "gap_table",
            f"""SELECT icb, provider, {re('baseline', 0)} AS baseline, {re('actual', 0)} AS actual, {re(t, 0)} AS {t},
       {re('variance', 0)} AS variance, {pct('percent_vs_actual')} AS percent_vs_actual,
       CASE WHEN actual > baseline THEN 'red' WHEN actual = baseline THEN 'highlight'
            WHEN actual < baseline THEN 'green' END AS rag
FROM gap_by_year""",
            "gap_by_year",
        )
        A(
            "scope",
            f"""SELECT 'system' AS report_level, short_name AS report, {titlecase('stp_name')} AS title
FROM system_lookup WHERE short_name <> {q(p.excluded_system)}
UNION ALL SELECT 'region', {q(p.region_report_name)}, {q(p.region_report_title)}
UNION ALL SELECT 'trust', provider_short_name, acute_full_name FROM provider_lookup
WHERE provider_code IN (SELECT provider_code FROM acutes)""",
            "system_lookup",
            "provider_lookup",
            "acutes",
        )
        A(
            "st_rows",
            f"""SELECT icb, provider, treatment_function,
       {re('avg_monthly_activity', 0)} AS average_monthly_activity,
       {re('share_of_monthly_variance', 0)} AS share_of_monthly_reduction,
       {re('avg_activity_per_wd', 0)} AS average_daily_activity,
       {re('share_of_daily_variance', 0)} AS share_of_daily_reduction
FROM fair WHERE provider IS NOT NULL""",
            "fair",
        )
        A(
            "st_prop",
            f"""SELECT r.*, r.share_of_monthly_reduction / t.tot AS proportion_contributed, 'row' AS row_kind
FROM st_rows r JOIN (SELECT icb, provider, {strict('share_of_monthly_reduction')} AS tot FROM st_rows GROUP BY icb, provider) t
  ON r.icb IS NOT DISTINCT FROM t.icb AND r.provider = t.provider""",
            "st_rows",
        )
        nums = ["average_monthly_activity", "share_of_monthly_reduction", "average_daily_activity",
                "share_of_daily_reduction", "proportion_contributed"]
        A(
            "spec_table",
            f"""SELECT *, {pct('proportion_contributed')} AS proportion_text FROM (
  SELECT * FROM st_prop
  UNION ALL
  SELECT icb, provider, 'Total' AS treatment_function, {", ".join(f"{strict(c)} AS {c}" for c in nums)}, 'total' AS row_kind
  FROM st_prop GROUP BY icb, provider) u""",
            "st_prop",
        )

        # reports: the rows that each report's filter keeps, the region's being all
        A(
            "chart",
            f"SELECT icb, provider, month_of_actual, period, activity FROM enriched "
            f"WHERE period IN ('baseline', 'actual', {q(p.target_label)})",
            "enriched",
        )
        A(
            "cov_table",
            f"SELECT icb, provider, {pct('cohort_activity')} AS percentage_represented FROM coverage",
            "coverage",
        )
        for table, feed in (("chart", "chart"), ("gap_table", "gap"), ("cov_table", "coverage"), ("spec_table", "specialty")):
            A(
                f"system_{feed}",
                f"""SELECT g.*, s.report FROM {table} g JOIN (SELECT report FROM scope WHERE report_level = 'system') s
  ON g.icb = s.report
UNION ALL SELECT g.*, {q(p.region_report_name)} AS report FROM {table} g""",
                table,
                "scope",
            )
            A(
                f"trust_{feed}",
                f"""SELECT g.*, s.report FROM {table} g JOIN (SELECT report FROM scope WHERE report_level = 'trust') s
  ON g.provider = s.report""",
                table,
                "scope",
            )

        # data quality (D11, pivot guard)
        def dup(name: str, src: str, keys: str) -> str:
            return f"""SELECT {q(name)} AS pivot, count(*) AS cells,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 END), 0) AS BIGINT) AS duplicated_cells,
       CAST(coalesce(max(n), 0) AS BIGINT) AS max_rows_per_cell
FROM (SELECT count(*) AS n FROM {src} GROUP BY {keys}) x"""

        A(
            "dq_dups",
            "\nUNION ALL\n".join(
                [
                    dup("gap_by_month", "stacked", "month_name_short, fin_month, provider_code, period"),
                    dup("gap_by_month_per_day", "enriched",
                        "month_name_short, fin_month, provider, acute_full_name, icb, month_of_actual, period"),
                    dup("gap_per_day_wide", "gbmpd", "icb, provider, month_name_short"),
                    dup("specialty_gap_per_day_wide", "cmpd", "icb, provider, treatment_function, month_name_short"),
                ]
            ),
            "stacked",
            "enriched",
            "gbmpd",
            "cmpd",
        )

        # joins (J4-J6, J15, J17)
        A(
            "jn_names",
            """SELECT p.der_provider_code, p.stp_code, pl.provider_short_name, pl.acute_full_name,
       pl.stp_code AS lookup_stp_code, sl.stp_name, sl.short_name
FROM (SELECT DISTINCT der_provider_code, stp_code FROM actuals) p
LEFT JOIN provider_lookup pl ON p.der_provider_code IS NOT DISTINCT FROM pl.provider_code
LEFT JOIN system_lookup sl ON p.stp_code IS NOT DISTINCT FROM sl.stp_code""",
            "actuals",
            "provider_lookup",
            "system_lookup",
        )
        A(
            "jn_composite",
            f"""SELECT x.provider_code, x.stp_code, x.rows, pl.provider_short_name,
       pl.provider_short_name IS NOT NULL AS matched
FROM (SELECT provider_code, stp_code, count(*) AS rows FROM ss GROUP BY provider_code, stp_code) x
LEFT JOIN provider_lookup pl ON {nse('x', 'pl', ['provider_code', 'stp_code'])}""",
            "ss",
            "provider_lookup",
        )
        A(
            "jn_case",
            f"""SELECT a.der_provider_code, a.hierarchy_key, h.organisation_code, h.stp_code, h.region_code,
       count(*) AS attendances
FROM (SELECT der_provider_code, {provider_case('der_provider_code', p.join_rules)} AS hierarchy_key FROM att
      WHERE first_attendance IN ('2', '4') AND attendance_status IN ('5', '6')
        AND der_financial_year IN ({q(p.actual_fy)}) AND left(der_provider_code, 1) = 'R') a
LEFT JOIN hier h ON a.hierarchy_key = h.organisation_code
GROUP BY a.der_provider_code, a.hierarchy_key, h.organisation_code, h.stp_code, h.region_code""",
            "att",
            "hier",
        )
        A(
            "jn_cost",
            """SELECT a.der_financial_year, CASE WHEN c.hrg_code_other LIKE 'WF%' THEN 'Y' ELSE 'N' END AS wf_flag,
       count(*) AS attendances, count(c.hrg_code_other) AS with_cost
FROM att a LEFT JOIN att_cost c ON a.opa_ident = c.opa_ident AND a.der_financial_year = c.der_financial_year
GROUP BY ALL""",
            "att",
            "att_cost",
        )

        # scalar functions
        y0 = p.actual_fy_start_year
        fm = fin_month("d")
        A(
            "sc_calendar",
            f"""SELECT d AS date, CAST(day(d) AS INTEGER) AS day_num, strftime(d, '%a') AS day_name,
       CAST(dayofweek(d) + 1 AS INTEGER) AS weekday_num, CAST(month(d) AS INTEGER) AS month_num,
       CAST(year(d) AS INTEGER) AS year_num, strftime(d, '%b') AS month_name_short,
       {fy_label('d', '-')} AS fin_year, {fy_label('d', '/')} AS fin_year_sql, {fm} AS fin_month,
       {first_of_month('d')} AS month_commencing, strftime(d, '%Y%m') AS activity_month,
       strftime(d, '%Y') || '-' || strftime(d, '%m') || '-01' AS month_text,
       CASE WHEN {fm} < 10 THEN make_date({y0}, {fm} + 3, 1) ELSE make_date({y0 + 1}, {fm} - 9, 1) END AS month_of_actual
FROM (SELECT DISTINCT appointment_date AS d FROM att) x""",
            "att",
        )
        A(
            "sc_text",
            f"""SELECT t.der_provider_code, t.treatment_function_code, t.core_hrg,
       left(t.der_provider_code, 3) AS left3, right(t.der_provider_code, 2) AS right2,
       substr(t.der_provider_code, 2) AS tail, substr(r.treatment_function_desc, 5) AS treatment_function,
       t.der_provider_code || t.treatment_function_code AS pair_key, lower(t.der_provider_code) AS lower_code,
       left(t.core_hrg, 2) = 'WF' AS is_wf, t.der_provider_code LIKE 'R%' AS is_r,
       {titlecase("'NHS ' || h.stp_name || ' ' || h.organisation_name")} AS title
FROM (SELECT DISTINCT der_provider_code, treatment_function_code, core_hrg FROM att) t
LEFT JOIN tfc_ref r ON t.treatment_function_code = r.treatment_function_code
LEFT JOIN hier h ON left(t.der_provider_code, 3) = h.organisation_code""",
            "att",
            "tfc_ref",
            "hier",
        )
        A(
            "sc_format",
            f"""SELECT orgcode, dimdatestart, orgtype, sourcetype,
       strftime(dimdatestart, '%d/%m/%Y') AS date_dmy, strftime(dimdatestart, '%d%m%Y') AS date_stamp,
       {re('value / 8.0', 1)} AS value_8th_1dp, {re('value / 8.0', 0)} AS value_8th_0dp,
       {pct('value / 1000.0')} AS value_permille_pct, format('{{:,.0f}}', value * 1000.0) AS value_thousands
FROM planning WHERE planningref = {q(p.planning_ref)}""",
            "planning",
        )

    # -- the oracle per query -------------------------------------------------
    def queries(self) -> dict[str, str]:
        p = self.p
        t = p.target_label
        a = p.v2_target_label
        d = self.select
        SG = ["speciality_activity", "total_activity", "baseline", "variance", "proportion_of_total"]
        CMPD = ["total_activity", "baseline", "variance", "variance_per_wd", "cohort_activity", "cohort_proportion",
                "monthly_reduction", "speciality_activity", "activity_per_wd", "wd_variance_by_spec"]
        FAIR = ["avg_monthly_activity", "share_of_monthly_variance", "avg_activity_per_wd", "share_of_daily_variance"]
        out = {
            "calendar": d("calendar"),
            "monthly_working_days": d("mwd"),
            "holiday_events": d("holidays"),
            "target_year_scalars": d("scalars", ["total_wd"]),
            "extract_activity": d("extract"),
            "planning_baseline": d("baseline", ["value"]),
            "provider_month_totals": d("pmt", ["activity"]),
            "rebase_working_days": d("rebased", ["activity"]),
            "target": d("target_rows", ["activity"]),
            "stack_periods": d("stacked", ["activity"]),
            "gap_by_month": d("gbm", ["baseline", "actual", t, "variance"]),
            "append_variance": d("with_var", ["activity"]),
            "enrich_names": d("enriched", ["activity"]),
            "gap_by_month_per_day": d(
                "gbmpd", ["baseline", "actual", t, "variance", "activity_per_wd", f"{t}_per_wd", "variance_per_wd"]
            ),
            "gap_per_day_wide": d("gap_per_day_wide", list(FIN_MONTHS)),
            "gap_by_year": d("gap_by_year", ["baseline", "actual", t, "variance", "percent_vs_actual", "variance_per_wd"]),
            "gap_by_year_code": d(
                "gap_by_year_code", ["baseline", "actual", t, "variance", "perc_variance", "variance_per_wd"]
            ),
            "extracts_together": d("together"),
            "prepared_attendances_by_scope": d("by_scope"),
            "normalise_provider": d("normalise"),
            "extract_activity_3y": d("extract_3y"),
            "extract_baseline_excl_march": d("extract_excl_march"),
            "extract_march_history": d("extract_history"),
            "hrg_series_baseline": d("hrg_baseline"),
            "follow_up_tracking": d("tracking"),
            "follow_up_tracking_rolled": d("tracking_rolled"),
            "lower_columns": d("extract"),
            "join_working_days": d("bl_wd", ["activity"]),
            "baseline_and_goal": d("bag", ["activity", "adj_activity", "target"]),
            "specialty_share": d("ss", ["speciality_activity", "total_activity", "proportion_of_total"]),
            "specialty_gap": d("sg", SG + [t]),
            "cohort": d("coh", ["speciality_activity", "total_activity", "proportion_of_activity", "avg_monthly_activity"]),
            "semi_cohort": d("members", SG + [t]),
            "cohort_rows": d("crows", SG + [t, "cohort_activity", "cohort_proportion", "monthly_reduction"]),
            "cohort_coverage": d("coverage", ["cohort_activity"]),
            "cohort_monthly_per_day": d("cmpd", CMPD + [t]),
            "fair_share": d("fair", FAIR),
            "specialty_gap_per_day_wide": d("sgpdw", list(FIN_MONTHS)),
            "activity_comparison": d("comparison", ["activity"]),
            "march_counterfactual": d("mcf", ["activity"]),
            "per_day_gap_v1": d("v1_wide", ["baseline", "actual", p.v2_target_label, "variance"]),
            "specialty_split_v1": d(
                "v1_split", [m.isoformat() for m in p.actual_fy_months()] + ["total", "average_needed"]
            ),
            "gap_by_month_per_day_v2": d(
                "gbmpd_v2", ["baseline", "actual", a, "variance", "activity_per_wd", f"{a}_per_wd", "variance_per_wd"]
            ),
            "fair_share_v2": d("fair_v2", ["avg_activity_per_wd", "avg_variance_from_ambition"]),
            "cohort_coverage_v2": d("coverage_v2", ["cohort_activity"]),
            "report_chart_feed": self.build(
                f"SELECT icb, provider, month_of_actual, period, "
                f"CASE WHEN activity = 0 THEN CAST(0 AS DOUBLE) ELSE round(activity, 6) END AS activity FROM enriched "
                f"WHERE period IN ('baseline', 'actual', {q(t)})",
                "enriched",
            ),
            "report_gap_table": d("gap_table", ["baseline", "actual", t, "variance"]),
            "report_coverage_table": self.build(
                f"SELECT icb, provider, {pct('cohort_activity')} AS percentage_represented FROM coverage", "coverage"
            ),
            "report_specialty_table": d(
                "spec_table",
                ["average_monthly_activity", "share_of_monthly_reduction", "average_daily_activity",
                 "share_of_daily_reduction", "proportion_contributed"],
            ),
            "report_scope": d("scope"),
            "report_system_feed": d("system_gap", ["baseline", "actual", t, "variance"]),
            "report_trust_feed": d("trust_gap", ["baseline", "actual", t, "variance"]),
            **{f"report_{kind}_chart_feed": d(f"{kind}_chart", ["activity"]) for kind in ("system", "trust")},
            **{f"report_{kind}_coverage_table": d(f"{kind}_coverage") for kind in ("system", "trust")},
            **{
                f"report_{kind}_specialty_table": d(
                    f"{kind}_specialty",
                    ["average_monthly_activity", "share_of_monthly_reduction", "average_daily_activity",
                     "share_of_daily_reduction", "proportion_contributed"],
                )
                for kind in ("system", "trust")
            },
            "csv_extract_activity": self.build(
                """SELECT CASE WHEN activity % 4 <> 2 THEN month_commencing END AS month_commencing, treatment_function_code,
  treatment_function, der_provider_code, stp_code, CASE WHEN activity % 3 <> 0 THEN CAST(activity AS DOUBLE) END AS activity
FROM extract""",
                "extract",
            ),
            "csv_problems": self.build(
                """SELECT 'activity' AS col, 'a double' AS expected, 'n/a' AS actual, count(*) AS cells, count(*) AS records
FROM extract WHERE activity % 3 = 0 HAVING count(*) > 0
UNION ALL
SELECT 'month_commencing', 'date like %d/%m/%Y', '31/02/1999', count(*), count(*)
FROM extract WHERE activity % 4 = 2 HAVING count(*) > 0""",
                "extract",
            ),
            "per_day_long_v1": self.build(
                f"""SELECT fin_month, month, provider, icb,
  CASE WHEN activity = 0 THEN CAST(0 AS DOUBLE) ELSE round(activity, 6) END AS activity, period,
  CASE WHEN fin_month < 10 THEN make_date({p.actual_fy_start_year}, fin_month + 3, 1)
       WHEN fin_month > 9 THEN make_date({p.actual_fy_start_year + 1}, fin_month - 9, 1) END AS month_of_actual
FROM (SELECT fin_month, month, provider, icb, activity, period FROM v1_named
      UNION SELECT fin_month, month, provider, icb, variance, 'variance' FROM v1_wide) u""",
                "v1_named",
                "v1_wide",
            ),
            "dq_duplicated_cells": self.build(
                """SELECT icb, provider, treatment_function, month_name_short AS name, count(*) AS n_values,
  round(min(wd_variance_by_spec), 6) AS lowest, round(max(wd_variance_by_spec), 6) AS highest,
  round(CASE WHEN count(*) = count(wd_variance_by_spec) THEN sum(wd_variance_by_spec) END, 6) AS total
FROM cmpd WHERE month_name_short IS NOT NULL
GROUP BY icb, provider, treatment_function, month_name_short HAVING count(*) > 1""",
                "cmpd",
            ),
            "dq_months_reported": self.build(
                "SELECT der_provider_code, count(*) AS n FROM hist_pm GROUP BY der_provider_code", "hist_pm"
            ),
            "dq_pivot_duplicates": d("dq_dups"),
            "join_names": d("jn_names"),
            "join_composite_lookup": d("jn_composite"),
            "join_case_key": d("jn_case"),
            "join_cost_flags": d("jn_cost"),
            "scalar_calendar": d("sc_calendar"),
            "scalar_text": d("sc_text"),
            "scalar_format": d("sc_format", ["value_8th_1dp", "value_8th_0dp"]),
        }
        return out


def oracle_sql() -> dict[str, str]:
    out = Oracle().queries()
    p = test_params()
    months = p.actual_fy_months()
    for name, month in (("provisional", months[-1]), ("settled", months[5])):
        cut = Oracle(p.with_(provisional_month=month)).queries()
        out[f"{name}_year_scalars"] = cut["target_year_scalars"]
        out[f"{name}_gap_by_year"] = cut["gap_by_year"]
        out[f"{name}_fair_share"] = cut["fair_share"]
    # final orders: NULLs last, ties by the other columns
    by_april = [("icb", False), ("provider", False), ("Apr", True)]
    orders = {
        "extract": ("extract_activity", [("month_commencing", True)]),
        "monthly_working_days": ("monthly_working_days", [("year_num", False), ("month_num", False), ("month_commencing", False)]),
        "gap_by_month": ("gap_by_month", [("provider_code", False), ("fin_month", False)]),
        "cohort_rows": ("cohort_rows", [("icb", False), ("provider", False), ("fin_month", False), ("treatment_function", False)]),
        "fair_share": ("fair_share", [("icb", False), ("provider", False), ("share_of_daily_variance", True)]),
        "gap_per_day_wide": ("gap_per_day_wide", by_april),
        "specialty_gap_per_day_wide": ("specialty_gap_per_day_wide", by_april),
        "baseline": ("planning_baseline", [("month_commencing", False)]),
    }
    for name, (source, keys) in orders.items():
        ties = [c for c in COLUMNS[name] if c not in dict(keys)]
        by = ", ".join([f'"{c}" {"DESC" if d else "ASC"} NULLS LAST' for c, d in keys] + [f'"{c}" ASC NULLS LAST' for c in ties])
        out[f"ordered_{name}"] = f"SELECT *, row_number() OVER (ORDER BY {by}) AS sort_rank FROM ({out[source]}) final"
    out["tracking_in_batches"] = out["follow_up_tracking_rolled"]
    rows = out["report_system_specialty_table"]
    out["published_specialty_table"] = f"SELECT *, count(*) OVER (PARTITION BY report) AS report_rows FROM ({rows}) x"
    fixed = Oracle(p.with_(calendar_start=dt.date(1996, 1, 1), calendar_end=dt.date(2000, 12, 26)))
    out["activity_by_working_day"] = fixed.build(
        """SELECT c.fin_year, c.fin_month, c.month_name_short, c.working_day, count(*) AS attendances,
       count(DISTINCT a.appointment_date) AS days
FROM att a LEFT JOIN calendar c ON a.appointment_date = c.date GROUP BY ALL""",
        "att",
        "calendar",
    )
    # the laid-out copy gives what the fact itself gives
    for name in ("extract_activity", "extracts_together", "follow_up_tracking", "gap_by_year"):
        out[f"prepared_{name}"] = out[name]
    return out
