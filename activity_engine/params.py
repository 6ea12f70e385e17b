"""Run parameters: years, thresholds, provider rules and scope.

The reference hard-codes these in its scripts; here they are one frozen
dataclass so every operator takes them explicitly.  ``Params()`` holds the
reference's own values; ``test_params()`` maps the roles of each year onto the
span of the driver's synthetic tables (see FIXTURES.md).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
# Treatment function codes excluded from every follow-up extract.
EXCLUDED_TFC = (
    "812", "501", "560", "700", "710", "711", "712", "713", "715", "720",
    "721", "722", "723", "724", "725", "726", "727", "199", "499",
)
# Acute trust codes of the region.
ACUTE_CODES = (
    "RHW", "RTH", "RXQ", "RDU", "RHM", "RHU", "R1F", "RN5", "RN7", "RPA",
    "RVV", "RWF", "RTK", "RTP", "RA2", "RPC", "RXC", "RYR",
)
# Provider code rules, applied in order after the trailing-'00' rule.
SELECT_RULES = (("RXH", "RYR"), ("RD7", "RDU"))  # select list / group key
JOIN_RULES = (("RXH", "RYR"),)  # hierarchy join key
# Follow-up tracking extract: merged provider codes and their names.
TRACKING_MERGES = (
    (("RC1",), "RC9", "BEDFORDSHIRE HOSPITALS NHS FOUNDATION TRUST"),
    (("RQ8", "RDD"), "RAJ", "MID AND SOUTH ESSEX NHS FOUNDATION TRUST"),
)
# Follow-up tracking extract: full codes mapped to a short hierarchy key.
TRACKING_KEY_EXACT = (("NX500", "NX5"),)
# English month abbreviations in financial-year order (April first).
FIN_MONTHS = ("Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Jan", "Feb", "Mar")
# Bank holidays of 2017 added in front of the downloaded list.
EXTRA_HOLIDAYS_2017 = (
    "2017-01-02", "2017-04-14", "2017-04-17", "2017-05-01",
    "2017-05-29", "2017-08-28", "2017-12-25", "2017-12-26",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    # financial years, SQL style 'YYYY/YY'
    actual_fy: str = "2022/23"
    baseline_fy: str = "2019/20"
    three_year_fys: tuple[str, ...] = ("2021/22", "2022/23", "2023/24")
    history_fys: tuple[str, ...] = ("2016/17", "2017/18", "2018/19")
    tracking_fys: tuple[str, ...] = ("2019/20", "2020/21", "2021/22", "2022/23")
    # financial years, calendar style 'YYYY-YY'
    target_wd_fy: str = "2023-24"  # working days the baseline is rebased to
    v2_target_wd_fy: str = "2022-23"  # the same for the older (v2) method
    # planning table
    planning_ref: str = "E.M.38"
    planning_dimfyear: str = "2020"
    planning_orgtype: str = "Provider"
    # months (der_activity_month 'YYYYMM')
    excluded_month: str = "202003"
    hrg_month_from: str = "201904"
    hrg_month_to: str = "202003"
    march_counterfactual_date: dt.date = dt.date(2020, 3, 1)
    # scope
    region_code: str = "Y59"
    tracking_region_code: str = "Y61"
    region_report_name: str = "se_region"
    region_report_title: str = "the South East region"
    excluded_system: str = "Non_SE"
    # method constants
    target_factor: float = 0.75
    workbook_target_factor: float = 0.075
    min_share: float = 0.01
    min_avg_monthly: float = 2000.0
    min_month_tally: int = 8  # tally must be strictly greater
    march_divisor: float = 3.0
    v1_year_divisor: float = 12.0
    target_label: str = "target"
    v2_target_label: str = "ambition"
    # codes and rules
    excluded_tfc: tuple[str, ...] = EXCLUDED_TFC
    acutes: tuple[str, ...] = ACUTE_CODES
    select_rules: tuple[tuple[str, str], ...] = SELECT_RULES
    join_rules: tuple[tuple[str, str], ...] = JOIN_RULES
    tracking_merges: tuple = TRACKING_MERGES
    tracking_key_exact: tuple[tuple[str, str], ...] = TRACKING_KEY_EXACT
    # calendar: explicit range, or None to span the financial years of the data
    calendar_start: dt.date | None = dt.date(2017, 1, 1)
    calendar_end: dt.date | None = dt.date(2025, 12, 26)
    extra_holidays: tuple[str, ...] = EXTRA_HOLIDAYS_2017
    # drop months >= this
    exclude_from_month: dt.date | None = None
    # A month of the actual year that may not be final (2023-03-01 in the reference, where the rule is switched off):
    # while no actual month is later, it is left out of the actuals, the baseline and the year's scalars.
    provisional_month: dt.date | None = None

    # -- derived values ---------------------------------------------------
    @property
    def actual_fy_start_year(self) -> int:
        return int(self.actual_fy[:4])

    @property
    def target_wd_fy_start_year(self) -> int:
        return int(self.target_wd_fy[:4])

    @property
    def provisional_baseline_month(self) -> dt.date:
        """The provisional month's counterpart in the baseline year."""
        shift = int(self.baseline_fy[:4]) - self.actual_fy_start_year
        return self.provisional_month.replace(year=self.provisional_month.year + shift)

    def actual_fy_months(self) -> list[dt.date]:
        """First day of each month of the actual financial year, April first."""
        y = self.actual_fy_start_year
        return [dt.date(y + (m < 4), m, 1) for m in (4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3)]

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def test_params() -> Params:
    """Year roles and codes mapped onto the driver's tables (1995-01 .. 2001-11)."""
    return Params(
        actual_fy="1999/00",
        baseline_fy="1997/98",
        three_year_fys=("1998/99", "1999/00", "2000/01"),
        history_fys=("1994/95", "1995/96", "1996/97"),
        tracking_fys=("1997/98", "1998/99", "1999/00", "2000/01"),
        target_wd_fy="2000-01",
        v2_target_wd_fy="1999-00",
        planning_dimfyear="1998",
        excluded_month="199803",
        hrg_month_from="199704",
        hrg_month_to="199803",
        march_counterfactual_date=dt.date(1998, 3, 1),
        region_code="Y0",
        tracking_region_code="Y1",
        region_report_name="all_regions",
        region_report_title="the whole region",
        acutes=(),  # taken from the nation table, see sources.testmap
        select_rules=(("R02", "R01"), ("R07", "R06")),
        join_rules=(("R02", "R01"),),
        tracking_merges=(
            (("R13",), "R18", "MERGED TRUST ONE"),
            (("R14", "R23"), "R24", "MERGED TRUST TWO"),
        ),
        tracking_key_exact=(("R1900", "R24"),),
        calendar_start=None,
        calendar_end=None,
        extra_holidays=("1995-04-14", "1995-04-17"),
    )
