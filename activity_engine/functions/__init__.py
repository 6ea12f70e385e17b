"""Expression helpers (built-in Spark functions only, no UDFs)."""

from .dates import (
    activity_month,
    date_text_first_of_month,
    fin_month,
    fin_year,
    first_of_month,
    fy_start_year,
    month_abbr,
    month_of_fin_month,
    weekday_abbr,
    yyyymm_to_iso,
)
from .formatting import date_text, percent_text, thousands
from .semantics import (
    left_join,
    ratio,
    round_half_even,
    semi_join,
    strict_sum,
    strict_sum_over,
    sum_na_rm,
    union_distinct,
)
from .text import provider_code, title_case_nhs

__all__ = [
    "activity_month", "date_text_first_of_month", "fin_month", "fin_year", "first_of_month", "fy_start_year",
    "month_abbr", "month_of_fin_month", "weekday_abbr", "yyyymm_to_iso",
    "date_text", "percent_text", "thousands",
    "left_join", "ratio", "round_half_even", "semi_join", "strict_sum",
    "strict_sum_over", "sum_na_rm", "union_distinct",
    "provider_code", "title_case_nhs",
]
