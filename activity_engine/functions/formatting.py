"""Report text formatting: percentages, thousands separators, date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def percent_text(x, digits: int = 1) -> Column:
    """``formattable::percent(x, digits, format = 'f')``: 100*x with that many decimals, then '%' ('12.3%').

    Infinite values print as 'Inf' / '-Inf' without the sign, NULL and NaN
    stay NULL.
    """
    x = _c(x).cast("double")
    r = F.bround(x * 100.0, digits)
    r = F.when(r == 0, F.lit(0.0)).otherwise(r)  # no '-0'
    body = F.format_string(f"%.{digits}f", r)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
        .when(x == float("inf"), F.lit("Inf"))
        .when(x == float("-inf"), F.lit("-Inf"))
        .otherwise(F.concat(body, F.lit("%")))
    )


def thousands(x, digits: int = 0) -> Column:
    """Number with ',' thousands separator (report tables)."""
    return F.format_number(_c(x).cast("double"), digits)


def date_text(d, pattern: str = "dd/MM/yyyy") -> Column:
    """``CONVERT(varchar, d, 103)`` / ``format(d, '%d/%m/%Y')``."""
    return F.date_format(_c(d), pattern)
