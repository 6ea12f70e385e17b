"""Calendar expressions: financial year / month, labels, first of month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def fy_start_year(d) -> Column:
    """Year in which the April-start financial year of ``d`` begins."""
    d = _c(d)
    return F.when(F.month(d) >= 4, F.year(d)).otherwise(F.year(d) - 1)


def fin_year(d, sep: str = "-") -> Column:
    """Financial year label 'YYYY-YY' (calendar) or 'YYYY/YY' (SQL tables)."""
    y = fy_start_year(d)
    return F.concat(y.cast("string"), F.lit(sep), F.substring((y + 1).cast("string"), 3, 2))


def fin_month(d) -> Column:
    """1 = April ... 12 = March."""
    m = F.month(_c(d))
    return F.when(m <= 3, m + 9).otherwise(m - 3)


def first_of_month(d) -> Column:
    """``CAST(DATEADD(day, 1, EOMONTH(d, -1)) AS DATE)``."""
    return F.trunc(_c(d).cast("date"), "MM")


def month_abbr(d) -> Column:
    """English short month label, 'Jan' .. 'Dec'."""
    return F.date_format(_c(d), "MMM")


def weekday_abbr(d) -> Column:
    """English short weekday label, 'Sun' .. 'Sat'."""
    return F.date_format(_c(d), "E")


def activity_month(d) -> Column:
    """'YYYYMM' text of a date."""
    return F.date_format(_c(d), "yyyyMM")


def month_of_fin_month(fin_month_col, fy_start: int) -> Column:
    """First day of financial month ``fin_month`` of the year starting in ``fy_start``."""
    fm = _c(fin_month_col)
    return F.make_date(
        F.when(fm < 10, F.lit(fy_start)).otherwise(F.lit(fy_start + 1)),
        F.when(fm < 10, fm + 3).otherwise(fm - 9),
        F.lit(1),
    )


def yyyymm_to_iso(m) -> Column:
    """'YYYYMM' -> 'YYYY-MM-01' (text, as the T-SQL concatenation)."""
    m = _c(m)
    return F.concat(F.substring(m, 1, 4), F.lit("-"), F.substring(m, -2, 2), F.lit("-01"))


def date_text_first_of_month(d) -> Column:
    """``CONVERT(varchar, first-of-month(d), 103)``: 'dd/MM/yyyy' text."""
    return F.date_format(first_of_month(d), "dd/MM/yyyy")
