"""Daily calendar with working days (D1) and working days per month.

Both tables are bounded by the calendar range (one row per day, one per
month), so they are safe to broadcast into the fact-derived joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fin_month, fin_year, month_abbr, weekday_abbr
from ..functions.semantics import left_join
from ..params import Params
from ..sources.tables import Tables

SATURDAY, SUNDAY = 7, 1  # dayofweek: 1 = Sunday ... 7 = Saturday


def resolve_bounds(tables: Tables, params: Params) -> tuple[Column, Column]:
    """Calendar range as expressions: explicit parameters, else the span of the data.

    The data span is a value from stored metadata where the tables have it, else
    a scalar subquery (a min/max over one date column) in every plan that needs it.
    Either is that of the current files.
    """
    if params.calendar_start is not None and params.calendar_end is not None:
        return F.lit(params.calendar_start), F.lit(params.calendar_end)
    if tables.calendar_range is not None:
        start, end = tables.calendar_range
        return F.lit(start).cast("date"), F.lit(end).cast("date")
    if tables.calendar_bounds is None:
        raise ValueError("no calendar range: set Params.calendar_start/end or Tables.calendar_bounds")
    b = tables.calendar_bounds
    return b.select("start_date").scalar(), b.select("end_date").scalar()


def holiday_events(tables: Tables, params: Params, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Holiday dates: the literal extra rows in front, then the source list.

    Duplicates are kept (``rbind``); membership tests use the distinct set.
    ``tables.holidays`` is a table of dates, or a callable of the calendar
    range returning one (rule-based holidays).
    """
    spark = tables.provider_lookup.sparkSession
    extra = spark.createDataFrame([(d,) for d in params.extra_holidays], "date string").select(
        F.to_date("date").alias("date")
    )
    src = tables.holidays
    if src is None:
        return extra
    if callable(src):
        src = src(spark, *(bounds if bounds is not None else resolve_bounds(tables, params)))
    return extra.unionByName(src.select(F.col("date").cast("date").alias("date")))


def calendar(tables: Tables, params: Params, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per day with labels, financial year/month and working-day flag."""
    start, end = bounds if bounds is not None else resolve_bounds(tables, params)
    spark = tables.provider_lookup.sparkSession
    # one partition: the whole calendar is a few thousand rows, and its aggregates need no exchange
    days = spark.range(0, 1, 1, 1).select(
        F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("date")
    )
    # the range's holidays only, a few dates per year: one partition, so the distinct needs no exchange
    hol = holiday_events(tables, params, (start, end)).where(F.col("date").between(start, end)).coalesce(1).distinct().select(
        F.col("date").alias("h_date"), F.lit(True).alias("is_holiday")
    )
    # bounded: a handful of dates per year of the range
    days = days.join(F.broadcast(hol), days.date == hol.h_date, "left")
    dow = F.dayofweek("date")
    weekend = dow.isin(SUNDAY, SATURDAY)
    holiday = F.coalesce(F.col("is_holiday"), F.lit(False))
    return days.select(
        F.col("date"),
        F.dayofmonth("date").alias("day_num"),
        weekday_abbr("date").alias("day_name"),
        F.month("date").alias("month_num"),
        F.year("date").alias("year_num"),
        month_abbr("date").alias("month_name"),
        month_abbr("date").alias("month_name_short"),
        fin_year("date", "-").alias("fin_year"),
        fin_month("date").alias("fin_month"),
        F.when(weekend | holiday, F.lit("no")).otherwise(F.lit("yes")).alias("working_day"),
    )


class DateDim:
    """The calendar's per-date attributes as expressions over a date column.

    Looking a date up in the generated calendar (a left join on ``date``) gives
    its labels when the date lies in the calendar range and NULLs otherwise.
    These attributes are functions of the date, so ``attach_calendar`` computes
    them in place, guarded by the range: same result, no join and no calendar
    generation in the plan.  Working-day counts still come from the calendar.
    """

    def __init__(self, start: Column, end: Column):
        self.start, self.end = start, end

    def attrs(self, d) -> dict:
        d = F.col(d) if isinstance(d, str) else d
        inside = d.between(self.start, self.end)
        exprs = {
            "date": d,
            "day_num": F.dayofmonth(d),
            "day_name": weekday_abbr(d),
            "month_num": F.month(d),
            "year_num": F.year(d),
            "month_name": month_abbr(d),
            "month_name_short": month_abbr(d),
            "fin_year": fin_year(d, "-"),
            "fin_month": fin_month(d),
        }
        return {k: F.when(inside, v) for k, v in exprs.items()}


def attach_calendar(df: DataFrame, key: str, cal, cols: list[str], *, first_of_month_only: bool = False) -> DataFrame:
    """Left join of ``df`` to the calendar on ``key = date``, adding ``cols``.

    ``cal`` is a calendar DataFrame (joined, broadcast: bounded by the range)
    or a ``DateDim`` (computed in place).  ``first_of_month_only`` matches only
    calendar rows with ``day_num == 1``.
    """
    if isinstance(cal, DateDim):
        a = cal.attrs(key)
        if first_of_month_only:
            a = {k: F.when(F.dayofmonth(F.col(key)) == 1, v) for k, v in a.items()}
        return df.withColumns({c: a[c] for c in cols})
    c = cal.where(F.col("day_num") == 1) if first_of_month_only else cal
    return left_join(df, c.select("date", *cols), {key: "date"}, broadcast=True)


def monthly_working_days(cal: DataFrame) -> DataFrame:
    """Count of working days per month (months without any are absent)."""
    return (
        cal.where(F.col("working_day") == "yes")
        .groupBy("month_name_short", "month_num", "year_num", "fin_year", "fin_month")
        .agg(F.count(F.lit(1)).alias("working_days"))
        .select(
            "month_name_short",
            "month_num",
            "year_num",
            F.make_date("year_num", "month_num", F.lit(1)).alias("month_commencing"),
            "fin_year",
            "fin_month",
            "working_days",
        )
    )


def as_values(df: DataFrame) -> DataFrame:
    """A small table computed now and put into plans as its values.

    For tables with a row for each month of the calendar's range or fewer: every
    branch that uses one would otherwise generate the calendar again.
    """
    return df.sparkSession.createDataFrame(df.toArrow())


def trimmed_working_days(mwd: DataFrame) -> DataFrame:
    """The four columns the rebasing uses (month_commencing as a date)."""
    return mwd.select("month_commencing", "month_name_short", "fin_year", "working_days")


def activity_by_working_day(attendance: DataFrame, cal: DataFrame) -> DataFrame:
    """Attendances by calendar month and kind of day; dates outside the calendar's range have no labels."""
    per_day = attendance.groupBy("appointment_date").agg(F.count(F.lit(1)).alias("attendances"))
    labels = cal.select("date", "fin_year", "fin_month", "month_name_short", "working_day")
    j = left_join(per_day, labels, {"appointment_date": "date"}, broadcast=True)
    return j.groupBy("fin_year", "fin_month", "month_name_short", "working_day").agg(
        F.sum("attendances").alias("attendances"), F.count(F.lit(1)).alias("days")
    )


def year_working_days(mwd: DataFrame, fin_year_label: str, name: str = "working_days_target") -> DataFrame:
    """Working days of each month of one financial year, keyed by month label."""
    return mwd.where(F.col("fin_year") == fin_year_label).select(
        "month_name_short", F.col("working_days").alias(name)
    )


def is_provisional(actuals: DataFrame, month: dt.date) -> Column:
    """Whether no month of the actuals is later than ``month``, as a scalar subquery.

    Without any month the answer is yes, as the maximum of nothing is below all dates.
    """
    newest = actuals.agg(F.max("month_commencing").alias("newest")).select("newest").scalar()
    return F.coalesce(newest <= F.lit(month), F.lit(True))


def without_month(df: DataFrame, provisional: Column | None, month: object, col: str = "month_commencing") -> DataFrame:
    """The rows, less those of ``month`` (and those without one, as ``filter`` drops NA) while it is provisional."""
    if provisional is None:
        return df
    return df.where(F.when(provisional, F.col(col) != F.lit(month)).otherwise(F.lit(True)))


def year_scalars(mwd: DataFrame, fin_year_label: str) -> DataFrame:
    """A10: one row ``(month_count, total_wd)`` for a financial year."""
    return mwd.where(F.col("fin_year") == fin_year_label).agg(
        F.count(F.lit(1)).alias("month_count"),
        F.coalesce(F.sum("working_days"), F.lit(0)).cast("double").alias("total_wd"),
    )
