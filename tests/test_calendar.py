import datetime as dt

from pyspark.sql import functions as F

from activity_engine.operators import calendar as cal_ops
from activity_engine.params import Params
from activity_engine.sources.tables import Tables


def tables_with_holidays(spark, holidays):
    dummy = spark.range(1)
    hol = spark.createDataFrame([(d,) for d in holidays], "date date") if holidays is not None else None
    return Tables(*(dummy,) * 9, holidays=hol, calendar_bounds=None)


def test_calendar_flags_weekends_and_holidays(spark):
    p = Params(calendar_start=dt.date(2023, 4, 1), calendar_end=dt.date(2023, 4, 30), extra_holidays=("2023-04-07",))
    t = tables_with_holidays(spark, [dt.date(2023, 4, 10), dt.date(2023, 4, 10)])  # duplicate kept in source
    cal = cal_ops.calendar(t, p)
    rows = {r.date: r for r in cal.collect()}
    assert len(rows) == 30
    assert rows[dt.date(2023, 4, 1)].working_day == "no"  # Saturday
    assert rows[dt.date(2023, 4, 2)].working_day == "no"  # Sunday
    assert rows[dt.date(2023, 4, 7)].working_day == "no"  # literal extra holiday
    assert rows[dt.date(2023, 4, 10)].working_day == "no"  # holiday from the source
    assert rows[dt.date(2023, 4, 11)].working_day == "yes"
    r = rows[dt.date(2023, 4, 11)]
    assert (r.day_num, r.day_name, r.month_num, r.year_num, r.month_name_short, r.fin_year, r.fin_month) == (
        11, "Tue", 4, 2023, "Apr", "2023-24", 1)
    assert cal_ops.holiday_events(t, p).count() == 3  # rbind keeps duplicates


def test_monthly_working_days_sum_to_working_days(spark):
    p = Params(calendar_start=dt.date(2023, 1, 1), calendar_end=dt.date(2023, 12, 26), extra_holidays=())
    t = tables_with_holidays(spark, [dt.date(2023, 12, 25), dt.date(2023, 12, 26)])
    cal = cal_ops.calendar(t, p)
    mwd = cal_ops.monthly_working_days(cal)
    yes = cal.where(F.col("working_day") == "yes").count()
    assert mwd.agg(F.sum("working_days")).first()[0] == yes
    dec = mwd.where(F.col("month_num") == 12).first()
    assert dec.working_days == 16  # 1..26 Dec 2023 minus weekends and the two holidays
    assert dec.month_commencing == dt.date(2023, 12, 1)
    s = cal_ops.year_scalars(mwd, "2023-24").first()
    assert s.month_count == 9 and s.total_wd > 0  # Apr..Dec of 2023-24 inside the range


def test_calendar_from_data_span(spark):
    from activity_engine.params import test_params
    from activity_engine.sources.testmap import load_tables

    from conftest import SF_SMALL

    t = load_tables(spark, SF_SMALL, test_params())
    start, end = spark.range(1).select(*cal_ops.resolve_bounds(t, test_params())).first()
    assert (start, end) == (dt.date(1994, 4, 1), dt.date(2002, 3, 31))
