"""The reference's own entry point: the pipeline from its CSV extracts and lookups.

The R scripts start from CSV files written by the SQL extracts (actuals and the
planning baseline), three lookup files and the holiday JSON.  ``from_files``
builds the same lazy ``Pipeline`` from those files; the SQL step is skipped
(its output is the input), every other output is available as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params
from ..sources import files
from ..sources.tables import Tables
from .pipeline import Pipeline


def from_frames(
    spark: SparkSession,
    actuals: DataFrame,
    baseline: DataFrame,
    provider_lookup: DataFrame,
    system_lookup: DataFrame,
    params: Params,
    *,
    holidays=None,
    acutes: DataFrame | None = None,
    three_years: DataFrame | None = None,
    history: DataFrame | None = None,
    excl_march: DataFrame | None = None,
) -> Pipeline:
    """A pipeline over already-extracted frames (actuals: month_commencing,
    treatment_function_code, treatment_function, der_provider_code, stp_code,
    activity; baseline: orgcode, orgtype, month_commencing, value).

    The older methods' extracts, of the same columns as actuals, are needed only
    for their outputs: ``three_years`` for the comparison, ``history`` (February
    and March of earlier years) and ``excl_march`` for the per-day method."""
    if acutes is None:
        acutes = spark.createDataFrame([(c,) for c in params.acutes], "provider_code string")
    t = Tables(
        attendance=actuals,  # not read: the extract is given
        tfc_ref=None,
        provider_hierarchy=None,
        attendance_cost=None,
        planning=None,
        hrg_time_series=None,
        provider_lookup=provider_lookup,
        system_lookup=system_lookup,
        acutes=acutes,
        holidays=holidays,
        calendar_bounds=None,
    )
    pl = Pipeline(t, params)
    pl.__dict__["extract"] = actuals.withColumn("activity", F.col("activity").cast("double"))
    pl.__dict__["baseline"] = baseline
    for name, frame in (("extract_3y", three_years), ("extract_history", history), ("extract_excl_march", excl_march)):
        if frame is not None:
            pl.__dict__[name] = frame.withColumn("activity", F.col("activity").cast("double"))
    return pl


def from_files(
    spark: SparkSession,
    actuals_csv: str,
    baseline_csv: str,
    providers_csv: str,
    systems_csv: str,
    params: Params,
    *,
    holidays_json: str | None = None,
    holidays=None,
    three_years_csv: str | None = None,
    history_csv: str | None = None,
    excl_march_csv: str | None = None,
) -> Pipeline:
    """The files of the reference's scripts -> the pipeline.

    ``holidays`` (a frame of dates or a rule ``(spark, start, end) -> frame``)
    is used when there is no holiday file.
    """
    hol = files.read_holidays(spark, holidays_json) if holidays_json else holidays
    pl = from_frames(
        spark,
        files.read_activity_csv(spark, actuals_csv),
        files.read_baseline_csv(spark, baseline_csv),
        files.read_provider_lookup(spark, providers_csv),
        files.read_system_lookup(spark, systems_csv),
        params,
        holidays=hol,
        three_years=files.read_activity_csv(spark, three_years_csv) if three_years_csv else None,
        history=files.read_activity_csv(spark, history_csv) if history_csv else None,
        excl_march=files.read_activity_csv(spark, excl_march_csv) if excl_march_csv else None,
    )
    activity = [x for x in (actuals_csv, three_years_csv, history_csv, excl_march_csv) if x]
    pl.problems = files.csv_problems(spark, baseline_csv, files.BASELINE_SCHEMA)
    for path in activity:
        pl.problems = pl.problems.unionByName(files.csv_problems(spark, path, files.ACTIVITY_SCHEMA))
    return pl
