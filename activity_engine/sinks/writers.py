"""Sinks (K1-K4): every output is one distributed write.

The reference writes a workbook and renders one report per system and per
trust in a loop.  Here each output is written by one job; the per-report
copies are a ``report`` column used as the partition key, so there is no
driver loop and no collect.  Sorting happens only here, on the small final
tables, as the last step before the write.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Final orderings of the reference outputs (O1-O3): (column, descending)
ORDER = {
    "extract": [("month_commencing", True)],
    "monthly_working_days": [("year_num", False), ("month_num", False), ("month_commencing", False)],
    "gap_by_month": [("provider_code", False), ("fin_month", False)],
    "cohort_rows": [("icb", False), ("provider", False), ("fin_month", False), ("treatment_function", False)],
    "fair_share": [("icb", False), ("provider", False), ("share_of_daily_variance", True)],
    "wide_by_april": [("icb", False), ("provider", False), ("Apr", True)],
    "planning_baseline": [("month_commencing", False)],
}


def ordered(df: DataFrame, spec: list[tuple[str, bool]]) -> DataFrame:
    """dplyr ``arrange``: NULLs last in both directions."""
    keys = [F.col(f"`{c}`").desc_nulls_last() if desc else F.col(f"`{c}`").asc_nulls_last() for c, desc in spec]
    return df.orderBy(*keys)


def ranked(df: DataFrame, spec: list[tuple[str, bool]], name: str = "sort_rank") -> DataFrame:
    """The rows with their place in the final order: NULLs last, ties by the other columns from left to right.

    An order is lost when the rows are read back by many tasks; the column keeps it.
    Only for final tables, of providers x specialties x months rows at most: the
    numbering puts them in one task.
    """
    keys = [F.col(f"`{c}`").desc_nulls_last() if desc else F.col(f"`{c}`").asc_nulls_last() for c, desc in spec]
    ties = [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in {x for x, _ in spec}]
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys, *ties)).cast("bigint"))


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", order: list[tuple[str, bool]] | None = None,
                partition_by: list[str] | None = None, mode: str = "overwrite", rank: bool = False) -> None:
    """K1: write one result table (parquet by default, or CSV with a header); with ``rank``, also each row's place in the order."""
    if order and rank:
        df, order = ranked(df, order), [("sort_rank", False)]
    out = ordered(df, order) if order else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def run_stamp(day: dt.date | None = None) -> str:
    """The reference's ``format(Sys.Date(), '%d%m%Y')`` output suffix."""
    return (day or dt.date.today()).strftime("%d%m%Y")


def write_report_feeds(feed: DataFrame, root: str, kind: str, day: dt.date | None = None, fmt: str = "parquet") -> str:
    """K2/K3: all reports of one kind in one job, a folder per report value.

    ``root/<kind>/<ddmmyyyy>/report=<name>/`` (e.g. kind 'systems', 'trusts').
    """
    path = f"{root.rstrip('/')}/{kind}/{run_stamp(day)}"
    write_table(feed, path, fmt=fmt, partition_by=["report"])
    return path


#: What is published: one row for each report of a run, written after all its rows.
MANIFEST = "kind string, day string, run string, report string, rows long, schema string, published timestamp"


def publish(spark: SparkSession, feed: DataFrame, root: str, kind: str, day: dt.date | None = None, fmt: str = "parquet") -> str:
    """K2/K3, safe to fail and to repeat: the reports of a day as a new version, valid once its manifest is there.

    The rows go to ``root/kind/<ddmmyyyy>/run=<id>/report=<name>/``; then the manifest
    gets a row for each report with the number of rows that are in the files. Readers
    (``published``) take the newest run in the manifest, so a run that fails midway
    leaves the day as it was, and a repeated one replaces it.
    """
    run, stamp = uuid.uuid4().hex, run_stamp(day)
    path = f"{root.rstrip('/')}/{kind}/{stamp}/run={run}"
    write_table(feed, path, fmt=fmt, partition_by=["report"])
    written = _rows_of(spark, path, fmt, feed.schema).groupBy("report").agg(F.count(F.lit(1)).alias("rows"))
    none = spark.createDataFrame([(None, 0)], "report string, rows long")  # a run without rows is published too
    mark = written.unionByName(none).select(
        F.lit(kind).alias("kind"), F.lit(stamp).alias("day"), F.lit(run).alias("run"), "report", "rows",
        F.lit(feed.schema.json()).alias("schema"), F.current_timestamp().alias("published"),
    )
    mark.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return path


def _rows_of(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    options = {"header": "true"} if fmt == "csv" else {}
    # the partition column comes last in the files' own order of columns
    stored = T.StructType([*[f for f in schema if f.name != "report"], T.StructField("report", T.StringType())])
    return spark.read.format(fmt).options(**options).schema(stored).load(path).select(*schema.names)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The reports of the newest complete run of each kind and day."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest")
    newest = Window.partitionBy("kind", "day").orderBy(F.col("published").desc(), F.col("run"))
    last = rows.select("kind", "day", "run", "published").distinct().withColumn("n", F.row_number().over(newest)).where("n = 1")
    return rows.join(last.select("kind", "day", "run"), ["kind", "day", "run"], "left_semi")


def published(spark: SparkSession, root: str, kind: str, day: dt.date | None = None, fmt: str = "parquet") -> DataFrame:
    """The rows of a day's reports, of its newest complete run; fails if a report's rows are not all there."""
    stamp = run_stamp(day)
    reports = manifest(spark, root).where((F.col("kind") == kind) & (F.col("day") == stamp)).collect()  # one row for each report
    if not reports:
        raise ValueError(f"nothing is published as {kind} for {stamp}")
    path = f"{root.rstrip('/')}/{kind}/{stamp}/run={reports[0].run}"
    rows = _rows_of(spark, path, fmt, T.StructType.fromJson(json.loads(reports[0].schema)))
    have = {r.report: r.n for r in rows.groupBy("report").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r.report: r.rows for r in reports if r.rows}
    if have != want:
        raise ValueError(f"{path} holds {have}, its manifest says {want}")
    return rows


def add_tracking(rows: DataFrame, path: str, batch: str, keys: list[str] | None = None) -> None:
    """K4 in increments: one batch of new attendances, counted, into a table partitioned by batch and month.

    A batch is replaced as a whole, so adding it again changes nothing. The merge by
    key is a sum over batches and is left to the reader; no earlier file is touched.
    """
    keys = keys or [c for c in rows.columns if c != "appointments"]
    counted = rows.groupBy(*keys).agg(F.sum("appointments").alias("appointments"))
    counted.write.mode("overwrite").partitionBy("activity_month_year").parquet(f"{path.rstrip('/')}/batch={batch}")


def tracking_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """K4: all batches merged by key, with the columns in the given order."""
    keys = [c for c in columns if c != "appointments"]
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*")
    return rows.groupBy(*keys).agg(F.sum("appointments").alias("appointments")).select(*columns)


def save_tracking_table(df: DataFrame, table: str, mode: str = "overwrite") -> None:
    """K4: the follow-up tracking rows as a catalog table."""
    df.write.mode(mode).saveAsTable(table)
