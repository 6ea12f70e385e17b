"""A full report run: every output of the reference's main script in one Spark application.

The only fact-sized work is the extracts.  They are computed once and cut from
their lineage with a reliable ``checkpoint()`` into the cluster's shared
checkpoint folder (``spark.checkpoint.dir``), so the dozen downstream outputs
neither re-scan the fact nor depend on executors that may be gone.  Each
output is then one distributed write; the per-system and per-trust copies
are partitions of one write.

    python -m activity_engine.plans.run --sf-dir /data/sf0.1 --out /shared/out
    python -m activity_engine.plans.run --actuals a.csv --baseline b.csv --providers p.csv --systems s.csv --out /shared/out
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from ..params import Params, test_params
from ..session import build_session, checkpoint_dir, configure
from ..sinks.writers import ORDER, publish, write_table
from ..sources.tables import Tables
from ..sources.testmap import load_tables, prepare_fact
from .files_pipeline import from_files
from .pipeline import REPORT_TABLES, Pipeline


CSV_INPUTS = ("actuals", "baseline", "providers", "systems")


def materialize_inputs(pl: Pipeline) -> Pipeline:
    """Checkpoint the fact-derived tables the downstream outputs share."""
    checkpoint_dir(pl.t.attendance.sparkSession)
    for name in ("extract", "baseline"):
        df = getattr(pl, name)
        pl.__dict__[name] = df.checkpoint(eager=True)
    # dependent cached properties must be rebuilt from the checkpointed frames
    for name in ("actuals",):
        pl.__dict__.pop(name, None)
    return pl


def run_reports(spark: SparkSession, tables: Tables, params: Params, out_root: str, *, fmt: str = "parquet",
                day: dt.date | None = None) -> dict[str, str]:
    return write_reports(spark, Pipeline(tables, params), out_root, fmt=fmt, day=day)


def write_reports(spark: SparkSession, pipeline: Pipeline, out_root: str, *, fmt: str = "parquet",
                  day: dt.date | None = None) -> dict[str, str]:
    configure(spark)
    pl = materialize_inputs(pipeline)
    root = out_root.rstrip("/")
    written: dict[str, str] = {}

    def out(name: str, df, order=None, partition_by=None):
        path = f"{root}/{name}"
        write_table(df, path, fmt=fmt, order=order, partition_by=partition_by, rank=order is not None)
        written[name] = path

    out("baseline_and_goal", pl.baseline_and_goal)  # K1
    out("gap_by_month", pl.gap_by_month, ORDER["gap_by_month"])
    out("gap_by_year", pl.gap_by_year)
    out("gap_per_day_wide", pl.gap_per_day_wide, ORDER["wide_by_april"])
    out("cohort_rows", pl.cohort_rows, ORDER["cohort_rows"])
    out("fair_share", pl.fair_share, ORDER["fair_share"])
    out("specialty_gap_per_day_wide", pl.specialty_gap_per_day_wide, ORDER["wide_by_april"])
    out("report_chart_feed", pl.report_chart_feed)
    out("report_coverage_table", pl.report_coverage_table)
    out("report_specialty_table", pl.report_specialty_table)
    out("report_scope", pl.report_scope)
    for table in REPORT_TABLES:
        suffix = "" if table == "gap_table" else f"_{table}"
        for kind, feed in (("systems", pl.system_report(table)), ("trusts", pl.trust_report(table))):  # K2, K3
            written[f"{kind}{suffix}"] = publish(spark, feed, root, f"{kind}{suffix}", day, fmt)
    if pl.problems is not None:
        out("problems", pl.problems)  # cells of the CSV inputs that could not be read
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf-dir", default=None, help="folder with the driver's parquet tables")
    for name in CSV_INPUTS:
        ap.add_argument(f"--{name}", default=None, help=f"CSV of the {name}; all {len(CSV_INPUTS)} are needed without --sf-dir")
    ap.add_argument("--holidays", default=None, help="JSON of the bank holidays, with the CSV inputs")
    ap.add_argument("--out", required=True, help="output root on the shared file system")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--master", default=None)
    ap.add_argument("--prepare", default=None,
                    help="shared folder: write the derived attendance there once (partitioned by year) and read it back")
    a = ap.parse_args(argv)
    paths = [getattr(a, name) for name in CSV_INPUTS]
    if (a.sf_dir is None) != all(paths) or (a.sf_dir and any(paths)):
        ap.error("give either --sf-dir or all of " + ", ".join(f"--{name}" for name in CSV_INPUTS))
    spark = build_session(a.master)
    if a.sf_dir is None:
        pl = from_files(spark, *paths, Params(), holidays_json=a.holidays)
        for k, v in write_reports(spark, pl, a.out, fmt=a.format).items():
            print(f"{k}\t{v}")
        return
    params = test_params()
    if a.prepare:
        prepare_fact(spark, a.sf_dir, a.prepare, params)
    tables = load_tables(spark, a.sf_dir, params, prepared=a.prepare)
    written = run_reports(spark, tables, params, a.out, fmt=a.format)
    for k, v in written.items():
        print(f"{k}\t{v}")


if __name__ == "__main__":
    main()
