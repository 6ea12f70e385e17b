"""Stored facts about the input files and a laid-out copy of the attendance fact.

Two things that every plan would otherwise work out again from the whole fact:

* ``DateSpans``: the first and last date of each file, kept in a small table in the
  shared folder. A file is known by its path, modification time and length, so
  a new or rewritten file is scanned once (its date column alone) and the others not at all.
* ``prepared_fact``: attendance and cost written once for each state of the files,
  partitioned by financial year, bucketed and sorted by the cost join's key.
  Year filters prune partitions, also at run time from a lookup of years, and the
  attendance-cost join needs no exchange.

The state of the files is read with Spark's own file source (names only, not
contents), so any file system that Spark reads will do.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: The cost join's key as stored: a bucket's columns can't be partition columns, so the year is kept twice.
BUCKET_KEY = ("opa_ident", "year_key")


def files_of(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, modified, length) of the data files under the paths; nothing is read from them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(list(paths))
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def state_of(spark: SparkSession, *paths: str) -> str:
    """A name for the present state of the files: it changes when one is added, removed or rewritten."""
    h = F.xxhash64("path", F.col("modified").cast("string"), "length").cast("decimal(38,0)")
    one = files_of(spark, *paths).agg(F.count("*").alias("n"), F.sum(h).alias("h")).select(
        F.substring(F.sha2(F.concat_ws(":", "n", "h", *[F.lit(p) for p in paths]), 256), 1, 16).alias("state")
    )
    return one.first().state


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


class DateSpans:
    """First and last date of each file of a table, kept in ``root`` and brought up to date when asked."""

    SCHEMA = "path string, modified timestamp, length long, low date, high date"
    _KEY = ("path", "modified", "length")
    #: File versions seen by this process; a version never changes.
    _known: dict[tuple, tuple[dt.date | None, dt.date | None]] = {}

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, f"{root or checkpoint_dir(spark)}/date-spans"

    def of(self, path: str, column: str, schema: str) -> tuple[dt.date | None, dt.date | None]:
        """The table's first and last date (nulls without any)."""
        now = [tuple(r) for r in files_of(self.spark, path).collect()]  # one row for each file
        if any((column, *f) not in self._known for f in now):
            self._read(path, column)
        new = [f for f in now if (column, *f) not in self._known]
        if new:
            self._scan(path, column, schema, new)
        spans = [self._known[(column, *f)] for f in now]
        lows, highs = [a for a, _ in spans if a is not None], [b for _, b in spans if b is not None]
        return min(lows, default=None), max(highs, default=None)

    def _place(self, column: str) -> str:
        return f"{self.root}/{column}"

    def _read(self, path: str, column: str) -> None:
        stored = _stored(self.spark, self._place(column), self.SCHEMA)
        if stored is not None:
            here = stored.where(F.col("path").startswith(path) | F.lit("/" in path) & F.col("path").contains(path.rsplit("/", 1)[-1]))
            self._known.update({(column, *r[:3]): (r[3], r[4]) for r in map(tuple, here.collect())})

    def _scan(self, path: str, column: str, schema: str, new: list[tuple]) -> None:
        day = F.col(column).cast("date")
        name = F.col("_metadata.file_path")
        found = self.spark.read.schema(schema).parquet(*[f[0] for f in new]).groupBy(name.alias("path"))
        low_high = {r.path: (r.low, r.high) for r in found.agg(F.min(day).alias("low"), F.max(day).alias("high")).collect()}
        rows = [(*f, *low_high.get(f[0], (None, None))) for f in new]  # a file without rows has no span
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self._place(column))
        self._known.update({(column, *r[:3]): r[3:] for r in rows})


class PreparedFact:
    """Where a laid-out fact is and the catalog tables that name its buckets."""

    TABLES = ("attendance", "attendance_cost")

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _name(self, table: str) -> str:
        return f"{table}_{uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex[:16]}"

    @property
    def complete(self) -> bool:
        """Whether both tables were written to the end (the mark is written last)."""
        return _stored(self.spark, f"{self.root}/complete", "buckets int") is not None

    def write(self, **tables: DataFrame | Callable[[PreparedFact], DataFrame]) -> PreparedFact:
        """Both tables, one file for each bucket and year; a year is a part of the data, so none is one task.

        A table given as a function of this layout is made when its turn comes, of rows already dealt over the buckets.
        """
        for name in self.TABLES:
            given = tables[name]
            rows = given(self) if callable(given) else given
            laid_out = rows.withColumn("year_key", F.col("der_financial_year"))
            if not callable(given):
                laid_out = laid_out.repartition(self.buckets, *BUCKET_KEY)
            one = laid_out.write.mode("overwrite").partitionBy("der_financial_year")
            one = one.bucketBy(self.buckets, *BUCKET_KEY).sortBy(*BUCKET_KEY).option("path", f"{self.root}/{name}")
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")  # of an external table: its files stay
            one.saveAsTable(self._name(name))
        self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/complete")
        return self

    def table(self, name: str) -> DataFrame:
        """The table with its buckets known to the planner, named anew in a session that didn't write it."""
        full = self._name(name)
        if not self.spark.catalog.tableExists(full):
            buckets = self.spark.read.parquet(f"{self.root}/complete").first().buckets
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.root}/{name}").schema)
            key = ", ".join(BUCKET_KEY)
            self.spark.sql(
                f"CREATE TABLE {full} ({columns}) USING parquet PARTITIONED BY (der_financial_year) "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.root}/{name}'"
            )
            self.spark.sql(f"ALTER TABLE {full} RECOVER PARTITIONS")
        return self.spark.table(full)
