"""File sources of the reference (S1-S6): CSV extracts, lookups, holiday JSON.

Every reader declares its schema (no inference pass over the files), finds
its columns by header name and returns a lazy DataFrame with lower-case column names.  CSV rules follow
``readr::read_csv``: the date column parses as ``dd/MM/yyyy`` (a bad date or
number becomes NULL and is listed by ``csv_problems``), empty fields and ``NA`` are NULL, a quoted empty string is
NULL too, and surrounding spaces are trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVITY_SCHEMA = T.StructType(
    [
        T.StructField("Month_commencing", T.StringType()),
        T.StructField("Treatment_Function_Code", T.StringType()),
        T.StructField("Treatment_Function", T.StringType()),
        T.StructField("Der_Provider_Code", T.StringType()),
        T.StructField("STP_Code", T.StringType()),
        T.StructField("Activity", T.DoubleType()),
    ]
)
BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("OrgCode", T.StringType()),
        T.StructField("OrgType", T.StringType()),
        T.StructField("month_commencing", T.StringType()),
        T.StructField("Value", T.DoubleType()),
    ]
)
PROVIDER_LOOKUP_SCHEMA = "provider_code STRING, provider_short_name STRING, acute_full_name STRING, stp_code STRING"
SYSTEM_LOOKUP_SCHEMA = "stp_code STRING, stp_name STRING, short_name STRING"

_CSV_OPTIONS = {
    "header": "true",
    "mode": "PERMISSIVE",
    "nullValue": "NA",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _blank_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        cols.append(F.when(c == "", None).otherwise(c).alias(f.name) if isinstance(f.dataType, T.StringType) else c)
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The schema's columns, found by header name in any case and order; other columns are left out."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.options(**_CSV_OPTIONS).csv(path)
    found = {c.strip().lower(): c for c in raw.columns}
    missing = [f.name for f in schema if f.name.lower() not in found]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(raw.columns)}")
    df = raw.select(*[F.col(f"`{found[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) for f in schema])
    return _blank_to_null(df)


#: Columns whose text is a date; the others' types are in their schemas.
DATE_COLUMNS = ("month_commencing",)
_FILE, _BLOCK, _ID = "__file", "__block", "__id"


def csv_problems(spark: SparkSession, path: str, schema, dates: tuple[str, ...] = DATE_COLUMNS) -> DataFrame:
    """What the reader of the same file had to make NULL: (file, row, col, expected, actual), as ``readr::problems`` lists it.

    A cell is listed when it has text that its column's type can't take, and a
    record (with a null ``col``) when it has fewer or more fields than the header.
    ``row`` counts the file's records, the header being the first. A file may be
    split over many tasks: a record's number is its place in its split plus the
    records of the file's earlier splits, of which there is one small row each.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.options(**_CSV_OPTIONS)
    headers = reader.csv(path).columns
    broken = "__broken_record"
    fields = T.StructType([T.StructField(h, T.StringType()) for h in [*headers, broken]])
    whole = spark.read.options(**_CSV_OPTIONS, columnNameOfCorruptRecord=broken).schema(fields).csv(path)
    numbered = whole.select(
        *[F.col(f"`{h}`") for h in whole.columns],
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ID),
    )
    found = {h.strip().lower(): h for h in headers}
    # the record's text; naming every column here also makes the parser count the fields, which it skips for fewer columns
    text = F.coalesce(F.col(broken), F.concat_ws(",", *[F.col(f"`{h}`") for h in headers]))
    cells = [F.when(F.col(broken).isNotNull(), _problem(None, f"{len(headers)} columns", text))]
    for f in schema:
        raw = F.col(f"`{found[f.name.lower()]}`") if f.name.lower() in found else F.lit(None).cast("string")
        if f.name.lower() in dates:
            good, expected = F.try_to_date(raw, "dd/MM/yyyy"), "date like %d/%m/%Y"
        elif isinstance(f.dataType, T.StringType):
            continue
        else:
            good, expected = raw.try_cast(f.dataType), f"a {f.dataType.simpleString()}"
        cells.append(F.when((raw != "") & good.isNull(), _problem(f.name.lower(), expected, raw)))
    bad = numbered.select(_FILE, _BLOCK, _ID, F.explode(F.array_compact(F.array(*cells))).alias("x"))
    splits = numbered.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(_ID).alias("first"))
    before = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(_FILE, _BLOCK, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return bad.join(splits, [_FILE, _BLOCK]).select(
        F.col(_FILE).alias("file"), (F.col("before") + F.col(_ID) - F.col("first") + 2).alias("row"), "x.col", "x.expected", "x.actual"
    )


def _problem(col: str | None, expected: str, actual: Column) -> Column:
    return F.struct(F.lit(col).cast("string").alias("col"), F.lit(expected).alias("expected"), actual.alias("actual"))


def _dmy(col: str):
    # readr col_date('%d/%m/%Y'): unparseable text gives NA, never an error
    return F.try_to_date(F.col(col), "dd/MM/yyyy")


def read_activity_csv(spark: SparkSession, path: str) -> DataFrame:
    """An activity extract (month, TFC, description, provider, STP, activity)."""
    df = _lower(read_csv(spark, path, ACTIVITY_SCHEMA))
    return df.withColumn("month_commencing", _dmy("month_commencing"))


def read_baseline_csv(spark: SparkSession, path: str) -> DataFrame:
    """The planning baseline (orgcode, orgtype, month_commencing, value)."""
    df = _lower(read_csv(spark, path, BASELINE_SCHEMA))
    return df.withColumn("month_commencing", _dmy("month_commencing"))


def read_provider_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Provider short names (code, short name, full name, STP)."""
    return _lower(read_csv(spark, path, PROVIDER_LOOKUP_SCHEMA))


def read_system_lookup(spark: SparkSession, path: str) -> DataFrame:
    """System names (STP code, name, short name)."""
    return _lower(read_csv(spark, path, SYSTEM_LOOKUP_SCHEMA))


def read_tfc_list(spark: SparkSession, path: str) -> DataFrame:
    """The treatment function list, every column by its lower-case header as text (the reference loads it and uses none)."""
    raw = spark.read.options(**_CSV_OPTIONS).csv(path)
    return _blank_to_null(raw.toDF(*[c.strip().lower() for c in raw.columns]))


HOLIDAY_JSON_SCHEMA = T.StructType(
    [
        T.StructField(
            "england-and-wales",
            T.StructType(
                [
                    T.StructField("division", T.StringType()),
                    T.StructField(
                        "events",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("title", T.StringType()),
                                    T.StructField("date", T.StringType()),
                                    T.StructField("notes", T.StringType()),
                                    T.StructField("bunting", T.BooleanType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        )
    ]
)


def read_holidays(spark: SparkSession, path: str, division: str = "england-and-wales") -> DataFrame:
    """The holiday list of one division (a multi-line JSON document) as a ``date`` column.

    The reference downloads it; here it is a file or folder on the shared
    file system.  The hyphenated division name is a back-quoted field.
    """
    schema = HOLIDAY_JSON_SCHEMA
    if division != "england-and-wales":
        schema = T.StructType([T.StructField(division, HOLIDAY_JSON_SCHEMA.fields[0].dataType)])
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    events = doc.select(F.explode(F.col(f"`{division}`.events")).alias("e"))
    return events.select(F.to_date(F.col("e.date")).alias("date"))
