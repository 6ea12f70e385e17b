"""Logical tables derived from the driver's TPC-H style parquet files.

The reference's inputs (an outpatient attendance fact, reference tables and
lookups) are not public, so this module derives them from the driver's tables
with fixed rules, documented in FIXTURES.md section 2.  Everything is lazy:
the derivation becomes part of each query's plan, so Catalyst prunes columns
and pushes each query's predicates below the fact joins.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import activity_month, fin_year, first_of_month, fy_start_year
from ..params import Params
from ..session import checkpoint_dir
from .layout import BUCKET_KEY, DateSpans, PreparedFact, files_of, state_of
from .tables import Scope, Tables

# Fixed values of the mapping (FIXTURES.md section 2).
PART_TYPE_TO_TFC = (
    ("PROMO", "812"),
    ("STANDARD", "100"),
    ("ECONOMY", "110"),
    ("MEDIUM", "120"),
    ("LARGE", "130"),
    ("SMALL", "140"),
)
TFC_MISSING_FROM_REF = "140"
RETURNFLAG_TO_FIRST_ATTENDANCE = (("N", "1"), ("A", "2"), ("R", "4"))
ORDERSTATUS_TO_ATTENDANCE_STATUS = (("F", "5"), ("O", "6"), ("P", "3"))
LOW_PRIORITY = "5-LOW"
URGENT_PRIORITY = "1-URGENT"
ACUTE_NATION_LIMIT = 20  # nation keys below are acute providers
MISPLACED_NATION, MISPLACED_STP = 5, "Q1"  # provider lookup row with a wrong STP
UNLISTED_NATION = 10  # left out of the provider lookup
NON_SE_REGION = 4
FIRST_REGION_CODE_KEYS = (0, 1, 2)  # region code 'Y0', others 'Y1'
BUCKETS = 8  # of the prepared fact at least, unless stated
#: Bytes of stored lines for each of its buckets: a task sorts one bucket's rows, some 200 MB of them, in memory.
BUCKET_BYTES = 16 << 20


def _map(col: Column, pairs) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def _nn(nationkey: Column) -> Column:
    return F.lpad(nationkey.cast("string"), 2, "0")


def _region_code(regionkey: Column) -> Column:
    return F.when(regionkey.isin(*FIRST_REGION_CODE_KEYS), F.lit("Y0")).otherwise(F.lit("Y1"))


# Declared schemas of the driver's tables (columns used here): no inference job.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


class _Raw:
    """Each driver table read once per load."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = _read(self.spark, self.sf_dir, name)
        return self._cache[name]


def _keys_of(pairs, wanted) -> list[str]:
    return [k for k, v in pairs if v in wanted]


def _sides(raw: _Raw, scope: Scope = Scope()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """lineitem, orders, part and supplier, projected to their keys and mapped columns.

    ``scope`` becomes predicates on the stored columns, which the Parquet scan
    can use; the mapped columns are expressions and can't be pushed that far.
    """
    lines, orders = raw("lineitem"), raw("orders")
    if scope.dates:
        day = F.col("l_shipdate")
        bounds = [(F.lit(str(a)).cast("timestamp_ntz"), F.lit(str(b)).cast("timestamp_ntz")) for a, b in scope.dates]
        lines = lines.where(reduce(or_, [(day >= a) & (day < b) for a, b in bounds]))
    if scope.first_attendance:
        lines = lines.where(F.col("l_returnflag").isin(_keys_of(RETURNFLAG_TO_FIRST_ATTENDANCE, scope.first_attendance)))
    if scope.attendance_status:
        orders = orders.where(F.col("o_orderstatus").isin(_keys_of(ORDERSTATUS_TO_ATTENDANCE_STATUS, scope.attendance_status)))
    if scope.administrative_category == "01":
        orders = orders.where(F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") != LOW_PRIORITY))
    li = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("opa_ident"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_shipdate").cast("date").alias("appointment_date"),
        _map(F.col("l_returnflag"), RETURNFLAG_TO_FIRST_ATTENDANCE).alias("first_attendance"),
        F.when(F.col("l_discount") != 0, (F.round(F.col("l_discount") * 100).cast("int") % 3)).alias("der_number_procedure"),
        "l_tax", "l_linestatus",
    )
    o = orders.select(
        F.col("o_orderkey"),
        _map(F.col("o_orderstatus"), ORDERSTATUS_TO_ATTENDANCE_STATUS).alias("attendance_status"),
        F.when(F.col("o_orderpriority") == LOW_PRIORITY, F.lit("02")).otherwise(F.lit("01")).alias("administrative_category"),
        F.col("o_orderpriority"),
    )
    p = raw("part").select(
        F.col("p_partkey"),
        _map(F.col("p_type"), PART_TYPE_TO_TFC).alias("treatment_function_code"),
        F.when(F.col("p_size") <= 40, F.lit("WF01A")).otherwise(F.lit("AA01A")).alias("core_hrg"),
    )
    sfx = F.when(F.col("s_suppkey") % 4 == 1, F.lit("00")).when(F.col("s_suppkey") % 4 == 3, F.lit("01")).otherwise(F.lit(""))
    s = raw("supplier").select(
        F.col("s_suppkey"),
        F.col("s_nationkey"),
        F.concat(F.lit("R"), _nn(F.col("s_nationkey")), sfx).alias("der_provider_code"),
    )
    return li, o, p, s


def _join(li: DataFrame, o: DataFrame, p: DataFrame | None, s: DataFrame) -> DataFrame:
    """The sides joined. All foreign keys resolve, so inner joins keep every line.

    Sizes are left to the optimizer (AQE turns a join into a broadcast only when
    the measured side is under the threshold).
    """
    base = li.join(o, li.l_orderkey == o.o_orderkey)
    if p is not None:
        base = base.join(p, li.l_partkey == p.p_partkey)
    return base.join(s, li.l_suppkey == s.s_suppkey)


def _with_periods(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "der_financial_year": fin_year("appointment_date", "/"),
            "der_activity_month": activity_month("appointment_date"),
        }
    )


def _fact_base(raw: _Raw, with_part: bool = True, scope: Scope = Scope()) -> DataFrame:
    """lineitem joined to orders, part and supplier, with the mapped columns."""
    li, o, p, s = _sides(raw, scope)
    return _with_periods(_join(li, o, p if with_part else None, s))


#: The mapped columns of few values: all that each can have.
VALUES = {
    "first_attendance": [v for _, v in RETURNFLAG_TO_FIRST_ATTENDANCE],
    "attendance_status": [v for _, v in ORDERSTATUS_TO_ATTENDANCE_STATUS],
    "administrative_category": ["01", "02"],
    "treatment_function_code": [v for _, v in PART_TYPE_TO_TFC],
    "core_hrg": ["WF01A", "AA01A"],
}


def _coded(side: DataFrame) -> DataFrame:
    """The columns of ``VALUES`` as their value's place in its list, a byte."""
    return side.withColumns(
        {c: _map(F.col(c), [(v, k) for k, v in enumerate(VALUES[c])]).cast("byte") for c in side.columns if c in VALUES}
    )


def _decoded(lines: DataFrame) -> DataFrame:
    return lines.withColumns({c: _map(F.col(c), list(enumerate(v))) for c, v in VALUES.items()})


def _dealt_attendance(raw: _Raw, buckets: int) -> DataFrame:
    """The attendance rows, with whether each has a cost (``costed``), dealt over the buckets of the cost key.

    Every line goes through the joins' exchanges and this one, so it travels narrow:
    keys, date and codes of a byte. What can be told from these is made after the last.
    """
    li, o, p, s = map(_coded, _sides(raw))
    li = li.withColumn("costed", F.col("l_tax") > 0).drop("opa_ident", "l_tax", "l_linestatus")
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kept = [c for c in ATTENDANCE_COLUMNS if c not in ("opa_ident", "der_financial_year", "der_activity_month")]
    lines = _join(li, o.drop("o_orderpriority"), p, s).select(ident.alias("opa_ident"), *kept, "costed")
    dealt = lines.repartition(buckets, F.col("opa_ident"), fin_year("appointment_date", "/"))
    return _with_periods(_decoded(dealt)).select(*ATTENDANCE_COLUMNS, "costed")


def _cost_of(attendance: DataFrame) -> DataFrame:
    """The cost table from a laid-out attendance table; as that is bucketed by the key, without an exchange."""
    costed = attendance.where("costed").groupBy(*BUCKET_KEY, "der_financial_year")
    return costed.agg(F.min("core_hrg").alias("hrg_code_other"))


ATTENDANCE_COLUMNS = (
    "opa_ident", "appointment_date", "der_financial_year", "der_activity_month",
    "der_provider_code", "treatment_function_code", "first_attendance",
    "attendance_status", "administrative_category", "core_hrg", "der_number_procedure",
)


def rule_holidays(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """Synthetic bank holidays: 1 January, 25 and 26 December of every year of the range."""
    y = spark.range(0, 1, 1, 1).select(F.explode(F.sequence(F.year(start), F.year(end))).alias("y"))
    return y.select(
        F.explode(
            F.array(
                F.make_date("y", F.lit(1), F.lit(1)),
                F.make_date("y", F.lit(12), F.lit(25)),
                F.make_date("y", F.lit(12), F.lit(26)),
            )
        ).alias("date")
    )


class MappedTables(Tables):
    """The logical tables over a folder; each is built when first used, so a query pays only for its own."""

    holidays = staticmethod(rule_holidays)

    def __init__(self, spark: SparkSession, sf_dir: str, prepared: PreparedFact | None = None, stored_span: bool = False):
        # the prepared layout is pruned by its year partitions, the derived one by predicates on stored columns
        self.__dict__.update(_raw=_Raw(spark, sf_dir), _spark=spark, _prepared=prepared, _stored_span=stored_span)
        self.__dict__.update(source=self._narrowed if prepared is None else None)
        if prepared is not None:
            self.__dict__.update(cost_key=BUCKET_KEY)

    @cached_property
    def attendance(self) -> DataFrame:
        if self._prepared:
            return self._prepared.table("attendance").select(*ATTENDANCE_COLUMNS, "year_key")
        return self._narrowed("attendance", Scope())

    @cached_property
    def attendance_cost(self) -> DataFrame:
        if self._prepared:
            return self._prepared.table("attendance_cost").select("opa_ident", "der_financial_year", "year_key", "hrg_code_other")
        return self._narrowed("attendance_cost", Scope())

    @cached_property
    def calendar_range(self) -> tuple[dt.date | None, dt.date | None] | None:
        """The financial years that cover the fact's dates, from the spans kept for its files."""
        if not self._stored_span:
            return None
        low, high = DateSpans(self._spark).of(f"{self._raw.sf_dir}/lineitem.parquet", "l_shipdate", SCHEMAS["lineitem"])
        if low is None:
            return None, None
        return dt.date(low.year - (low.month < 4), 4, 1), dt.date(high.year + (high.month >= 4), 3, 31)

    @cached_property
    def planning(self) -> DataFrame:
        return self._narrowed("planning", Scope())

    @cached_property
    def hrg_time_series(self) -> DataFrame:
        return self._narrowed("hrg_time_series", Scope())

    def _narrowed(self, name: str, scope: Scope) -> DataFrame:
        if name == "planning":
            return self._planning(scope)
        lines = _fact_base(self._raw, scope=scope)
        if name == "attendance":
            return lines.select(*ATTENDANCE_COLUMNS)
        return self._cost(lines) if name == "attendance_cost" else self._hrg(lines)

    def _cost(self, lines: DataFrame) -> DataFrame:
        return (
            lines.where(F.col("l_tax") > 0)
            .groupBy("opa_ident", "der_financial_year")
            .agg(F.min("core_hrg").alias("hrg_code_other"))
        )

    def _planning(self, scope: Scope) -> DataFrame:
        nation_region = self._raw("nation").select(
            F.col("n_nationkey").alias("p_nationkey"), _region_code(F.col("n_regionkey")).alias("regioncode")
        )
        planning_counts = (
            _fact_base(self._raw, with_part=False, scope=scope).groupBy(
                first_of_month("appointment_date").alias("dimdatestart"),
                F.col("s_nationkey"),
                F.col("o_orderpriority"),
                F.col("l_linestatus"),
            )
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return planning_counts.join(
            F.broadcast(nation_region), planning_counts.s_nationkey == nation_region.p_nationkey
        ).select(
            F.concat(F.lit("R"), _nn(F.col("s_nationkey"))).alias("orgcode"),
            F.when(F.col("s_nationkey") < ACUTE_NATION_LIMIT, F.lit("Provider")).otherwise(F.lit("ICB")).alias("orgtype"),
            F.col("dimdatestart"),
            F.col("n").cast("double").alias("value"),
            F.when(F.col("o_orderpriority") == URGENT_PRIORITY, F.lit("E.M.38")).otherwise(F.lit("E.M.10")).alias("planningref"),
            F.col("regioncode"),
            F.when(F.col("l_linestatus") == "F", F.lit(None).cast("string")).otherwise(F.lit("Plan")).alias("sourcetype"),
            (fy_start_year("dimdatestart") + 1).cast("string").alias("dimfyear"),
        )

    def _hrg(self, lines: DataFrame) -> DataFrame:
        nation_stp = self._raw("nation").select(
            F.col("n_nationkey").alias("h_nationkey"),
            F.concat(F.lit("Q"), F.col("n_regionkey").cast("string")).alias("stp_ics"),
        )
        hrg_counts = lines.groupBy(
            F.col("der_activity_month"),
            F.col("s_nationkey"),
            F.when(F.col("l_linestatus") == "F", F.lit("Y")).otherwise(F.lit("N")).alias("centralised_nhse_commissioned"),
            F.col("treatment_function_code").alias("tfc"),
            F.when(F.col("first_attendance").isin("2", "4"), F.lit("FUp")).otherwise(F.lit("First")).alias("der_appointment_type"),
            F.col("core_hrg").alias("hrg"),
        ).agg(F.count(F.lit(1)).alias("activity"))
        return hrg_counts.join(
            F.broadcast(nation_stp), hrg_counts.s_nationkey == nation_stp.h_nationkey
        ).select(
            "der_activity_month",
            F.concat(F.lit("R"), _nn(F.col("s_nationkey"))).alias("provider_or_is_ccg_code_a"),
            "stp_ics",
            "centralised_nhse_commissioned",
            "tfc",
            "activity",
            F.lit("OPA").alias("activity_type"),
            "der_appointment_type",
            "hrg",
        )

    @cached_property
    def tfc_ref(self) -> DataFrame:
        return (
            self._raw("part").select(F.col("p_type"))
            .distinct()
            .select(_map(F.col("p_type"), PART_TYPE_TO_TFC).alias("treatment_function_code"), F.col("p_type"))
            .where(F.col("treatment_function_code").isNotNull() & (F.col("treatment_function_code") != TFC_MISSING_FROM_REF))
            .select(
                "treatment_function_code",
                F.concat(F.col("treatment_function_code"), F.lit(":"), F.col("p_type")).alias("treatment_function_desc"),
            )
        )

    @cached_property
    def provider_hierarchy(self) -> DataFrame:
        nation, region = self._raw("nation"), self._raw("region")
        nr = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 x 5 rows
        return nr.select(
            F.concat(F.lit("R"), _nn(F.col("n_nationkey"))).alias("organisation_code"),
            F.col("n_name").alias("organisation_name"),
            F.concat(F.lit("Q"), F.col("r_regionkey").cast("string")).alias("stp_code"),
            F.col("r_name").alias("stp_name"),
            _region_code(F.col("r_regionkey")).alias("region_code"),
        )

    @cached_property
    def provider_lookup(self) -> DataFrame:
        return self._raw("nation").where(F.col("n_nationkey") != UNLISTED_NATION).select(
            F.concat(F.lit("R"), _nn(F.col("n_nationkey"))).alias("provider_code"),
            F.col("n_name").alias("provider_short_name"),
            F.concat(F.lit("TRUST "), F.col("n_name")).alias("acute_full_name"),
            F.when(F.col("n_nationkey") == MISPLACED_NATION, F.lit(MISPLACED_STP))
            .otherwise(F.concat(F.lit("Q"), F.col("n_regionkey").cast("string")))
            .alias("stp_code"),
        )

    @cached_property
    def system_lookup(self) -> DataFrame:
        return self._raw("region").select(
            F.concat(F.lit("Q"), F.col("r_regionkey").cast("string")).alias("stp_code"),
            F.concat(F.lit("NHS "), F.col("r_name"), F.lit(" BOARD")).alias("stp_name"),
            F.when(F.col("r_regionkey") == NON_SE_REGION, F.lit("Non_SE")).otherwise(F.col("r_name")).alias("short_name"),
        )

    @cached_property
    def acutes(self) -> DataFrame:
        return self._raw("nation").where(F.col("n_nationkey") < ACUTE_NATION_LIMIT).select(
            F.concat(F.lit("R"), _nn(F.col("n_nationkey"))).alias("provider_code")
        )

    @cached_property
    def calendar_bounds(self) -> DataFrame:
        # Calendar span: the financial years covering the fact's dates.  Only the
        # date column of lineitem is read (partial min/max, no shuffle of rows).
        span = self._raw("lineitem").agg(
            F.min(F.col("l_shipdate").cast("date")).alias("lo"), F.max(F.col("l_shipdate").cast("date")).alias("hi")
        )
        return span.select(
            F.make_date(fy_start_year("lo"), F.lit(4), F.lit(1)).alias("start_date"),
            F.make_date(fy_start_year("hi") + 1, F.lit(3), F.lit(31)).alias("end_date"),
        )


def load_tables(
    spark: SparkSession, sf_dir: str, params: Params | None = None, *, prepared: str | None = None, stored_span: bool = False
) -> Tables:
    """The logical tables over ``sf_dir``.

    ``prepared`` is a folder written by ``prepare_fact``: attendance and cost
    are then read from it (partitioned by financial year, so the extracts'
    year filters prune partitions) instead of being derived per query.
    ``stored_span`` takes the calendar's range from the kept spans of the files.
    """
    laid_out = PreparedFact(spark, prepared, BUCKETS) if prepared else None
    return MappedTables(spark, sf_dir, laid_out, stored_span)


def prepare_fact(spark: SparkSession, sf_dir: str, out: str, params: Params | None = None, buckets: int | None = None) -> str:
    """Write the derived attendance and cost tables once, partitioned by financial year and bucketed by the cost key.

    This is the layout the real attendance fact has at scale: every extract
    filters on the financial year, which then prunes partitions instead of
    running a post-scan filter behind the four-table derivation, and the cost
    join reads matching buckets.  Each bucket is one task's, here and in that join, so
    their number grows with the stored lines unless ``buckets`` states it.  The joins of the
    derivation run once: the cost table is made of the attendance rows just written.
    ``out`` must be on the shared file system.
    """
    raw = _Raw(spark, sf_dir)
    fact = PreparedFact(spark, out, buckets or _buckets_for(spark, sf_dir))
    fact.write(attendance=lambda own: _dealt_attendance(raw, own.buckets), attendance_cost=lambda own: _cost_of(own.table("attendance")))
    return out


def _buckets_for(spark: SparkSession, sf_dir: str) -> int:
    stored = files_of(spark, f"{sf_dir}/lineitem.parquet").agg(F.sum("length").alias("n")).first().n or 0
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(BUCKETS, -(-stored // BUCKET_BYTES)), most)


def prepared_for(spark: SparkSession, sf_dir: str, params: Params | None = None) -> str:
    """The folder of the prepared fact for the present state of the files; written when there is none yet."""
    tables = ("lineitem", "orders", "part", "supplier")
    state = state_of(spark, *[f"{sf_dir}/{name}.parquet" for name in tables])
    out = f"{checkpoint_dir(spark)}/prepared-fact-{state}"
    if not PreparedFact(spark, out, BUCKETS).complete:
        prepare_fact(spark, sf_dir, out, params)
    return out
