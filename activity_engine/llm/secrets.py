"""Secret scans over an incremental blob ledger (operator 1), native.

Every historical version of a text is addressed by the SHA-256 of its content.
The ledger keeps a row for each blob and rule version that was ever scanned,
with the spans found. A scan takes the distinct blobs, skips the pairs of blob
and rule version that the ledger has, scans the others, appends them, and joins
the ledger's findings back to all paths.

A rule's version is a hash of its definition, so a changed rule is scanned
again and an unchanged one is not.

Defined cases: a null text is the empty text; empty texts have no findings;
each input row gives one row (repeated rows and null ids too); columns that
clash with the new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.session import checkpoint_dir

SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # the group that must be long enough
    least: int  # its least length

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# The base kinds, in the order that breaks ties.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, whatever number of times it is used."""
    return F.transform(F.array(value), use)[0]


def sums_before(lengths: Column, block: int = 64) -> Column:
    """For each element, the sum of those before it; by blocks, so that long arrays don't take quadratic time."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def running(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(
            blocks,
            start,
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")
            ),
            lambda acc: acc["all"],
        )

    def placed(n: Column) -> Column:
        def of_blocks(before: Column) -> Column:
            return F.transform(
                lengths,
                lambda x, i: F.get(before, (i / block).cast("int"))
                + total(F.slice(lengths, i - i % block + 1, i % block)),
            )

        sums = F.transform(F.sequence(F.lit(0), ((n - 1) / block).cast("int")), lambda k: total(F.slice(lengths, k * block + 1, block)))
        return let(running(sums), of_blocks)

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(placed(F.size(lengths)))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of the rule that are long enough: code points, end exclusive."""
    pattern = F.lit(rule.pattern)

    def found(m: Column) -> Column:
        whole = F.transform(m["whole"], lambda x: F.char_length(x))
        both = F.zip_with(F.slice(F.transform(m["between"], lambda x: F.char_length(x)), 1, F.size(whole)), whole, lambda a, b: a + b)

        def placed(v: Column) -> Column:
            spans = F.zip_with(
                F.zip_with(v["before"], v["both"], lambda a, b: a + b),
                F.arrays_zip(m["whole"].alias("whole"), m["value"].alias("value")),
                lambda stop, w: F.when(
                    F.char_length(w["value"]) >= rule.least,
                    F.struct(
                        (stop - F.char_length(w["whole"])).alias("start"),
                        F.lit(rank).alias("rank"),
                        stop.alias("stop"),
                        F.lit(rule.kind).alias("kind"),
                    ),
                ),
            )
            return F.filter(spans, lambda s: s.isNotNull())

        return let(both, lambda b: let(F.struct(b.alias("both"), sums_before(b).alias("before")), placed))

    matches = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
        F.split(text, rule.pattern, -1).alias("between"),
    )
    # most texts have no match that is long enough
    return F.when(text.rlike(f"{_longer(rule)}"), let(matches, found)).otherwise(F.array().cast(SPANS))


def _longer(rule: Rule) -> str:
    """A cheaper pattern that matches wherever a long enough match of the rule may be."""
    if rule.kind == "access" and rule.pattern == r"AKIA[A-Z0-9]+":
        return r"AKIA[A-Z0-9]{%d}" % (rule.least - 4)
    if rule.pattern == r"[0-9a-f]+":
        return r"[0-9a-f]{%d}" % rule.least
    return rule.pattern


def read_ledger(versions: DataFrame, path: str) -> DataFrame | None:
    try:
        return versions.sparkSession.read.schema(f"blob string, rule_version string, spans {SPANS}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = BASE) -> None:
    """Scans the pairs of blob and rule version that the ledger lacks, and appends them."""
    value = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(value, 256).alias("blob"), value.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = read_ledger(versions, path)
    if known is not None:
        seen = known.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))  # at most the rules' versions
        blobs = blobs.join(seen, "blob", "left")
        blobs = blobs.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    unseen = F.array(
        *[
            F.when(
                ~F.array_contains("seen", F.lit(r.version)),
                F.struct(F.lit(r.version).alias("rule_version"), spans_of(F.col("text"), r, k).alias("spans")),
            )
            for k, r in enumerate(rules)
        ]
    )
    rows = blobs.filter(F.size(F.array_except(F.array(*[F.lit(r.version) for r in rules]), F.col("seen"))) > 0)
    rows = rows.select("blob", F.explode(unseen).alias("r")).filter(F.col("r").isNotNull())
    rows.select("blob", "r.rule_version", "r.spans").write.mode("append").parquet(path)


def scan(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = BASE) -> DataFrame:
    """``versions`` with blob and spans, the findings of these rules in start order, by way of the ledger at ``path``."""
    update_ledger(versions, path, text, rules)
    findings = (
        read_ledger(versions, path)
        .filter(F.col("rule_version").isin([r.version for r in rules]) & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule_version"])
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # at most a text's matches
    )
    own = [f"`{c}`" for c in versions.columns if c.lower() not in ("blob", "spans")]
    paths = versions.select(*own, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    return paths.join(findings, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def new_ledger(versions: DataFrame) -> str:
    """A place for a ledger of its own in the folder that all executors share."""
    return f"{checkpoint_dir(versions.sparkSession)}/ledger-{uuid.uuid4().hex}"


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans (in start order) replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        later = s["start"] >= acc["pos"]
        beyond = s["stop"] > acc["pos"]
        gap = s["start"] - acc["pos"]
        return F.when(
            beyond,
            F.struct(
                F.when(later, F.concat(acc["parts"], F.array(F.substring(acc["rest"], F.lit(1), gap), F.lit(mark))))
                .otherwise(acc["parts"])
                .alias("parts"),
                s["stop"].alias("pos"),
                F.substring(acc["rest"], s["stop"] - acc["pos"] + 1, F.lit(2147483647)).alias("rest"),
            ),
        ).otherwise(acc)

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("pos"), text.alias("rest"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), acc["rest"]))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
