"""A corpus pipeline of five stages over ``documents``, each written and read again by the next.

language ID -> near-duplicates -> benchmark decontamination -> secret scans -> BPE encoding

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. The language stage drops texts without a letter; the near-duplicate stage keeps one row of each
group of texts that share 80 % of their five-word shingles; the decontamination
stage drops texts with at least one word in 20 inside a benchmark window; the
secret stage masks findings in the text; the last stage adds the token ids and
the decoded text's hash.

Defined cases: rows with a null text go in the first stage; rows with a null
doc_id are learned from by no stage, grouped with nothing, and kept if clean;
equal rows (same id and text) count as copies, of which one stays; a second
text of one id is judged on its own; extra columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.llm import bpe, decontam, langid, neardup, secrets
from activity_engine.llm.queries import tokenizer_path
from activity_engine.session import checkpoint_dir


#: Rows in a batch that goes to Python and back. A stage passes whole rows with their texts, so Spark's 10,000 would
#: keep some 100 MB a task outside the heap, on both sides.
BATCH_ROWS = 1000


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    found = langid.identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c not in ("doc_id", "text", "lang")}))
    kept = found.filter(F.col("lang_pred") != "und")
    return kept.select(*[F.col(c if c in ("doc_id", "text", "lang") else f"in_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    found = neardup.grouped(docs.select("doc_id", "text"), neardup.Settings(size=5, percent=80))
    kept = found.filter("first and doc_id is not null").select("doc_id", F.col("text_hash").alias("_hash")).distinct()
    named = docs.withColumn("_hash", F.xxhash64("text")).join(kept, ["doc_id", "_hash"], "left_semi")
    # rows of one kept id with one text are copies of each other; each task drops its own first
    single = named.dropDuplicates(["doc_id", "_hash", "text"]).drop("_hash")
    return single.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    own = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c != "text"})
    kept = decontam.contaminated(own, benchmark).filter(~F.col("contaminated"))
    return kept.select(*[F.col(c if c == "text" else f"in_{c}").alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c != "text"})
    found = secrets.scan(own, secrets.new_ledger(docs))
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    out = masked.select(*[F.col(c if c == "text" else f"in_{c}").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    path = tokenizer_path("word_bpe_49k.json")
    ids = bpe.encode(docs.select("doc_id", "text"), path)
    decoded = bpe.decode(ids, path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("BPE encoding", encode),
]

#: SQL can't express the language, near-duplicate and BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
