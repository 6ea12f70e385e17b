"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, bpe, chat, contextmix, decontam, langid, neardup, quality, runs, secrets, substring, tokencount, urls
from .sql import ORACLE


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.new_ledger(docs))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    counts = [secrets.count_kind(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.deduplicate(documents(spark, sf_dir)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.Settings(size=3, percent=85))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir, "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).drop("text")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(documents(spark, sf_dir)).drop("text", "cleaned_text")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    outcomes = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select("doc_id", bad)
    labelled = documents(spark, sf_dir).join(outcomes.select("doc_id").distinct(), "doc_id", "left_semi")
    pages = urls.with_documents(table(spark, sf_dir, "pages", "page_id", "url", "html"), labelled)
    return urls.judge(pages, outcomes, by="doc_id").drop("share")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.preference_turns(chat.paired_by_answer(turns))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score(documents(spark, sf_dir))


def op12_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitplanes.with_inertia(*bitplanes.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(documents(spark, sf_dir), weave=runs.woven))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_secret_scan,
    op2_substring_dedup,
    op3_near_dedup,
    op4_bpe_round_trip,
    op5_language_id,
    op6_token_counts,
    op7_line_quality,
    op8_url_reputation,
    op9_decontamination,
    op10_preference_format,
    op11_context_mixing,
    op12_bitplane_clusters,
    op13_periodic_runs,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
