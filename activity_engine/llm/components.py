"""Connected components by alternating large and small stars, on Spark.

Every round replaces each vertex's links by links to the smallest vertex beside
it, until each vertex is linked to its component's smallest alone. Rounds end
with a checkpoint in the shared folder, so a lost executor never sends the job
back to the first round. A round has one exchange for each star. Links are never
gathered on the driver; those beside one vertex pass a window, which spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from activity_engine.session import checkpoint_dir


def _least_beside(links: DataFrame) -> DataFrame:
    """Distinct links (u, v) with m, the least v beside u: one exchange, as the rest needs no other partitioning."""
    return links.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))


def _large_star(pair: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours linked with its least one (itself included)."""
    both = _least_beside(pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(pair: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours linked with the least of them."""
    least = _least_beside(pair)
    return least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): each linked vertex and the smallest vertex that it reaches."""
    checkpoint_dir(links.sparkSession)
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v"))
    pair, before = pair.distinct().checkpoint(), None
    while True:
        pair = _small_star(_large_star(pair)).checkpoint()
        # repeated links count once: the next round drops them
        now = pair.distinct().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    pair = pair.distinct()
    roots = pair.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pair.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
