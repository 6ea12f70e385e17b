import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from activity_engine.functions.semantics import (
    left_join,
    ratio,
    round_half_even,
    semi_join,
    strict_sum,
    strict_sum_over,
    sum_na_rm,
    union_distinct,
)


def test_strict_sum_is_null_when_any_input_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    got = {r.k: r.s for r in df.groupBy("k").agg(strict_sum("x").alias("s")).collect()}
    assert got == {"a": None, "b": 5.0}


def test_strict_sum_over_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    w = Window.partitionBy("k")
    got = sorted((r.k, r.s) for r in df.select("k", strict_sum_over("x", w).alias("s")).collect())
    assert got == [("a", None), ("a", None), ("b", 5.0), ("b", 5.0)]


def test_sum_na_rm_skips_null_and_nan_and_gives_zero_when_empty(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", float("nan")), ("a", None), ("b", None)], "k string, x double"
    )
    got = {r.k: r.s for r in df.groupBy("k").agg(sum_na_rm("x").alias("s")).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_ratio_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0), (1.0, None)], "n double, d double")
    got = [r.q for r in df.select(ratio("n", "d").alias("q")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3] is None and got[4] == 1.5 and got[5] is None


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (0.25,), (10.25,)], "x double")
    r0 = [r.y for r in df.select(round_half_even("x", 0).alias("y")).collect()]
    r1 = [r.y for r in df.select(round_half_even("x", 1).alias("y")).collect()]
    assert r0 == [0.0, 2.0, 2.0, -2.0, 0.0, 10.0]
    assert r1[4] == 0.2 and r1[5] == 10.2


def test_left_join_matches_null_keys_and_keeps_left_key(spark):
    x = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    y = spark.createDataFrame([("a", "A"), (None, "N")], "k string, w string")
    got = sorted(left_join(x, y, ["k"]).collect(), key=lambda r: r.v)
    assert [(r.k, r.v, r.w) for r in got] == [("a", 1, "A"), (None, 2, "N")]
    strict = sorted(left_join(x, y, ["k"], null_safe=False).collect(), key=lambda r: r.v)
    assert strict[1].w is None


def test_left_join_with_renamed_key(spark):
    x = spark.createDataFrame([("2020-01-01", 1)], "month string, v int")
    y = spark.createDataFrame([("2020-01-01", "Jan")], "date string, label string")
    got = left_join(x, y, {"month": "date"}).collect()
    assert got[0].asDict() == {"month": "2020-01-01", "v": 1, "label": "Jan"}


def test_semi_join_on_pairs_is_null_safe(spark):
    x = spark.createDataFrame([(None, "100"), ("P", "100"), ("P", "110")], "provider string, tfc string")
    y = spark.createDataFrame([(None, "100"), ("P", "110")], "provider string, tfc string")
    got = sorted((r.provider or "", r.tfc) for r in semi_join(x, y, ["provider", "tfc"]).collect())
    assert got == [("", "100"), ("P", "110")]


def test_union_distinct_dedupes_by_name(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "b string, a int")
    assert sorted(tuple(r) for r in union_distinct(a, b).collect()) == [(1, "x"), (2, "y")]
