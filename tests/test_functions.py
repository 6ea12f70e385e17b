import datetime as dt

from pyspark.sql import functions as F

from activity_engine.functions import dates as fd
from activity_engine.functions.formatting import percent_text, thousands
from activity_engine.functions.text import provider_code, title_case_nhs
from activity_engine.params import SELECT_RULES, JOIN_RULES


def one(spark, expr, value, ddl):
    return spark.createDataFrame([(value,)], f"x {ddl}").select(expr.alias("y")).first().y


def test_financial_year_and_month_edges(spark):
    rows = [(dt.date(2023, 3, 31),), (dt.date(2023, 4, 1),), (dt.date(1999, 12, 31),), (dt.date(2000, 1, 1),)]
    df = spark.createDataFrame(rows, "d date")
    got = df.select(fd.fin_year("d", "-").alias("a"), fd.fin_year("d", "/").alias("b"), fd.fin_month("d").alias("m")).collect()
    assert [(r.a, r.b, r.m) for r in got] == [
        ("2022-23", "2022/23", 12),
        ("2023-24", "2023/24", 1),
        ("1999-00", "1999/00", 9),
        ("1999-00", "1999/00", 10),
    ]


def test_weekday_labels_and_numbers(spark):
    df = spark.createDataFrame([(dt.date(2023, 4, 2),), (dt.date(2023, 4, 8),)], "d date")  # Sunday, Saturday
    got = df.select(fd.weekday_abbr("d").alias("w"), F.dayofweek("d").alias("n"), fd.month_abbr("d").alias("m")).collect()
    assert [(r.w, r.n, r.m) for r in got] == [("Sun", 1, "Apr"), ("Sat", 7, "Apr")]


def test_month_of_fin_month(spark):
    df = spark.createDataFrame([(1,), (9,), (10,), (12,), (None,)], "fm int")
    got = [r.d for r in df.select(fd.month_of_fin_month("fm", 2022).alias("d")).collect()]
    assert got == [dt.date(2022, 4, 1), dt.date(2022, 12, 1), dt.date(2023, 1, 1), dt.date(2023, 3, 1), None]


def test_first_of_month_and_text(spark):
    assert one(spark, fd.first_of_month("x"), dt.date(2022, 5, 17), "date") == dt.date(2022, 5, 1)
    assert one(spark, fd.yyyymm_to_iso("x"), "202003", "string") == "2020-03-01"
    assert one(spark, fd.date_text_first_of_month("x"), dt.date(2022, 5, 17), "date") == "01/05/2022"


def test_provider_rules_first_match_wins(spark):
    df = spark.createDataFrame([("RXH00",), ("RXH12",), ("RD701",), ("RD7",), ("RAB",), ("R1F",)], "c string")
    sel = [r.y for r in df.select(provider_code("c", SELECT_RULES).alias("y")).collect()]
    key = [r.y for r in df.select(provider_code("c", JOIN_RULES).alias("y")).collect()]
    three = [r.y for r in df.select(provider_code("c", SELECT_RULES, else_len=3).alias("y")).collect()]
    assert sel == ["RXH", "RYR", "RDU", "RDU", "RAB", "R1F"]
    assert key == ["RXH", "RYR", "RD701", "RD7", "RAB", "R1F"]  # no RD7 rule in the join key
    assert three == ["RXH", "RYR", "RDU", "RDU", "RAB", "R1F"]


def test_tracking_key_rules(spark):
    df = spark.createDataFrame([("NX500",), ("RAB00",), ("RAB12",), ("XYZ12",)], "c string")
    got = [r.y for r in df.select(provider_code("c", (), exact_rules=(("NX500", "NX5"),), r_prefix_len=3).alias("y")).collect()]
    assert got == ["NX5", "RAB", "RAB", "XYZ12"]


def test_title_case_fixes_first_nhs_only(spark):
    assert one(spark, title_case_nhs("x"), "NHS KENT AND MEDWAY NHS BOARD", "string") == "NHS Kent And Medway Nhs Board"
    assert one(spark, title_case_nhs("x"), "frimley health-care", "string") == "Frimley Health-Care"


def test_percent_text(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (-0.25,), (float("inf"),), (float("-inf"),), (None,), (float("nan",),), (-0.001,)], "x double")
    got = [r.y for r in df.select(percent_text("x").alias("y")).collect()]
    assert got == ["12.5%", "13.5%", "-25.0%", "Inf", "-Inf", None, None, "-0.1%"]
    assert one(spark, percent_text("x"), 0.1234, "double") == "12.3%"


def test_thousands(spark):
    assert one(spark, thousands("x"), 1234567.0, "double") == "1,234,567"
