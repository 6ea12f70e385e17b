import datetime as dt
import os

from pyspark.sql import functions as F

from activity_engine.sinks.writers import ordered, run_stamp, write_report_feeds, write_table


def test_ordered_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in ordered(df, [("x", False)]).collect()] == [1, 3, None]
    assert [r.x for r in ordered(df, [("x", True)]).collect()] == [3, 1, None]


def test_report_feeds_are_one_partitioned_write(spark, tmpdir_path):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0)], "report string, v double")
    path = write_report_feeds(df, tmpdir_path, "systems", dt.date(2024, 1, 31))
    assert path.endswith("systems/31012024")
    assert sorted(d for d in os.listdir(path) if d.startswith("report=")) == ["report=A", "report=B"]
    back = spark.read.parquet(path)
    assert back.where(F.col("report") == "A").count() == 2


def test_write_table_csv_header(spark, tmpdir_path):
    df = spark.createDataFrame([("x", 2), ("y", 1)], "a string, b int")
    out = os.path.join(tmpdir_path, "t")
    write_table(df, out, fmt="csv", order=[("b", False)])
    back = spark.read.option("header", "true").csv(out)
    assert back.columns == ["a", "b"] and back.count() == 2
    assert run_stamp(dt.date(2023, 3, 5)) == "05032023"


def test_tracking_table_is_saved_to_the_catalog(spark):
    from activity_engine.plans.registry import pipeline
    from activity_engine.sinks.writers import save_tracking_table
    from conftest import SF_SMALL

    t = pipeline(spark, SF_SMALL).follow_up_tracking
    save_tracking_table(t, "follow_up_tracking_test")
    assert spark.table("follow_up_tracking_test").count() == t.count()


def test_the_rank_keeps_the_order(spark, tmp_path):
    from activity_engine.sinks.writers import ranked

    df = spark.createDataFrame([("a", 1.0, 7), ("b", None, 1), ("c", 1.0, 2), (None, 9.0, 3)], "k string, v double, t int")
    got = {(r.k, r.v): r.sort_rank for r in ranked(df, [("v", True)]).collect()}
    assert got == {(None, 9.0): 1, ("a", 1.0): 2, ("c", 1.0): 3, ("b", None): 4}
    write_table(df.repartition(3), str(tmp_path / "t"), order=[("v", False)], rank=True)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [r.k for r in back.orderBy("sort_rank").collect()] == ["a", "c", None, "b"]


def test_a_failed_run_leaves_the_published_day_whole(spark, tmp_path):
    import pytest

    from activity_engine.sinks.writers import manifest, publish, published

    root, day = str(tmp_path / "out"), dt.date(2024, 1, 31)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        published(spark, root, "systems", day)
    first = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0)], "report string, v double")
    publish(spark, first, root, "systems", day)
    publish(spark, first, root, "trusts", day)
    rows = lambda: sorted((r.report, r.v) for r in published(spark, root, "systems", day).collect())
    assert rows() == [("A", 1.0), ("A", 2.0), ("B", 3.0)]
    # a run that loses a task midway: other tasks have written their files
    broken = first.repartition(3, "report").withColumn("v", F.when(F.col("report") == "B", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v") + 10))
    with pytest.raises(Exception, match="lost"):
        publish(spark, broken, root, "systems", day)
    assert rows() == [("A", 1.0), ("A", 2.0), ("B", 3.0)]
    # the repeated run replaces the day, also with fewer reports; other kinds and days stay
    publish(spark, first.where("report = 'A'").withColumn("v", F.col("v") + 10), root, "systems", day)
    assert rows() == [("A", 11.0), ("A", 12.0)]
    assert {(r.kind, r.report, r.rows) for r in manifest(spark, root).where("rows > 0").collect()} == {("systems", "A", 2), ("trusts", "A", 2), ("trusts", "B", 1)}
    with pytest.raises(ValueError, match="nothing is published"):
        published(spark, root, "systems", dt.date(2024, 2, 1))
    publish(spark, first.where("false"), root, "systems", dt.date(2024, 2, 1))
    assert manifest(spark, root).where("day = '01022024' and rows > 0").count() == 0


def test_tracking_increments_are_one_full_build(spark, tmp_path):
    from activity_engine.operators.extract import follow_up_tracking
    from activity_engine.plans.registry import pipeline
    from activity_engine.sinks.writers import add_tracking, tracking_table
    from conftest import SF_SMALL

    pl = pipeline(spark, SF_SMALL)
    whole = pl.follow_up_tracking_rolled
    path, fys = str(tmp_path / "tracking"), pl.p.tracking_fys
    parts = {"old": fys[:1], "new": fys[1:]}
    for name, years in parts.items():
        add_tracking(follow_up_tracking(pl.t, pl.p.with_(tracking_fys=years)), path, name)
    got = tracking_table(spark, path, whole.columns)
    want = sorted(map(repr, whole.collect()))
    assert sorted(map(repr, got.collect())) == want and got.columns == whole.columns
    # the same batch again changes nothing, and no other batch is touched
    stamp = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(path, "batch=old")) for f in fs}
    add_tracking(follow_up_tracking(pl.t, pl.p.with_(tracking_fys=parts["new"])), path, "new")
    assert sorted(map(repr, tracking_table(spark, path, whole.columns).collect())) == want
    assert stamp == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(path, "batch=old")) for f in fs}
    # months are folders, so a reader of some months reads those alone
    assert any(d.startswith("activity_month_year=") for d in os.listdir(os.path.join(path, "batch=new")))


def test_pivots_with_lists_or_unique_cells(spark):
    import pytest

    from activity_engine.operators.quality import duplicated_cells, pivot_lists

    rows = [("k", "a", 2.0), ("k", "a", 1.0), ("k", "a", None), ("k", "b", 5.0), (None, "a", None), ("m", "other", 1.0)]
    df = spark.createDataFrame(rows, "id string, name string, v double")
    wide = pivot_lists(df, ["id"], "name", ["a", "b"], "v")
    assert {r.id: (r.a, r.b) for r in wide.collect()} == {"k": ([1.0, 2.0, None], [5.0]), None: ([None], None), "m": (None, None)}
    assert [tuple(r) for r in duplicated_cells(wide, ["id"], ["a", "b"]).collect()] == [("k", "a", 3, 1.0, 2.0, None)]
    single = pivot_lists(df.where("v > 1"), ["id"], "name", ["a", "b"], "v", unique=True).collect()
    assert [tuple(r) for r in single] == [("k", 2.0, 5.0)]
    with pytest.raises(Exception, match="several values in column a"):
        pivot_lists(df, ["id"], "name", ["a", "b"], "v", unique=True).collect()
