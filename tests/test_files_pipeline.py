"""The reference's workflow: CSV extracts + lookups in, the same outputs as the parquet path."""

import datetime as dt
import os

from pyspark.sql import functions as F

from activity_engine.params import test_params as make_params
from activity_engine.plans.files_pipeline import from_files
from activity_engine.plans.registry import pipeline
from activity_engine.sources.testmap import rule_holidays
from conftest import SF_MID


def _csv(df, path, date_cols=()):
    out = df
    for c in date_cols:
        out = out.withColumn(c, F.date_format(c, "dd/MM/yyyy"))
    out.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    return path


def test_csv_extracts_give_the_same_gap_and_fair_share(spark, tmpdir_path):
    ref = pipeline(spark, SF_MID)
    a = _csv(ref.extract.toDF("Month_commencing", "Treatment_Function_Code", "Treatment_Function",
                              "Der_Provider_Code", "STP_Code", "Activity"),
             os.path.join(tmpdir_path, "actuals"), ["Month_commencing"])
    b = _csv(ref.baseline.toDF("OrgCode", "OrgType", "month_commencing", "Value"),
             os.path.join(tmpdir_path, "baseline"), ["month_commencing"])
    p = _csv(ref.t.provider_lookup, os.path.join(tmpdir_path, "providers"))
    s = _csv(ref.t.system_lookup, os.path.join(tmpdir_path, "systems"))
    older = {
        f"{name}_csv": _csv(frame.toDF("Month_commencing", "Treatment_Function_Code", "Treatment_Function",
                                       "Der_Provider_Code", "STP_Code", "Activity"),
                            os.path.join(tmpdir_path, name), ["Month_commencing"])
        for name, frame in (("three_years", ref.extract_3y), ("history", ref.extract_history),
                            ("excl_march", ref.extract_excl_march))
    }
    params = make_params().with_(
        calendar_start=dt.date(1994, 4, 1), calendar_end=dt.date(2002, 3, 31),
        acutes=tuple(r.provider_code for r in ref.t.acutes.collect()),
    )
    pl = from_files(spark, a, b, p, s, params, holidays=rule_holidays, **older)  # the same holidays as the parquet path
    for name in ("gap_by_year", "fair_share", "cohort_coverage", "activity_comparison", "march_counterfactual",
                 "per_day_gap_v1"):
        got = sorted(map(tuple, getattr(pl, name).collect()), key=repr)
        want = sorted(map(tuple, getattr(ref, name).collect()), key=repr)
        assert len(got) == len(want) > 0
        for g, w in zip(got, want):
            for x, y in zip(g, w):
                if isinstance(x, float):
                    assert (x != x and y != y) or abs(x - y) <= 1e-9 * max(1.0, abs(y)), (name, g, w)
                else:
                    assert x == y, (name, g, w)
