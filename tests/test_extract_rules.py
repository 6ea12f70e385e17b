"""The SQL extract's rules on literal rows (D3, D4, N4) and D10's repeated rows."""

import datetime as dt

from activity_engine.operators.extract import extract_activity
from activity_engine.params import Params
from activity_engine.sources.tables import Tables

ATT = ("opa_ident bigint, appointment_date date, der_financial_year string, der_activity_month string, "
       "der_provider_code string, treatment_function_code string, first_attendance string, attendance_status string, "
       "administrative_category string, core_hrg string, der_number_procedure int")


def att_row(i, code, tfc, first="2", status="5", fy="2022/23", cat="01", hrg="WF01A", day=dt.date(2022, 5, 17)):
    return (i, day, fy, day.strftime("%Y%m"), code, tfc, first, status, cat, hrg, None)


def tables(spark, rows):
    att = spark.createDataFrame(rows, ATT)
    tfc = spark.createDataFrame([("100", "100 General Surgery"), ("110", "110 Trauma")],
                                "treatment_function_code string, treatment_function_desc string")
    hier = spark.createDataFrame(
        [("RXH", "Brighton", "QNX", "Sussex", "Y59"), ("RYR", "Western", "QNX", "Sussex", "Y59"),
         ("RD7", "Old", "QKS", "Kent", "Y59"), ("RAB", "Elsewhere", "QZZ", "Far", "Y60")],
        "organisation_code string, organisation_name string, stp_code string, stp_name string, region_code string")
    empty = spark.range(0)
    return Tables(att, tfc, hier, empty, empty, empty, empty, empty, empty)


def test_extract_rules(spark):
    rows = [
        att_row(1, "RXH00", "100"),   # '00' rule first: RXH, joins RXH
        att_row(2, "RXH12", "100"),   # RXH prefix -> RYR (select and join key)
        att_row(3, "RD701", "100"),   # RD7 -> RDU in the select list only; the key RD701 finds no organisation
        att_row(4, "RD7", "110"),     # key RD7 matches; reported as RDU
        att_row(5, "RAB", "100"),     # region Y60: dropped by the WHERE (outer join made inner)
        att_row(6, "RXH", None),      # NULL code fails NOT IN
        att_row(7, "RXH", "140"),     # code missing from the TFC table: kept, no description (RXH -> RYR)
        att_row(8, "RXH", "812"),     # excluded code
        att_row(9, "RXH", "100", first="1"),  # first attendance: not a follow-up
        att_row(10, "RXH", "100", hrg="AA01A"),  # not a WF HRG
        att_row(11, "XYZ", "100"),    # not an 'R' code
        att_row(12, "RXH", "100", fy="2021/22"),
    ]
    got = {(r.der_provider_code, r.treatment_function_code, r.treatment_function, r.stp_code): r.activity
           for r in extract_activity(tables(spark, rows), Params()).collect()}
    assert got == {
        ("RXH", "100", "General Surgery", "QNX"): 1,
        ("RYR", "100", "General Surgery", "QNX"): 1,
        ("RDU", "110", "Trauma", "QKS"): 1,
        ("RYR", "140", None, "QNX"): 1,
    }
    assert all(r.month_commencing == dt.date(2022, 5, 1) for r in extract_activity(tables(spark, rows), Params()).collect())


def test_tracking_rows_repeat_and_rolled_rows_do_not(spark):
    from activity_engine.plans.registry import pipeline
    from conftest import SF_MID

    pl = pipeline(spark, SF_MID)
    t = pl.follow_up_tracking
    keys = [c for c in t.columns if c != "appointments"]
    assert t.groupBy(*keys).count().where("count > 1").count() > 0  # grouped by hidden raw columns
    r = pl.follow_up_tracking_rolled
    assert r.groupBy(*keys).count().where("count > 1").count() == 0
    assert t.agg({"appointments": "sum"}).first()[0] == r.agg({"appointments": "sum"}).first()[0]
