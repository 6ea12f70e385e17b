import datetime as dt
import json
import os

import pytest

from activity_engine.sources.files import read_activity_csv, read_baseline_csv, read_holidays, read_provider_lookup, read_system_lookup


def test_activity_csv_rules(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "actuals.csv")
    with open(p, "w") as f:
        f.write("Month_commencing,Treatment_Function_Code,Treatment_Function,Der_Provider_Code,STP_Code,Activity\n")
        f.write("01/04/2022,010,  Oral Surgery  ,RXH,QXX,12\n")  # leading zero kept, spaces trimmed
        f.write("31/02/2022,100,General Surgery,RTH,QYY,3\n")  # impossible date -> NULL
        f.write('01/05/2022,,"",NA,QYY,\n')  # empty, quoted empty and NA -> NULL
    rows = read_activity_csv(spark, p).collect()
    assert rows[0].asDict() == {
        "month_commencing": dt.date(2022, 4, 1), "treatment_function_code": "010", "treatment_function": "Oral Surgery",
        "der_provider_code": "RXH", "stp_code": "QXX", "activity": 12.0}
    assert rows[1].month_commencing is None and rows[1].activity == 3.0
    assert rows[2].treatment_function_code is None and rows[2].treatment_function is None
    assert rows[2].der_provider_code is None and rows[2].activity is None


def test_baseline_and_lookup_csv(spark, tmpdir_path):
    b = os.path.join(tmpdir_path, "baseline.csv")
    with open(b, "w") as f:
        f.write("OrgCode,OrgType,month_commencing,Value\nRXH,Provider,01/03/2020,1234.5\n")
    r = read_baseline_csv(spark, b).first()
    assert r.asDict() == {"orgcode": "RXH", "orgtype": "Provider", "month_commencing": dt.date(2020, 3, 1), "value": 1234.5}
    lk = os.path.join(tmpdir_path, "providers.csv")
    with open(lk, "w") as f:
        f.write("Provider_Code,Provider_Short_Name,Acute_Full_Name,STP_Code\nRXH,Brighton,UNIVERSITY HOSPITALS,QNX\n")
    assert read_provider_lookup(spark, lk).columns == ["provider_code", "provider_short_name", "acute_full_name", "stp_code"]


def test_holiday_json(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bank-holidays.json")
    doc = {
        "england-and-wales": {"division": "england-and-wales", "events": [
            {"title": "New Year", "date": "2023-01-02", "notes": "Substitute day", "bunting": True},
            {"title": "Good Friday", "date": "2023-04-07", "notes": "", "bunting": False}]},
        "scotland": {"division": "scotland", "events": [{"title": "x", "date": "2023-01-03", "notes": "", "bunting": True}]},
    }
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    got = sorted(r.date for r in read_holidays(spark, p).collect())
    assert got == [dt.date(2023, 1, 2), dt.date(2023, 4, 7)]


def test_columns_are_found_by_header_name(spark, tmp_path):
    path = tmp_path / "systems.csv"
    path.write_text("more,short_name,STP_code,stp_name\n1,Kent,QKS,NHS Kent\n")
    got = read_system_lookup(spark, str(path)).collect()
    assert [r.asDict() for r in got] == [{"stp_code": "QKS", "stp_name": "NHS Kent", "short_name": "Kent"}]


def test_a_missing_column_fails(spark, tmp_path):
    path = tmp_path / "systems.csv"
    path.write_text("stp_code,short_name\nQKS,Kent\n")
    with pytest.raises(ValueError, match="stp_name"):
        read_system_lookup(spark, str(path))


HEADER = "Month_commencing,Treatment_Function_Code,Treatment_Function,Der_Provider_Code,STP_Code,Activity\n"


def test_unparsable_cells_are_listed(spark, tmp_path):
    from activity_engine.sources.files import ACTIVITY_SCHEMA, csv_problems

    path = tmp_path / "actuals.csv"
    path.write_text(
        HEADER
        + "01/04/2022,100,Surgery,RXH,QXX,12\n"
        + "31/02/2022,100,Surgery,RTH,QYY,3\n"  # record 3: an impossible date
        + "2022-05-01,100,Surgery,RTH,QYY,many\n"  # record 4: another form of date, a word for a number
        + "01/05/2022,,\"\",NA,QYY,\n"  # empty fields are no problem
        + "NA,100,Surgery,RTH,QYY,NA\n"
        + "01/06/2022,100,Surgery\n"  # record 7: too few fields
        + "01/06/2022,100,Surgery,RTH,QYY,1,extra\n"  # record 8: too many
    )
    rows = csv_problems(spark, str(path), ACTIVITY_SCHEMA).collect()
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {"actuals.csv"}
    got = sorted((r.row, r.col or "", r.expected, r.actual) for r in rows)
    assert got == [
        (3, "month_commencing", "date like %d/%m/%Y", "31/02/2022"),
        (4, "activity", "a double", "many"),
        (4, "month_commencing", "date like %d/%m/%Y", "2022-05-01"),
        (7, "", "6 columns", "01/06/2022,100,Surgery"),
        (8, "", "6 columns", "01/06/2022,100,Surgery,RTH,QYY,1,extra"),
    ]
    data = read_activity_csv(spark, str(path)).collect()
    assert len(data) == 7 and sum(r.month_commencing is None for r in data) == 3 and sum(r.activity is None for r in data) == 4


def test_problems_keep_their_record_numbers_over_splits_and_files(spark, tmp_path):
    from activity_engine.sources.files import ACTIVITY_SCHEMA, csv_problems

    want = []
    for name, n in (("a.csv", 5000), ("b.csv", 3000)):
        lines = []
        for k in range(n):
            bad = k % 997 == 5
            lines.append(f"01/04/2022,{k:03d},Surgery,RXH,QXX,{'x' + str(k) if bad else k}\n")
            if bad:
                want.append((name, k + 2, "activity", f"x{k}"))
        (tmp_path / name).write_text(HEADER + "".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = csv_problems(spark, str(tmp_path), ACTIVITY_SCHEMA)
        rows = found.collect()
        assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file.rsplit("/", 1)[1], r.row, r.col, r.actual) for r in rows) == sorted(want)


def test_no_problems_and_an_empty_file(spark, tmp_path):
    from activity_engine.sources.files import BASELINE_SCHEMA, csv_problems, read_tfc_list

    path = tmp_path / "baseline.csv"
    path.write_text("OrgCode,OrgType,month_commencing,Value\n")
    assert csv_problems(spark, str(path), BASELINE_SCHEMA).count() == 0
    path = tmp_path / "tfc.csv"
    path.write_text("TFC_Code, Description\n010, Oral Surgery\n,NA\n")
    assert [r.asDict() for r in read_tfc_list(spark, str(path)).collect()] == [
        {"tfc_code": "010", "description": "Oral Surgery"}, {"tfc_code": None, "description": None}]
