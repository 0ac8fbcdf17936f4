import pytest
from pyspark.sql import functions as F

from tidemark.functions.months import MONTHS
from tidemark.operators import panel, potential
from tidemark.plans import scoring, yearly
from tidemark.sources import files, xlsx


def test_year_of_a_path():
    assert files.year_of("/x/2023/file.csv") == 2023
    assert files.year_of("/x/2023/2024.csv") is None
    assert files.year_of("/x/120234.csv") is None


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("State,Name\nOrissa,José\n€,x\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿State,Name\nOrissa,José\n".encode())
    for name in "ab":
        df = files.read_csv(spark, f"{tmp_path}/{name}.csv")
        assert df.columns == ["State", "Name"] and df.first()["Name"] == "José"
    assert files.read_csv(spark, f"{tmp_path}/a.csv").collect()[1]["State"] == "€"


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 1.5, None), ("<c>", 2.0, "x")], "s string, v double, t string")
    xlsx.write_xlsx(df, f"{tmp_path}/2023 book.xlsx")
    ((_, sheet), got), = xlsx.read_xlsx(spark, f"{tmp_path}/2023 book.xlsx").items()
    assert sheet == "Sheet1"
    assert [tuple(r) for r in got.orderBy("row_order").collect()] == [("a & b", "1.5", None, 2), ("<c>", "2", "x", 3)]


def test_raw_files_to_panel(spark, tmp_path):
    head = "State Name,Name,Mobile No," + ",".join(MONTHS) + "\n"
    (tmp_path / "2023.csv").write_text(head + "up,A,9000000001," + ",".join(["1"] * 12) + "\nUP,A,+919000000001," + ",".join(["2"] * 12) + "\nup,B,12," + ",".join(["-"] * 12) + "\n")
    (tmp_path / "2024 long.csv").write_text("State,Name,MobileNo1,Month,Scans\nUP,A,9000000001,January,5\nUP,A,9000000001,2,7\nMP,C,9000000003,2024-03-01,\n")
    (tmp_path / "2024 other.csv").write_text("x,y\n1,2\n")
    rows = yearly.build_yearly(spark, str(tmp_path)).cache()
    got = {(r["source_year"], r["mobile_id"]): r for r in rows.collect()}
    assert len(got) == 4
    assert got[2023, "9000000001"]["Jan"] == 3.0 and got[2023, "9000000001"]["source_duplicate_row_count"] == 2
    assert got[2023, "12"]["mobile_is_valid"] is False
    assert got[2024, "9000000001"]["Feb"] == 7.0
    p = panel.build_panel(rows)
    assert p.count() == 48
    assert p.filter("influencer_id like 'INVALID::%'").count() == 12
    yearly_dir = f"{tmp_path}/out"
    files.write_yearly(rows, yearly_dir)
    assert files.read_yearly(spark, yearly_dir).filter("source_year = 2024").count() == 2


def test_upload_to_final(spark):
    upload = spark.createDataFrame(
        [("Up", "A", "9000000001", "1", "1", "1", "50", "50", "50", 1), ("Up", "B", "9000000002", "9", "9", "9", "0", "", "x", 2), ("MP", "C", None, "0", "0", "0", "0", "0", "0", 3)],
        ["State", "Customer Name", "mobileNo", *(f"Month {k} scan" for k in range(1, 7)), "row_order"],
    )
    prepared = scoring.prepare(upload)
    assert [r["recent_status"] for r in prepared.orderBy("row_order").collect()] == ["recently_scanning", "recently_inactive", "recently_inactive"]
    scored = scoring.score(prepared, lambda df: df.withColumn("risk_score", F.when(F.col("recent_status") == "recently_inactive", 0.9).otherwise(0.2)))
    history = spark.createDataFrame([("9000000001", o, 3000.0) for o in range(6)], "mobile_id string, ord int, scan_points double")
    final = scoring.enrich(scored, potential.lookup(history))
    got = final.orderBy("row_order").collect()
    assert [(r["Risk"], r["Potential Band"]) for r in got] == [("LOW RISK", ">25k"), ("HIGH RISK", None), ("HIGH RISK", None)]
    check = scoring.summary(upload, final, [c for c in final.columns if c != "row_order"])
    assert check["schema_matches"] and check["input_rows"] == check["output_rows"] == 3
    with pytest.raises(ValueError):
        scoring.prepare(upload.unionByName(upload))
