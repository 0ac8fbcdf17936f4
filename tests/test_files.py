"""CSV and workbooks: what is written can be read back, at any split of a file."""

import csv
import io
import json
import random

import pandas as pd
import pytest

from tidemark import cli
from tidemark.functions.months import MONTHS
from tidemark.operators import models
from tidemark.plans import history, scoring, yearly
from tidemark.sources import delimited, files, xlsx

FIELDS = ("plain", "a,b", 'say ""x""', "two\nlines", '"', 'x"y', "", " lead ", "राम", "é€", "l1\r\nl2\n\nl3", "   ", "\n", '5" pipe', ',",')


@pytest.fixture
def splits(spark):
    """Sets the size of splits; the session's own is back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(size):
        for n, v in zip(names, (size, 0), strict=True):
            spark.conf.set(n, str(v))

    yield put
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [40, 300, 10**8])
def test_csv_reads_like_pandas_at_any_split(spark, tmp_path, splits, size):
    rng = random.Random(size)
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator="\r\n" if size == 300 else "\n")
    writer.writerow(["a", "b\nc", "a"])
    writer.writerows([[rng.choice(FIELDS) for _ in range(3)] for _ in range(150)])
    raw = text.getvalue().encode() + b'x,5" pipe,z\n\n   \nlast,"q",\n'
    (tmp_path / "f.csv").write_bytes((b"\xef\xbb\xbf" if size == 40 else b"") + raw)
    want = pd.read_csv(io.BytesIO(raw), dtype=str, keep_default_na=False)
    splits(size)
    df, n = delimited.read(spark, f"{tmp_path}/f.csv")
    got = df.orderBy("row_order").toPandas()
    assert n == len(want) and got["row_order"].tolist() == list(range(n))
    assert list(got.columns) == [*want.columns, "row_order"]
    assert got.iloc[:, :3].fillna("").values.tolist() == want.values.tolist()


def test_a_folder_of_files_and_files_without_rows(spark, tmp_path):
    for k, text in enumerate(("a,b\n1,2\n", "a,b\n", 'a,b\n"x\ny",3\n')):
        (tmp_path / f"{k}.csv").write_text(text)
    df, n = delimited.read(spark, str(tmp_path))
    assert n == 2 and [tuple(r) for r in df.orderBy("row_order").collect()] == [("1", "2", 0), ("x\ny", "3", 1)]
    (tmp_path / "3.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError):
        delimited.read(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    with pytest.raises(ValueError):
        delimited.read(spark, f"{tmp_path}/empty")


def test_encodings_are_told_by_bytes(spark, tmp_path):
    cases = {"u": ("राम �", "utf-8"), "c": ("José € ’", "cp1252"), "l": ("é\x81", "latin-1")}
    for name, (text, encoding) in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(f"State\n{text}\n".encode(encoding))
        assert files.read_csv(spark, f"{tmp_path}/{name}.csv").first()["State"] == text


def test_csv_round_trip(spark, tmp_path):
    rows = [(k, None if f == "" else f) for k, f in enumerate(FIELDS)]
    files.write_csv(spark.createDataFrame(rows, "k int, f string").repartition(3), f"{tmp_path}/out")
    got = {int(r["k"]): r["f"] for r in files.read_csv(spark, f"{tmp_path}/out").collect()}
    assert got == dict(rows)
    held = pd.concat(pd.read_csv(p, dtype=str, keep_default_na=False) for p in (tmp_path / "out").glob("*.csv"))
    assert {int(k): f or None for k, f in held[["k", "f"]].itertuples(index=False)} == dict(rows)


def test_score_then_enrich_keeps_awkward_names(spark, tmp_path, capsys):
    names = ('A "B", C', "two\nlines", "राम", " x,y ")
    months = [f"Month {k} scan" for k in range(1, 7)]
    rows = [(f"S{k % 2}", *(float((k * j) % 7) for j in range(1, 7)), k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "state string, " + ", ".join(f"scan_m{k} double" for k in range(1, 7)) + ", target int")
    model, lookup, final = (f"{tmp_path}/{x}" for x in ("model", "lookup", "final"))
    models.save(models.train(df, "logistic_regression"), model)
    pd.DataFrame([["UP", n, f"900000000{k}", *range(6)] for k, n in enumerate(names)], columns=["State", "Customer Name", "Mobile no", *months]).to_csv(tmp_path / "up.csv", index=False)
    spark.createDataFrame([("9000000001", 30000.0, ">25k")], ["mobile_id", "Potential", "Potential Band"]).write.parquet(lookup)
    cli.main(["score", "--input", f"{tmp_path}/up.csv", "--model", model, "--scan-columns", ",".join(months), "--name-column", "Customer Name"], spark)
    told = json.loads(capsys.readouterr().out)
    assert told["output"] == f"{tmp_path}/up_scored.csv" and told["output_rows"] == told["input_rows"] == 4
    assert sum(told["risk_counts"].values()) == 4 and told["churn_probability_missing_or_nonnumeric"] == 0
    cli.main(["enrich", "--input", told["output"], "--lookup", lookup, "--output", final], spark)
    told = json.loads(capsys.readouterr().out)
    assert told["schema_matches"] and told["warnings"] == [] and told["nulls"]["Potential"] == 3
    got = files.read_csv(spark, final, order=True).orderBy("row_order").collect()
    assert [r["Customer name"] for r in got] == list(names) and got[1]["Potential Band"] == ">25k"
    with pytest.raises(SystemExit):
        cli.main(["enrich", "--input", "x", "--output", "y"], spark)


def test_lineage_of_a_scoring_upload(spark):
    upload = spark.createDataFrame([("UP", "A", "9000000001", *"123456", 0)], ["State", "Name", "Mobile", *"abcdef", "row_order"])
    row = scoring.prepare(upload, mobile="Mobile").first()
    assert row["scoring_scan_source_columns"] == "a,b,c,d,e,f"
    assert row["scoring_identifier_source_columns"] == "State=State,Name=Name,MobileNo1=Mobile"


def test_quality_is_counted_while_the_yearly_table_is_written(spark, tmp_path, caplog):
    head = "State,Name,MobileNo1," + ",".join(MONTHS) + "\n"
    (tmp_path / "2023.csv").write_text(head + "up,A,9000000001," + ",".join(["1"] * 12) + "\n-,B,12,x," + ",".join(["2"] * 11) + "\n")
    (tmp_path / "2024.csv").write_text("State,Name,MobileNo1,Month,Scans\nUP,A,9000000001,15-Mar-2024,5\nUP,A,9000000001,\tMar,1\nUP,A,9000000001,someday,7\nMP,C,,2024-03-01,y\n")
    watch: yearly.Watch = {}
    files.write_yearly(yearly.build_yearly(spark, str(tmp_path), watch=watch), f"{tmp_path}/out")
    told = {r["source_file"]: r for r in yearly.quality_report(watch)}
    assert {k: told["2023.csv"][k] for k in ("row_count", "blank_state", "not_numeric", "mobile_valid", "mobile_invalid")} == {"row_count": 2, "blank_state": 1, "not_numeric": 1, "mobile_valid": 1, "mobile_invalid": 1}
    assert {k: told["2024.csv"][k] for k in ("row_count", "blank_mobileno1", "not_numeric", "unread_months")} == {"row_count": 4, "blank_mobileno1": 1, "not_numeric": 1, "unread_months": 1}
    assert "name no month" in caplog.text
    march = files.read_yearly(spark, f"{tmp_path}/out").filter("source_year = 2024 and mobile_is_valid").first()
    assert march["Mar"] == 6.0


def test_yearly_files_of_either_name(spark, tmp_path):
    (tmp_path / "yearly_2023.csv").write_text("a,b\n1,2\n")
    assert history.read_yearly_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "yearly_2024_cleaned.csv").write_text("a,c\n1,2\n3,4\n")
    assert history.read_yearly_files(spark, str(tmp_path)).columns == ["a", "c"]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        history.yearly_paths(spark, f"{tmp_path}/none")


def test_workbooks_sheet_by_sheet(spark, tmp_path, caplog):
    df = spark.createDataFrame([(f"n{k}", k + 0.5, "x\ny" if k else None) for k in range(30)], "s string, v double, t string").repartition(4).orderBy("v")
    path = f"{tmp_path}/book.xlsx"
    assert xlsx.write_xlsx(df, path) == 30
    (sheet,) = xlsx.read_xlsx(spark, path, columns=["t", "s"]).values()
    got = sheet.orderBy("row_order").collect()
    assert sheet.columns == ["s", "t", "row_order"] and [r["s"] for r in got] == [f"n{k}" for k in range(30)] and got[1]["t"] == "x\ny" and got[0]["t"] is None
    with pytest.raises(Exception, match="fit a sheet"):
        xlsx.write_xlsx(df, path, most=29)
    (tmp_path / "broken.xlsx").write_bytes(b"PK nothing")
    assert xlsx.read_xlsx(spark, f"{tmp_path}/broken.xlsx") == {} and "skipped" in caplog.text
    both = xlsx.read_cells(spark, [path, f"{tmp_path}/broken.xlsx"])
    assert both.rdd.getNumPartitions() == 2 and both.filter("problem is not null").count() == 1


def test_a_sheet_that_begins_below_row_one(spark, tmp_path):
    import zipfile

    main = xlsx._M[1:-1]
    sheet = f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="inlineStr"><is><t>h</t></is></c></row><row r="5"><c r="B5"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "low.xlsx", "w") as z:
        for name, text in xlsx._parts():
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (rows,) = xlsx.read_xlsx(spark, f"{tmp_path}/low.xlsx").values()
    assert [tuple(r) for r in rows.collect()] == [("7", 5)]


def test_a_report_is_not_cut(spark):
    assert files.markdown(spark.range(3)).count("\n") == 4
    with pytest.raises(ValueError):
        files.markdown(spark.range(1001))
