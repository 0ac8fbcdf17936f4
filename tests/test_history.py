import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import cleaning
from tidemark.operators import models, potential, windows
from tidemark.plans import history
from tidemark.plans.errors import DecisionRequired

MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"


@pytest.fixture
def yearly(tmp_path):
    directory = tmp_path / "processed"
    directory.mkdir()
    (directory / "yearly_2024_cleaned.csv").write_text(f"MobileNo1,{MONTHS}\n90000 00001,{','.join(['1000'] * 12)}\n9000000002,{','.join(['1', ''] * 6)}\n")
    (directory / "yearly_2023_cleaned.csv").write_text(f"MobileNo1,{MONTHS}\n9000000001,{','.join(['9000'] * 12)}\n")
    return str(directory)


def test_history_falls_back_to_yearly_files(spark, tmp_path, yearly):
    rows, origin = history.load(spark, str(tmp_path / "none.parquet"), yearly)
    assert origin.startswith("cleaned_yearly_fallback:")
    got = {(r["mobile_id"], r["ord"]): r["scan_points"] for r in rows.collect()}
    assert len(got) == 24 and got["9000000001", 2024 * 12 + 1] == 1000 and got["9000000002", 2024 * 12 + 2] is None
    with pytest.raises(FileNotFoundError):
        history.load(spark, str(tmp_path / "none.parquet"), str(tmp_path / "nowhere"))


def test_history_prefers_the_panel(spark, tmp_path, yearly):
    path = str(tmp_path / "panel.parquet")
    spark.createDataFrame([("a", "2024-02-01", "5"), ("a", None, "6"), ("b", "2024-03-01", "x")], "influencer_id string, month_date string, scan_points string").write.parquet(path)
    rows, origin = history.load(spark, path, yearly)
    assert origin.startswith("monthly_panel:")
    assert sorted(map(tuple, rows.collect())) == [("a", 2024 * 12 + 2, 5.0), ("b", 2024 * 12 + 3, None)]
    with pytest.raises(ValueError):
        history.panel_columns(spark.range(1))
    assert history.window_columns(spark.createDataFrame([(1, 2, 3)], "month_date int, scan_points int, State int")).columns == ["period", "scan_value", "State"]


def test_enrich_command(spark, tmp_path, yearly, capsys):
    source, target = tmp_path / "scored.csv", str(tmp_path / "final")
    source.write_text("State,Customer name,Customer mobile number,Churn probability,Risk\nB,x,+91 9000000001,0.9,HIGH RISK\nA,y,9000000003,0.1,LOW RISK\n")
    cli.main(["enrich", "--input", str(source), "--panel", str(tmp_path / "none.parquet"), "--yearly", yearly, "--output", target], spark)
    told = json.loads(capsys.readouterr().out)
    assert (told["input_rows"], told["output_rows"], told["schema_matches"], told["warnings"]) == (2, 2, True, [])
    got = spark.read.csv(target, header=True).collect()
    assert {r["Customer name"]: (r["Potential"], r["Potential Band"]) for r in got} == {"x": ("12000.0", "12-15k"), "y": (None, None)}
    source.write_text("State,Risk\nB,HIGH RISK\n")
    with pytest.raises(ValueError):
        cli.enrich_file(spark, str(source), "none", yearly, target)


def test_score_command(spark, tmp_path, capsys):
    rows = [(f"S{k % 2}", *(float((k * j) % 7) for j in range(1, 7)), k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "state string, " + ", ".join(f"scan_m{k} double" for k in range(1, 7)) + ", target int")
    model, source, target = str(tmp_path / "model"), tmp_path / "upload.CSV", str(tmp_path / "scored")
    models.save(models.train(df, "logistic_regression"), model)
    source.write_text("State,Customer Name,Mobile no," + ",".join(f"Month {k} scan" for k in range(1, 7)) + "\n" + "".join(f"S{k % 2},n{k},90000000{k:02},1,2,,4,x,6\n" for k in range(12)))
    cli.main(["score", "--input", str(source), "--model", model, "--output", target], spark)
    told = json.loads(capsys.readouterr().out)
    assert (told["input_rows"], told["output_rows"], told["schema_matches"]) == (12, 12, True)
    with pytest.raises(ValueError):
        cli.read_upload(spark, "upload.txt")


def test_windows_carry_the_last_value_that_is_not_blank(spark):
    start = 2022 * 12 + 1
    states = ["A", "B", " ", None, "nan", "C", "", None, "NaN", " "]
    panel = spark.createDataFrame([("e", start + k, 1.0, s) for k, s in enumerate(states)] + [("f", start + k, 1.0, None) for k in (*range(9), 10)], "influencer_id string, ord int, scan_points double, state string")
    built = windows.build(panel, "influencer_id", carry=("state",))
    assert sorted((r["influencer_id"], r["state"]) for r in built.collect()) == [("e", "C"), ("e", "C"), ("f", None)]
    stats = windows.build_stats(panel, built).first().asDict()
    assert (stats["influencers_seen"], stats["total_candidate_windows"], stats["generated_windows"], stats["skipped_nonconsecutive_windows"]) == (2, 4, 3, 1)
    assert [tuple(r) for r in windows.example_counts(built).collect()] == [("2022-01_to_2022-06_target_2022-07_to_2022-09", 2)]
    nothing = windows.build_stats(panel.limit(0), built.limit(0)).first().asDict()
    assert set(nothing.values()) == {0}


def test_potential_by_rule(spark):
    df = spark.createDataFrame([("a", 7.0)], "mobile_id string, best double")
    assert potential.configured(df, {"type": "explicit_column", "column": "best"}).first()["potential"] == 7.0
    for rule in (None, {"type": "TBD"}, {"type": "other"}):
        with pytest.raises(DecisionRequired):
            potential.configured(df, rule)
    with pytest.raises(ValueError):
        potential.configured(df, {"type": "explicit_column", "column": "none"})


def test_none_if_blank(spark):
    got = spark.createDataFrame([("",), ("NaN",), ("x",), (None,)], "c string").select(cleaning.none_if_blank(F.col("c"))).collect()
    assert [r[0] for r in got] == [None, None, "x", None]
