import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning
from tidemark.operators import duplicates, evaluation, features, labels, potential, ranking, risk, windows
from tidemark.plans.errors import DecisionRequired


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_mobile(spark):
    got = frame(spark, [("9000000001",), ("+91 90000-00001",), ("9000000002.0",), ("12345678",), ("abc",), ("",), (None,), ("N/A",), ("9000000002.0\t",), ("\u00a0\n",)], "m string").select(cleaning.mobile(F.col("m")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [
        ("9000000001", "9000000001", True, "valid"), ("9000000001", "919000000001", True, "trimmed_to_last_10"), ("9000000002", "9000000002", True, "valid"),
        ("12345678", "12345678", False, "invalid_length_8"), (None, None, False, "no_digits"), (None, None, False, "blank"), (None, None, False, "blank"), (None, None, False, "blank"),
        ("9000000002", "9000000002", True, "valid"), (None, None, False, "blank"),
    ]


def test_numbers(spark):
    got = frame(spark, [("5d",), ("nan",), (" 1e3 ",), ("-2.5",), (".5",), ("1,000",), (None,)], "x string").select(cleaning.number(F.col("x"))).collect()
    assert [r[0] for r in got] == [None, None, 1000.0, -2.5, 0.5, None, None]


def test_windows_need_gap_free_months(spark):
    def count(ords):
        return windows.sliding(frame(spark, [("a", o, 1.0) for o in ords], "e string, ord int, scan_points double"), "e").count()

    start = 2022 * 12 + 1
    for run in (8, 9, 10, 14):
        assert count(range(start, start + run)) == max(0, run - 8)
    assert count([o for o in range(start, start + 20) if o != start + 10]) == 2 + 1
    assert count([*range(start, start + 9), start + 4]) == 0  # a month twice


def test_tasks_grow_with_the_rows_of_a_pivot(spark, monkeypatch):
    from tidemark.queries import QUERIES

    data = "/root/testdata/sf0.001"
    want = sorted(map(str, QUERIES["pivot_year_wide"](spark, data).collect()))
    monkeypatch.setattr(windows, "TASK_ROWS", 500)
    got = QUERIES["pivot_year_wide"](spark, data)
    assert got.rdd.getNumPartitions() == -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)
    assert sorted(map(str, got.collect())) == want
    long = QUERIES["unpivot_months"](spark, data)
    assert long.rdd.getNumPartitions() == got.rdd.getNumPartitions()
    assert long.count() == 12 * len(want)


def test_tasks_grow_with_the_rows_of_a_pivot_where_shuffle_partitions_are_many(spark, monkeypatch):
    from tidemark.queries import QUERIES

    data = "/root/testdata/sf0.001"
    want = sorted(map(str, QUERIES["unpivot_months"](spark, data).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(windows, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # Spark would put these together again
    try:
        got = QUERIES["unpivot_months"](spark, data)
        assert got.rdd.getNumPartitions() == -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)
        assert sorted(map(str, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_named_windows(spark):
    rows = [("a", o, float(o % 5)) for o in range(2022 * 12 + 1, 2026 * 12)]
    got = windows.build(frame(spark, rows, "e string, ord int, scan_points double"), "e").select("feature_window_start_month", "target_window_start_month", "target_window_end_month", "split").collect()
    ends = {r[0]: tuple(r[1:]) for r in got}
    assert ends["2022-01"] == ("2022-07", "2022-09", "development")
    assert ends["2022-05"] == ("2022-11", "2023-01", "development")
    assert ends["2024-10"] == ("2025-04", "2025-06", "holdout_2025")
    assert ends["2024-06"] == ("2024-12", "2025-02", "excluded_split_gap")
    assert len(got) == 47 - 8


def test_labels(spark):
    rows = frame(spark, [(100.0, 0.0), (0.0, 50.0), (100.0, 90.0)], "recent_3m_total double, future_3m_total double").withColumn("future_minus_recent", F.col("future_3m_total") - F.col("recent_3m_total"))
    target = lambda rule: [r["target"] for r in labels.label(rows, rule).collect()]
    assert target({"type": "future_total_rule", "source_column": "future_minus_recent", "operator": "<=", "threshold": -100}) == [1, 0, 0]
    assert target({"type": "decline_rule", "baseline_column": "recent_3m_total", "comparison_column": "future_3m_total", "operator": "<", "threshold": 0.5}) == [1, 0, 0]
    for rule in (None, {"type": "TBD"}, {"type": "other"}, {"type": "future_total_rule", "operator": "<"}, {"type": "future_total_rule", "operator": "!=", "threshold": 1}):
        with pytest.raises(DecisionRequired):
            labels.label(rows, rule)


def test_potential_tolerance_and_gaps(spark):
    ords = [*range(100, 108), *range(109, 114)]
    rows = [("a", o, 1000.0 + (0.001 if o == 107 else 0)) for o in ords] + [("b", o, 1.0) for o in range(5)]
    got = potential.lookup(frame(spark, rows, "mobile_id string, ord int, scan_points double")).collect()
    assert len(got) == 1
    assert got[0]["best_window_end_month"] == "0008-09"  # ordinal 105: the earliest within the tolerance
    bands = frame(spark, [(11999.99,), (12000.0,), (14999.99,), (15000.0,), (25000.0,), (25000.01,), (None,)], "p double").select(potential.band(F.col("p"))).collect()
    assert [r[0] for r in bands] == ["<12k", "12-15k", "12-15k", "15-25k", "15-25k", ">25k", None]


def test_risk_bounds(spark):
    got = frame(spark, [(0.4999,), (0.5,), (0.8499,), (0.85,), (None,)], "p double").select(risk.risk(F.col("p"))).collect()
    assert [r[0] for r in got] == ["LOW RISK", "MEDIUM RISK", "MEDIUM RISK", "HIGH RISK", "LOW RISK"]


def test_dashboard(spark):
    rows = [("a ", "n", "1", 0.9, "HIGH RISK", 30000.0, ">25k"), ("B", "n", "2", 0.6, "MEDIUM RISK", None, None), ("B", "n", "3", 0.1, "low risk", 13000.0, "12-15k"), (None, "n", "4", 0.1, "LOW RISK", 1.0, "odd")]
    got = risk.dashboard(frame(spark, rows, "State string, `Customer name` string, `Customer mobile number` string, `Churn probability` double, Risk string, Potential double, `Potential Band` string"), state="b")
    assert got["by_bucket"] == {"RED": 1, "ORANGE": 0, "GREEN": 0, "OTHER": 3}
    assert got["states"] == ["A", "B"]
    assert ("band", "odd", 1) in got["warnings"] and ("combination", "MEDIUM RISK|OTHER", 1) in got["warnings"]
    assert got["records"].count() == 2


def test_measures_by_hand(spark):
    df = frame(spark, [(0.9, 1, 1), (0.8, 0, 2), (0.8, 1, 3), (0.4, 0, 4), (0.3, 1, 5), (0.1, 0, 6)], "s double, target int, k int")
    m = evaluation.metrics(df, "s").first()
    assert abs(m["pr_auc"] - 0.7556) < 1e-4 and abs(m["roc_auc"] - 0.7222) < 1e-4
    assert evaluation.metrics(df.filter("target = 1"), "s").first()["roc_auc"] is None
    assert evaluation.top_k(df, "s", "k", (2, 100)).count() == 1


def test_ranks_are_permutations(spark):
    df = spark.range(500).select(F.col("id").alias("row_order"), (F.col("id") % 7 / 7).alias("risk_score"), F.when(F.col("id") % 3 == 0, "recently_scanning").otherwise("recently_inactive").alias("recent_status"))
    got = ranking.prioritise(df, {"type": "recently_scanning_first"}).collect()
    assert sorted(r["operational_rank"] for r in got) == list(range(1, 501))
    assert max(r["operational_rank"] for r in got if r["recent_status"] == "recently_scanning") == 167
    for rule in (None, {"type": "x"}, {"type": "custom_segment_order", "segment_order": ["a"]}):
        with pytest.raises(DecisionRequired):
            ranking.prioritise(df, rule)


def test_duplicate_policy(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, 1.0), (None, 3, 1.0), (None, 4, 2.0), ("b", 5, None)], "m string, row_order int, s double")
    with pytest.raises(ValueError):
        duplicates.apply_policy(df, "m", "row_order", ["s"])
    kept = duplicates.apply_policy(df, "m", "row_order", ["s"], "first_occurrence")
    assert sorted(r["row_order"] for r in kept.collect()) == [1, 3, 4, 5]
    other = df.unionByName(frame(spark, [("b", 6, 0.0)], "m string, row_order int, s double"))
    with pytest.raises(ValueError):
        duplicates.apply_policy(other, "m", "row_order", ["s"], "first_occurrence")


def test_representative_takes_the_least_on_a_tie(spark):
    df = frame(spark, [("x",), ("b",), ("b",), ("a",), ("a",), (" ",), (" ",), (" ",)], "v string")
    assert df.agg(duplicates.representative("v")).first()[0] == "a"


def test_features(spark):
    df = frame(spark, [(0.0, 0.0, 0.0, 3.0, 0.0, 0.0, " x "), (1.0, 2.0, 3.0, 4.0, 5.0, None, None)], ", ".join(f"scan_m{k} double" for k in range(1, 7)) + ", state string")
    a, b = features.add_features(df).collect()
    assert a["recent_consecutive_zero_count"] == 2 and a["state"] == "X" and a["pct_change_last_3_vs_prev_3"] is None
    assert b["month_6"] == 0 and b["state"] == "UNKNOWN" and b["median_6m"] == 2.5 and b["recent_consecutive_zero_count"] == 1
    assert len(features.NUMERIC) == 41
    with pytest.raises(ValueError):
        features.check_blocked(["mobile_id"])


def test_rank_within_numbers_range_pieces(spark):
    from tidemark.operators import ranking

    rows = [(k, k * 7 % 50 / 10 if k % 9 else None, ("recently_scanning", "recently_inactive", None)[k % 3 if k % 2 else 0]) for k in range(200)]
    ranked = ranking.rank_within(spark.createDataFrame(rows, "row_order int, score double, recent_status string"), "score", "row_order")
    got = {r["row_order"]: r["rank_within_recent_status"] for r in ranked.collect()}
    want = {}
    for status in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == status and r[1] is not None), key=lambda r: (-r[1], r[0]))
        want |= {r[0]: n for n, r in enumerate(own, 1)}
    assert got == {r[0]: want.get(r[0]) for r in rows}


@pytest.mark.parametrize(("partitions", "adaptive"), [(4, "true"), (8, "false"), (200, "true")])
def test_ranks_of_many_rows_are_a_permutation(spark, partitions, adaptive):
    n = 2_000_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        # a third of all rows has one score
        score = F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003)
        rows = spark.range(n, numPartitions=7).select(F.col("id").alias("row_order"), score.alias("risk_score"), F.when(F.col("id") % 5 > 1, "recently_scanning").otherwise("recently_inactive").alias("recent_status"), (F.col("id") % 4 == 0).cast("int").alias("target"))
        ranked = ranking.prioritise(rows, {"type": "recently_scanning_first"})
        w = ranked.agg(F.count("*"), F.count_distinct("operational_rank"), F.min("operational_rank"), F.max("operational_rank"), F.sum("rank_within_recent_status")).first()
        a = n * 3 // 5
        assert tuple(w) == (n, n, 1, n, a * (a + 1) // 2 + (n - a) * (n - a + 1) // 2)
        lift = {r["bucket"]: r for r in evaluation.lift_table(rows, "risk_score", "row_order").collect()}
        assert sum(r["rows"] for r in lift.values()) == n and max(abs(r["rows"] - n // 10) for r in lift.values()) <= 1
        assert lift[10]["cumulative_positives"] == n // 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranks_follow_the_order(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_order"), (F.xxhash64("id") % 50 / 50).alias("s"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("k"))
    from pyspark.sql import Window as W

    want = rows.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("s"), "row_order")))
    got = ranking.global_row_number(rows, [F.desc("s"), F.col("row_order").asc()], "r", ["k"]).withColumn("r", F.col("r").cast("int"))
    assert got.count() == 20_000 and got.exceptAll(want).isEmpty()
    sums = ranking.running_sums(rows.withColumn("one", F.lit(1)), [F.desc("s"), F.col("row_order").asc()], ["one"], ["k"])
    assert sums.select("row_order", "s", "k", F.col("one_until").cast("int")).exceptAll(want).isEmpty()
    assert sums.filter("k is null").first()["one_total"] == 10_000
