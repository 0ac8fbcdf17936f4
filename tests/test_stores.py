"""Windows month by month, rows by entity without a shuffle, exact quantiles, conflict samples, refused ranks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import duplicates, features, models, ranking, stores, windows
from tidemark.plans import rules
from tidemark.queries import QUERIES, entity_layout

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def test_windows_month_by_month_equal_windows_at_once(spark, tmp_path):
    rng = random.Random(5)
    start = 2022 * 12 + 1
    rows = [(e, start + k, float(rng.randrange(5)), rng.choice(["A", "B", " ", None])) for e in range(12) for k in range(16) if rng.random() < 0.95]
    panel = spark.createDataFrame(rows, "entity int, ord int, scan_points double, state string")
    whole = rows_of(windows.build(panel, "entity", carry=("state",)))
    store = stores.WindowStore(spark, f"{tmp_path}/store", "entity", carry=("state",))
    assert store.append(panel.limit(0)) == []
    for k in range(16):
        ends = store.append(panel.filter(F.col("ord") == start + k))
        assert ends == [start + k]  # a new month builds the windows that end in it, no others
    assert len(whole) > 20 and rows_of(store.windows()) == whole
    ends = store.append(panel.filter(F.col("ord") == start + 9))  # the same month again
    assert ends == list(range(start + 9, start + 16)) and rows_of(store.windows()) == whole
    # a month that comes again with one entity only: the others' windows over it go
    few = panel.filter((F.col("ord") != start + 9) | (F.col("entity") == 1))
    store.append(few.filter(F.col("ord") == start + 9))
    assert rows_of(store.windows()) == rows_of(windows.build(few, "entity", carry=("state",))) != whole


def test_an_entity_layout_needs_no_exchange(spark, tmp_path):
    layout = entity_layout(spark, DATA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = layout.read()
        summed = windows.monthly(rows, "entity", "ord", "scan_points")
        both = windows.build(summed, "entity").join(rows.groupBy("entity").agg(F.max("ord").alias("last")), "entity")
        both.collect()
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # a year is replaced, the others stay; another session's object finds the buckets
    year = rows.agg(F.max("source_year")).first()[0]
    n = rows.filter(F.col("source_year") != year).count()
    layout.write(spark.createDataFrame([(1, year * 12 + 1, 1.0, year)], "entity bigint, ord int, scan_points double, source_year int"))
    again = stores.EntityLayout(spark, layout.path, "entity", "ord INT, scan_points DOUBLE")
    assert again.read().count() == n + 1 and again.buckets == layout.buckets
    with pytest.raises(FileNotFoundError):
        stores.EntityLayout(spark, f"{tmp_path}/none", "entity", "ord INT").read()


def test_quantiles_are_exact(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(40))) for g in ("a", "b", None) for _ in range(rng.randrange(30, 90))] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in ranking.quantiles(df, "v", {"q1": 0.25, "q2": 0.5, "q0": 0.0, "q4": 1.0}, ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in rows if k == g]
        quarter, half, _ = statistics.quantiles(own, n=4, method="inclusive")
        assert (got[g]["n"], got[g]["q0"], got[g]["q4"]) == (len(own), min(own), max(own))
        assert abs(got[g]["q1"] - quarter) < 1e-9 and abs(got[g]["q2"] - half) < 1e-9
    assert got["one"]["q1"] == got["one"]["q2"] == 7.0 and "none" not in got


def test_conflict_samples(spark):
    rows = [("a", k, float(k % 5), None) for k in range(20)] + [("b", 30, 1.0, 2.0), ("b", 31, 1.0, 2.0), (None, 40, 1.0, 1.0), (None, 41, 2.0, 1.0), ("c", 50, None, 0.0), ("c", 51, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, row int, x double, y double").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in duplicates.conflict_samples(df, "k", ["x", "y"], "row").collect()}
    assert got == {"a": (20, 5, ["0.0,null", "1.0,null", "2.0,null"]), "c": (2, 2, ["null,0.0", "0.0,0.0"])}


@pytest.mark.parametrize("kind", ["recently_scanning_first", "within_recent_status", "score_only"])
def test_a_null_status_is_refused(spark, kind):
    rows = [(1, 0.5, "recently_scanning"), (2, 0.4, None), (3, 0.3, "recently_inactive")]
    with pytest.raises(ValueError, match="recent_status"):
        ranking.prioritise(spark.createDataFrame(rows, "row_order int, risk_score double, recent_status string"), {"type": kind})
    with pytest.raises(ValueError, match="follow"):
        six = [f"m{k}" for k in range(6)]
        df = spark.createDataFrame([(1, 0.5, "recently_scanning", *[0.0] * 6)], "row_order int, risk_score double, recent_status string, " + ", ".join(f"{c} double" for c in six))
        ranking.prioritise(df, {"type": kind}, scans=six)


def test_one_list_of_what_is_undecided(spark):
    with pytest.raises(ValueError):
        ranking.prioritise(spark.range(1), {"type": "TODO"})
    assert rules.undecided({}, ("risk_bands",)) == ["business_rules"]
    held = {"business_rules": {"risk_bands": {"type": "TODO"}, "target_definition": 3}}
    assert rules.undecided(held, ("risk_bands", "target_definition", "potential_definition")) == ["business_rules.risk_bands.type", "business_rules.target_definition", "business_rules.potential_definition"]
    assert rules.undecided({"business_rules": {"risk_bands": {"type": "fixed"}}}, ("risk_bands",)) == []


def test_models_see_states_and_are_saved_with_their_calibration(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"S{k % 5}", *(float(rng.randrange(9)) for _ in range(6)), int(rng.random() < 0.3 + 0.1 * (k % 5))) for k in range(300)]
    df = spark.createDataFrame(rows, "state string, " + ", ".join(f"scan_m{k} double" for k in range(1, 7)) + ", target int")
    model = models.train(df, "logistic_regression", calibration=df)
    assert [s for s in model.stages if hasattr(s, "labels")][0].labels == [f"S{k}" for k in range(5)]
    want = models.predict(model, df).collect()
    models.save(model, f"{tmp_path}/m")
    assert models.predict(models.load(f"{tmp_path}/m"), df).collect() == want
    # isotonic steps: as many positives as are predicted, over all rows
    assert abs(sum(r["risk_score"] for r in want) - sum(r["target"] for r in want)) < 1e-6
    weights = {r["target"]: r["weight"] for r in models.balanced(df, positives_only=True).select("target", "weight").distinct().collect()}
    p = sum(r[-1] for r in rows)
    assert weights == {0: 1.0, 1: max(1.0, (300 - p) / p)}


def test_identity_columns_are_no_features(spark, tmp_path):
    with pytest.raises(ValueError, match="identity"):
        models.pipeline("boosted", numeric=("sum_6m", "mobile_id"))
    features.write_manifest(f"{tmp_path}/x/m.json", ("sum_6m", "state"))
    assert '"sum_6m"' in (tmp_path / "x" / "m.json").read_text()
    with pytest.raises(ValueError):
        features.write_manifest(f"{tmp_path}/m.json", ("Name",))


def test_training_queries_have_more_than_one_state(spark):
    from tidemark.queries import samples_with_state

    assert samples_with_state(spark, DATA).select("state").distinct().count() > 1
    assert "windows_incremental" in QUERIES
