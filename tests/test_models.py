import pytest

from tidemark.operators import models
from tidemark.queries import QUERIES, labelled


def test_train_save_load_calibrate(spark, tmp_path):
    rows = labelled(spark, "/root/testdata/sf0.001").limit(400).cache()
    model = models.train(rows, "boosted", trees=3)
    models.save(model, f"{tmp_path}/model")
    a = models.predict(models.load(f"{tmp_path}/model"), rows).cache()
    assert a.filter("risk_score between 0 and 1").count() == rows.count()
    assert models.calibrate(a).transform(a).filter("calibrated between 0 and 1").count() == rows.count()


@pytest.mark.parametrize(("query", "get", "trees"), [("train_score_gbt", "getMaxIter", 500), ("train_score_hgb", "getMaxIter", 400), ("train_score_rf", "getNumTrees", 400)])
def test_queries_train_all_trees(spark, monkeypatch, query, get, trees):
    trained = []

    def train(df, name="boosted", trees=None):
        trained.append(getattr(models.families(trees)[name], get)())
        return whole(df.limit(200), name, trees=1)

    whole = models.train
    monkeypatch.setattr(models, "train", train)
    assert QUERIES[query](spark, "/root/testdata/sf0.001").columns == ["entity", "start", "target", "risk_score"]
    assert trained == [trees]


def test_training_rows_are_worked_out_once(spark, monkeypatch):
    seen, train = [], models.train
    monkeypatch.setattr(models, "train", lambda df, name: (seen.append(df), train(df, name, trees=1))[1])
    scored = QUERIES["train_score_gbt"](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for df in (seen[0], scored) for f in df.inputFiles())


def test_forest_has_tasks_for_all_cores(spark, monkeypatch):
    seen = []
    fit = models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: (seen.append(df), fit(self, df))[1])
    rows = labelled(spark, "/root/testdata/sf0.001").limit(200)
    models.train(rows, "random_forest", trees=2)
    assert seen[0].rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert sorted(map(str, seen[0].drop("weight").collect())) == sorted(map(str, models.dealt(rows).collect()))
    monkeypatch.setattr(models, "FOREST_ROWS", 10)
    assert models.dealt(rows).rdd.getNumPartitions() == -(-rows.count() // 10)
