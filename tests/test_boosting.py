"""Boosted trees against a plain version that looks at one split after another."""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import boosting
from tidemark.operators.boosting import NewtonBoosting, NewtonBoostingModel

SCHEMA = StructType().add("features", VectorUDT()).add("target", "integer").add("weight", "double")


def plain(x, y, w, rounds, step, l2, least_curvature, least_rows, depth, leaves):
    """Margins of all rows after each round."""
    mean = (w * y).sum() / w.sum()
    margin = np.full(len(y), np.log(mean / (1 - mean)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: E731, B023
        tree = [(np.arange(len(y)), 0)]
        while not leaves or len(tree) < leaves:
            best = (boosting.LEAST_GAIN, None)
            for at, (rows, level) in enumerate(tree):
                if depth and level >= depth:
                    continue
                for f in range(x.shape[1]):
                    for t in np.unique(x[rows, f])[:-1]:
                        a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                        if min(h[a].sum(), h[b].sum()) < least_curvature or min(len(a), len(b)) < least_rows:
                            continue
                        gain = (score(a) + score(b) - score(rows)) / 2
                        if gain > best[0]:
                            best = (gain, (at, a, b, level + 1))
            if best[1] is None:
                break
            at, a, b, level = best[1]
            tree[at : at + 1] = [(a, level), (b, level)]
        for rows, _ in tree:
            margin[rows] -= step * g[rows].sum() / (h[rows].sum() + l2)
    return margin


def frame(spark, x, y, w, parts=3):
    rows = [(Vectors.dense(a), int(b), float(c)) for a, b, c in zip(x, y, w, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def made(n=120, seed=1):
    r = np.random.RandomState(seed)
    x = np.round(r.randn(n, 4), 2)
    x[:, 3] = 5.0
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.randn(n) * 0.5) > 0.3).astype(int)
    return x, y, np.where(y == 1, 1.5, 1.0)


def chances(model, df):
    got = model.transform(df).select(vector_to_array("features").alias("x"), F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()
    return {tuple(r.x): r.p for r in got}


@pytest.mark.parametrize(
    ("depth", "leaves", "l2", "least_curvature", "least_rows"),
    [(3, 0, 1.0, 1.0, 1), (0, 6, 0.01, 1e-3, 8), (2, 3, 0.5, 1e-3, 1)],
)
def test_equals_plain_version(spark, depth, leaves, l2, least_curvature, least_rows):
    x, y, w = made()
    df = frame(spark, x, y, w)
    model = NewtonBoosting(labelCol="target", weightCol="weight", maxIter=12, stepSize=0.3, depth=depth, leaves=leaves, l2=l2, leastCurvature=least_curvature, leastRows=least_rows, bins=256).fit(df)
    want = 1 / (1 + np.exp(-plain(x, y, w, 12, 0.3, l2, least_curvature, least_rows, depth, leaves)))
    got = chances(model, df)
    assert max(abs(got[tuple(a)] - b) for a, b in zip(x, want, strict=True)) < 1e-6


def test_partitions_do_not_matter_and_saved_model_scores_alike(spark, tmp_path, monkeypatch):
    x, y, w = made(300, 2)
    x = np.round(x)  # so few values that quantiles are the same however rows are dealt
    fit = NewtonBoosting(labelCol="target", weightCol="weight", maxIter=3, depth=3, l2=1.0, featurePart=0.7)
    a = fit.fit(frame(spark, x, y, w, 1))
    monkeypatch.setattr(boosting, "FILE_BYTES", 100)  # several files, whose sums Spark adds
    b = fit.fit(frame(spark, x, y, w, 7))
    assert a.getOrDefault("made") == b.getOrDefault("made")
    a.write().overwrite().save(f"{tmp_path}/m")
    df = frame(spark, x, y, w)
    assert chances(NewtonBoostingModel.load(f"{tmp_path}/m"), df) == chances(a, df)


@pytest.mark.parametrize("noise", [False, True])
def test_one_task_grows_the_trees_of_many_passes(spark, monkeypatch, noise):
    """With draws of rows and features, over several blocks and written margins; and with an early stop in a block."""
    monkeypatch.setattr(boosting, "STOP_ROWS", 100)
    monkeypatch.setattr(boosting, "ALONE", 4)
    monkeypatch.setattr(boosting, "FOLD", 3)
    x, y, w = made(400, 4)
    if noise:
        y = np.random.RandomState(5).randint(0, 2, len(y))
    fit = NewtonBoosting(labelCol="target", weightCol="weight", maxIter=9, stepSize=0.5, leaves=6, l2=0.1, rowPart=0.8, featurePart=0.7, patience=2 if noise else 9)
    alone = fit.fit(frame(spark, x, y, w, 1))
    monkeypatch.setattr(boosting, "FILE_BYTES", 100)
    passes = fit.fit(frame(spark, x, y, w, 1))
    assert alone.getOrDefault("made") == passes.getOrDefault("made")
    assert len(alone.trees()) < 9 if noise else len(alone.trees()) == 9


def test_blocks_are_stored_not_written_for_each_pass(spark, monkeypatch):
    """Beyond one task's rows: stored anew every FOLD trees, written every CUT, and the trees are those of one task."""
    monkeypatch.setattr(boosting, "FOLD", 2)
    monkeypatch.setattr(boosting, "CUT", 4)
    monkeypatch.setattr(boosting, "BLOCK", 60)
    monkeypatch.setattr(boosting, "PIECE", 25)
    x, y, w = made(400, 8)
    fit = NewtonBoosting(labelCol="target", weightCol="weight", maxIter=10, stepSize=0.5, depth=3, l2=0.1, rowPart=0.8)
    alone = fit.fit(frame(spark, x, y, w, 1))
    monkeypatch.setattr(boosting, "FILE_BYTES", 100)
    paths, stored, new_path, persist = [], [], boosting.new_path, RDD.persist
    monkeypatch.setattr(boosting, "new_path", lambda *of: paths.append(new_path(*of)) or paths[-1])
    monkeypatch.setattr(RDD, "persist", lambda self, *of: stored.append(self) or persist(self, *of))
    assert fit.fit(frame(spark, x, y, w, 1)).getOrDefault("made") == alone.getOrDefault("made")
    assert len(paths) == 2 + 10 // 4  # features, pieces, and one for each CUT trees
    assert len(stored) == 1 + 10 // 2
    assert not any(r.is_cached for r in stored)


def test_quantiles_of_many_tasks(spark, monkeypatch):
    """Exact where no summary is thinned; else to within a few parts of RANKS."""
    r = np.random.RandomState(9)
    x = np.column_stack([r.randn(3000), r.randint(0, 5, 3000), np.where(r.rand(3000) < 0.7, 0.0, r.randn(3000))])
    df = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>").repartition(5)
    fit = NewtonBoosting(bins=16)
    rank = np.ceil(np.arange(1, 16) / 16 * 3000).astype(int) - 1
    want = [sorted(set(np.sort(c)[rank].tolist()) - {c.max()}) for c in x.T]
    assert fit._thresholds(df, 3) == want
    monkeypatch.setattr(boosting, "RANKS", 300)
    monkeypatch.setattr(boosting, "HELD", 200)
    got = fit._thresholds(df, 3)
    assert got[1] == want[1]
    for k in (0, 2):
        for v, u in zip(got[k], want[k], strict=True):
            assert abs((x[:, k] <= v).mean() - (x[:, k] <= u).mean()) < 0.02
    heavy = boosting.thinned([(np.arange(1000.0), np.where(np.arange(1000) == 500, 10_000, 1))])
    assert 500.0 in heavy[0] and 999.0 in heavy[0] and heavy[1].sum() == 10_999 and len(heavy[0]) <= 600


def test_leaf_limit_and_depth_hold(spark):
    x, y, w = made(300, 3)
    for t in NewtonBoosting(labelCol="target", maxIter=2, leaves=5).fit(frame(spark, x, y, w)).trees():
        assert sum(f < 0 for f in t.feature) <= 5
        assert 3 not in t.feature  # a feature of one value
    for t in NewtonBoosting(labelCol="target", maxIter=2, depth=1).fit(frame(spark, x, y, w)).trees():
        assert len(t.feature) <= 3


def test_stops_without_gain_on_rows_held_out(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STOP_ROWS", 100)
    x, y, w = made(400, 4)
    y = np.random.RandomState(5).randint(0, 2, len(y))  # nothing to learn
    model = NewtonBoosting(labelCol="target", maxIter=60, stepSize=0.5, leaves=8, patience=3).fit(frame(spark, x, y, w))
    assert len(model.trees()) < 30


def test_awkward_tables(spark):
    x, y, w = made(40, 6)
    with pytest.raises(ValueError, match="no rows"):
        NewtonBoosting(labelCol="target").fit(frame(spark, x, y, w).limit(0))
    with pytest.raises(ValueError, match="missing"):
        NewtonBoosting(labelCol="target").fit(frame(spark, np.where(x > 1, np.nan, x), y, w))
    one = NewtonBoosting(labelCol="target", maxIter=2).fit(frame(spark, x, np.ones(40), w))
    assert min(chances(one, frame(spark, x, y, w)).values()) > 0.999
    assert one.transform(frame(spark, x, y, w).limit(0)).count() == 0
    same = NewtonBoosting(labelCol="target", maxIter=2).fit(frame(spark, np.ones((40, 2)), y, w))
    assert all(t.feature == [-1] for t in same.trees())


def test_equal_constant_and_two_valued_features_are_summed_once(spark, monkeypatch):
    """Sums of what is left give the plain version's trees, in one task and by passes; 311,000 rows of 67 features are one
    task's."""
    from tidemark.operators.boosting import Columns

    laid = Columns([256, 1, 2, 256, 2, 7], [0, 1, 2, 0, 4, 5]).layout(np.array([1, 2, 3, 5]))
    assert (laid.many, laid.two, laid.cells) == ([3, 5], [2], 2 * 256 + 2)
    assert 311_000 * (67 + boosting.ROW_BYTES) <= boosting.FILE_BYTES
    x, y, w = made(200, 7)
    x = np.column_stack([x, x[:, 0] * 2, x[:, 1] > 0, x[:, 1] <= 0, x[:, 2] > 1])
    df = frame(spark, x, y, w)
    fit = NewtonBoosting(labelCol="target", weightCol="weight", maxIter=12, stepSize=0.3, depth=3, l2=1.0, leastCurvature=1.0, bins=256)
    want = 1 / (1 + np.exp(-plain(x, y, w, 12, 0.3, 1.0, 1.0, 1, 3, 0)))
    alone = fit.fit(df)
    monkeypatch.setattr(boosting, "FILE_BYTES", 100)
    assert fit.fit(df).getOrDefault("made") == alone.getOrDefault("made")
    got = chances(alone, df)
    assert max(abs(got[tuple(a)] - b) for a, b in zip(x, want, strict=True)) < 1e-6


def test_draws_are_those_of_spark(spark):
    ids = spark.range(1000).select("id", F.xxhash64("id", F.lit(42)).alias("mix"), F.expr("pmod(xxhash64(id, 42, 7), 1048576) < int(0.9 * 1048576)").alias("want")).toPandas()
    growth = boosting.Growth(1, 0.0, 0.0, 1, 0, 0, 0.1, 0.9, 1.0, 42)
    assert (growth.drawn(7, ids["mix"].to_numpy().view(np.uint64)) == ids["want"].to_numpy()).all()
