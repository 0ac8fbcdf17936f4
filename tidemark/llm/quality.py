"""Quality classifier by Bradley-Terry pairwise ranking.

A text's score is w.x over features of its characters, words and lines. Pairs of a good and a bad labelled text teach
w: the chance that the good one wins is the logistic function of w.(x_good - x_bad), so the loss is logistic regression
without an intercept on feature differences. The threshold is the score quantile that cuts off as many labelled texts as
are labelled bad; scores map to 0..1 so that the threshold falls on 0.7.

Training uses all labelled rows, and `rounds` pairs for each of the rarer label; features, pairs and sums are tables and
jobs of Spark, so that no task or driver holds the labels. With no pair to learn from, w is zero and everything passes with score 0.7. A null text is empty and scored so; a
null doc_id is not held out and not learned from. Repeated rows are scored alike; an empty table gives an empty result;
`keep_good` keeps all other columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import quantiles

from .common import cut, few, fresh, id_crc, in_slices, release, table

ROUNDS = 8
PASS = 0.7
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[[9, 11, 12, 13, 32]], _KIND[10] = 1, 2, 3, 4, 5, 6
_MARKS = np.flatnonzero([b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])
_WORD = re.compile(r"[^\W\d_]+")
N_FEATURES = 6 + len(_MARKS) + 14


def features(text: str | None) -> np.ndarray:
    """Shares and rates, each bounded, of a whole text."""
    text = text or ""
    b = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    size = max(1, len(b))
    kinds = np.bincount(_KIND, weights=seen, minlength=7)[1:] / size
    words = text.split()
    n = max(1, len(words))
    different = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen_lines = Counter(lines)
    same_next = sum(map(str.__eq__, words, words[1:])) / n
    upper = sum(map(str.isupper, words)) / n
    ends = sum(x[-1] in ".!?:;,\"'" for x in words) / n
    odd_end = sum(not x[-1].isalnum() and x[-1] not in ".!?:;,\"'" for x in words) / n
    alone = sum(not any(map(str.isalnum, x)) for x in words) / n
    letters = sum(map(len, _WORD.findall(text))) / max(1, len(text))
    common = different.most_common(2)
    return np.concatenate([
        np.sqrt(kinds), np.sqrt(seen[_MARKS] / size),
        [
            math.log1p(len(words)) / 10, math.exp(-len(words) / 20), len(different) / n,
            len(different) / math.sqrt(n) / 30, (common[0][1] if common else 0) / n, (common[1][1] if len(common) > 1 else 0) / n,
            same_next, upper, ends, odd_end, alone, letters,
            1 - len(seen_lines) / max(1, len(lines)), min(1.0, size / n / 30),
        ],
    ])


@dataclass
class Model:
    weights: np.ndarray
    threshold: float
    slope: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES) @ self.weights
        z = np.clip(self.slope * (x - self.threshold) + math.log(PASS / (1 - PASS)), -700, 700)
        return 1 / (1 + np.exp(-z))


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model from rows of text and label (1 good, 0 bad)."""
    from pyspark.ml.classification import LogisticRegression  # with pandas, whose memory workers do without
    from pyspark.ml.functions import array_to_vector

    rows = labelled.select("text", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([np.zeros(0), *(features(t) for part in in_slices(b.column("text")) for t in part)])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(np.arange(0, len(x) + 1, N_FEATURES, dtype=np.int32), x)], names=["label", "x"])
        release()

    known = cut(rows.mapInArrow(featured, "label int, x array<double>"), "features")
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(N_FEATURES), 0.0, 1.0)
    if len(n) < 2:
        return none
    # pairs: both sides are dealt to as many slots as the rarer label has rows, anew in each round
    slots = max(1, min(n.values()))
    dealt = known.select("label", "x", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn(
        "slot", F.pmod(F.xxhash64("x", "label", "round"), F.lit(slots)))
    side = lambda k, name: dealt.filter(F.col("label") == k).groupBy("round", "slot").agg(F.first("x").alias(name))
    differences = cut(side(1, "good").join(side(0, "bad"), ["round", "slot"]).select(F.zip_with("good", "bad", lambda a, b: a - b).alias("d")), "differences")
    both = differences.select("d", F.lit(1.0).alias("label")).unionByName(
        differences.select(F.transform("d", lambda v: -v).alias("d"), F.lit(0.0).alias("label"))).select(array_to_vector("d").alias("features"), "label")
    if differences.isEmpty():
        return none
    learned = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=100).fit(both)
    w = learned.coefficients.toArray()
    s = known.select("label", F.aggregate(F.zip_with("x", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("s"))
    spread = s.agg(F.stddev_pop("s")).first()[0]
    threshold = quantiles(s.select(F.lit(0).alias("all"), "s"), "s", {"at": n[0] / (n[0] + n[1])}, ["all"]).first()["at"]
    return Model(w, float(threshold), 2.0 / max(float(spread), 1e-9))


def scored(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """docs with a column `name`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *map(held.value.score, in_slices(texts))]))
        release()

    return docs.withColumn(name, score(F.col("text")))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(4)) == 2, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """From all labels whose document isn't held out; up to BROADCAST_IDS of them are broadcast, and docs isn't shuffled."""
    own = labels.filter(F.pmod(id_crc("doc_id"), F.lit(4)) != 2).select("doc_id", F.col("quality").alias("label")).filter("label in (0, 1)")
    return fit(docs.select("doc_id", "text").join(few(own), "doc_id"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns."""
    name = fresh(docs, "__score")
    return scored(docs, fit_documents(docs, labels), name).filter(F.col(name) >= PASS).drop(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= PASS).cast("int").alias("predicted"))
