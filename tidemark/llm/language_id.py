"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes of the lower-cased text, everything but letters taken as
one space), square-root counts times inverse document frequency, at length one. Each language has several centroids,
clustered by cosine from its training texts. The language of the nearest centroid by cosine is the answer; a text
farther from it than nearly all training texts of its length is rejected.

Training: about `per_language` different labelled texts of each language at most, by a hash of the text, so the model's size and the
clustering task are bounded: bytes are LANGUAGES x centroids x DIMENSIONS x 4. Texts are read whole in both uses.

A null text, or one without a letter, is `und`, with score 0, and rejected. A null doc_id is not held out and not
learned from. Without any labelled row everything is `und`. Repeated rows are answered alike; other columns are kept by
`filter_known` and not read by `predict`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_crc, in_slices, release, table

if TYPE_CHECKING:  # workers do without it, and the memory that it takes
    import pandas as pd

DIMENSIONS = 8192
PER_LANGUAGE = 1000
CENTROIDS = 4
#: A text is rejected if its cosine is under this part of what the lowest LOW of training texts as long have.
SLACK, LOW = 0.5, 0.005
UNKNOWN = "und"
#: Bounds of length classes, in n-grams.
CLASSES = np.array([8, 16, 32, 64, 128, 256, 1024])
PREDICTION = "lang_pred string, score double, rejected boolean"

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed two- and three-byte grams of a text, in reading order."""
    b = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    return (np.concatenate([two + np.uint32(1 << 24), three]) * np.uint32(2654435761)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    out = np.empty((len(texts), DIMENSIONS), np.float32)
    for k, text in enumerate(texts):
        out[k] = np.bincount(grams(text), minlength=DIMENSIONS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _to_unit(x: np.ndarray) -> np.ndarray:
    """x, its rows brought to length one where they are."""
    for begin in range(0, len(x), 64):
        part = x[begin : begin + 64]
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-12)
    return x


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # a row each, of length one, idf included
    languages: list[str]  # of each centroid
    least: np.ndarray  # by class of length: the smallest cosine that is accepted

    def nearest(self, texts: list[str | None], at_once: int = 64) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The columns of PREDICTION."""
        known = [has_letter(x) and len(self.languages) > 0 for x in texts]
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        where = np.flatnonzero(known)
        for begin in range(0, len(where), at_once):
            rows = where[begin : begin + at_once]
            x = counts([texts[k] for k in rows])
            n = x.sum(1)
            np.sqrt(x, out=x)
            x *= self.idf
            near = x @ self.centroids.T / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
            best = near.argmax(1)
            score[rows] = np.clip(near[np.arange(len(rows)), best], 0, 1)
            rejected[rows] = score[rows] < self.least[np.searchsorted(CLASSES, n)]
            for k, b in zip(rows, best, strict=True):
                lang[k] = self.languages[b]
        return lang, score, rejected

    def predict(self, texts: list[str | None], at_once: int = 64) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame(dict(zip(("lang_pred", "score", "rejected"), self.nearest(texts, at_once), strict=True)))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids, at length one, of k clusters of the rows of x by cosine; seeded by the farthest rows in turn."""
    centroids = _unit(x.mean(0, keepdims=True))
    while len(centroids) < min(k, len(x)):
        far = (x @ centroids.T).max(1).argmin()
        centroids = np.vstack([centroids, x[far : far + 1]])
    for _ in range(10):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centroids)) > 0
        centroids = _unit(sums[filled])
    return centroids


def clustered(texts: list[str], centroids: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """In how many texts each gram is, and the means of their clusters. Of the texts' counts there are two copies at most."""
    tf = counts(texts)
    seen = (tf > 0).sum(0).astype(np.float32)
    idf = np.log((1 + len(texts)) / (1 + seen)) + 1
    np.sqrt(tf, out=tf)
    x = _to_unit(tf * idf)  # the language's own idf only serves to cluster
    own = (x @ _cluster(x, centroids).T).argmax(1)
    del x
    _to_unit(tf)
    return seen, [tf[own == k].mean(0) for k in range(own.max() + 1) if (own == k).any()]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """A model from labelled rows; those without a language or a letter teach nothing."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    here = F.broadcast(rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("count")))  # a row for each language, of which the model has centroids anyway
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    order = (F.xxhash64("text", F.lit(1)).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    # of equal texts one teaches, so that copies neither crowd out others nor make the sample large
    sample = rows.join(here, "lang").filter(order < share).select("lang", "text").dropDuplicates(["lang", "text"])

    def cluster(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        texts, out = sorted(x for x in group["text"].to_pylist() if has_letter(x)), []
        if texts:
            seen, means = clustered(texts, centroids)
            out = [("n", np.array([len(texts)], np.float32)), ("df", seen), *(("c", m) for m in means)]
            release()
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()), "kind": pa.array([k for k, _ in out], pa.string()), "v": pa.array([v for _, v in out], pa.list_(pa.float32()))})

    made = sample.groupBy("lang").applyInArrow(cluster, "lang string, kind string, v array<float>").toPandas()
    if not (made["kind"] == "c").any():
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(len(CLASSES) + 1))
    total = sum(v[0] for v in made.loc[made["kind"] == "n", "v"])
    seen = np.sum(made.loc[made["kind"] == "df", "v"].tolist(), axis=0)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    c = made[made["kind"] == "c"].sort_values("lang", kind="stable")
    model = Model(idf, _unit(np.array(c["v"].tolist(), np.float32) * idf), c["lang"].tolist(), np.zeros(len(CLASSES) + 1))
    model.least = _least(sample, model)
    return model


def _least(sample: DataFrame, model: Model) -> np.ndarray:
    held = sample.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in in_slices(b.column("text")):
                texts = [x for x in part if has_letter(x)]
                c = [int(np.searchsorted(CLASSES, len(grams(x)))) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(held.value.nearest(texts)[1], pa.float64())], names=["c", "s"])
        release()

    low = sample.mapInArrow(near, "c int, s double").groupBy("c").agg(F.percentile("s", F.lit(LOW)).alias("s")).collect()
    held.destroy()
    if not low:
        return np.zeros(len(CLASSES) + 1)
    known = sorted((r["c"], SLACK * r["s"]) for r in low)
    # a class without texts takes the next shorter one's
    out = np.array([max((k for k in known if k[0] <= c), default=known[0])[1] for c in range(len(CLASSES) + 1)])
    return np.minimum.accumulate(out[::-1])[::-1]  # a shorter text is never held to more than a longer one


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "__lang") -> DataFrame:
    """docs with a struct column `name` of PREDICTION."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType.fromDDL(PREDICTION))
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score, rejected = zip(*map(held.value.nearest, in_slices(texts) if len(texts) else [[]]), strict=True)
            yield pa.StructArray.from_arrays([pa.array([x for part in lang for x in part], pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))], names=["lang_pred", "score", "rejected"])
        release()

    return docs.withColumn(name, answer(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(3)) == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.filter(F.pmod(id_crc("doc_id"), F.lit(3)) != 1))


def filter_known(docs: DataFrame) -> DataFrame:
    """The rows whose language is known, with their columns; learned from those not held out."""
    name = fresh(docs, "__lang")
    return predict(docs, fit_documents(docs), name=name).filter(~F.col(name).rejected).drop(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit_documents(docs)).select(
        "doc_id", held_out().alias("held_out"), "__lang.lang_pred", "__lang.score", "__lang.rejected")
