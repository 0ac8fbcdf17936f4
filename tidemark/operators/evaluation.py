"""Measures of a binary score, exact under ties and without a sort of all rows in one task.

Rows are first grouped by score; running sums over the different scores, and ranks over all rows, are taken piece by
piece of their range, with what the pieces before hold added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.ranking import STATUSES, global_row_number, running_sums


def _segments(df: DataFrame, segment: str | None) -> DataFrame:
    every = df.withColumn("segment", F.lit("overall"))
    if not segment:
        return every
    return every.unionByName(df.filter(F.col(segment).isin(*STATUSES)).withColumn("segment", F.col(segment)))


def curve(df: DataFrame, score: str, label: str = "target", segment: str | None = None) -> DataFrame:
    """segment, threshold, tp, fp, positives, negatives: a row for each different score."""
    by = _segments(df, segment).groupBy("segment", F.col(score).alias("threshold")).agg(F.sum(label).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    sums = running_sums(by.withColumn("q", F.col("n") - F.col("p")), [F.desc("threshold")], ["p", "q"], ["segment"])
    return sums.select(
        "segment", "threshold", F.col("p_until").alias("tp"), F.col("q_until").alias("fp"),
        F.col("p_total").alias("positives"), F.col("q_total").alias("negatives"), "p", "n")


def precision_recall(df: DataFrame, score: str, label: str = "target") -> DataFrame:
    c = curve(df, score, label)
    return c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def metrics(df: DataFrame, score: str, label: str = "target", segment: str | None = None) -> DataFrame:
    """Step-wise average precision and ROC AUC (null for one class) of each segment."""
    c = curve(df, score, label, segment)
    tp, fp, p, q = F.col("tp"), F.col("fp"), F.col("p"), F.col("n") - F.col("p")
    return c.groupBy("segment").agg(
        F.sum("n").alias("row_count"), F.sum("p").alias("positive_count"), (F.sum("p") / F.sum("n")).alias("positive_rate"),
        F.try_divide(F.sum(p * tp / (tp + fp)), F.max("positives")).alias("pr_auc"),
        F.try_divide(F.sum(q * (tp - p / 2)), F.max("positives") * F.max("negatives")).alias("roc_auc"),
    )


def top_k(df: DataFrame, score: str, tie: str, ks: tuple[int, ...] = (100, 500, 1000), label: str = "target", segment: str | None = None) -> DataFrame:
    """Precision, recall and lift of the k best rows of each segment, for each k that it has rows for."""
    own = _segments(df, segment).select("segment", score, tie, label)
    totals = own.groupBy("segment").agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("positives"))
    n = F.row_number().over(W.partitionBy("segment").orderBy(F.desc(score), tie))
    best = own.withColumn("n", n).filter(F.col("n") <= max(ks)).withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("n"))))
    hit = best.groupBy("segment", "k").agg(F.sum(label).cast("long").alias("hits"))
    return hit.join(F.broadcast(totals), "segment").filter("k <= total").select(
        "segment", F.col("k").cast("long").alias("k"), (F.col("hits") / F.col("k")).alias("precision_at_k"), F.try_divide("hits", "positives").alias("recall_at_k"),
        F.try_divide(F.col("hits") / F.col("k"), F.col("positives") / F.col("total")).alias("lift_at_k"))


def lift_table(df: DataFrame, score: str, tie: str, bins: int = 10, label: str = "target") -> DataFrame:
    """Buckets of equal numbers of rows by rank, with cumulative gain and lift. The bucket of rank r of n is
    ceil((r - 1) bins / (n - 1)), at least 1."""
    ranked = global_row_number(df.select(score, tie, label), [F.desc(score), F.col(tie).asc()], "r")
    total, positives = ranked.agg(F.count(F.lit(1)), F.sum(label)).first()  # reads the written pieces, not df
    if not total:
        total, positives = 0, 0
    bucket = F.greatest(F.lit(1), F.ceil((F.col("r") - 1) * F.lit(bins) / F.lit(max(1, total - 1))))
    by = ranked.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"))
    w = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return by.withColumns({"cumulative_rows": F.sum("rows").over(w), "cumulative_positives": F.sum("positives").over(w)}).withColumns({
        "gain": F.try_divide(F.col("cumulative_positives"), F.lit(positives)), "lift": F.try_divide(F.col("positives") / F.col("rows"), F.lit(positives / total if total else 0.0))})


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows of each class, its balanced weight, and the ratio of negatives to positives, at least 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(0))
    total, pos, neg = F.sum("n").over(w), F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).over(w), F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).over(w)
    return counts.select(label, "n", (total / (2 * F.col("n"))).alias("weight"), F.when(pos == 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.try_divide(neg, pos))).alias("ratio"))
