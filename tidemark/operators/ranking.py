"""Operational ranks of scored customers under a configured strategy."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.plans.errors import DecisionRequired
from tidemark.plans.rules import is_undecided
from tidemark.sources.shared import written

STATUSES = ("recently_scanning", "recently_inactive")


def recent_status(m4: Column, m5: Column, m6: Column) -> Column:
    """Of a scoring row: scanning if the last three months sum to more than zero. (Windows use "not equal to zero".)"""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(zero(m4) + zero(m5) + zero(m6) > 0, STATUSES[0]).otherwise(STATUSES[1])


def with_status(df: DataFrame, scans: list[str] | None = None) -> DataFrame:
    """df with recent_status: its own, or what follows from its scans."""
    if "recent_status" in df.columns:
        return df
    if not scans or not set(scans) <= set(df.columns):
        raise ValueError("recent_status or six scan columns are needed")
    return df.withColumn("recent_status", recent_status(*map(F.col, scans[-3:])))


def wrong_status(df: DataFrame, scans: list[str] | None = None) -> list[Column]:
    """Aggregates: rows whose recent_status is null or none of STATUSES, one such value, and rows whose status doesn't
    follow from their scans."""
    status = F.col("recent_status")
    odd = ~F.coalesce(status.isin(*STATUSES), F.lit(False))
    fits = status.eqNullSafe(recent_status(*map(F.col, scans[-3:]))) if scans and set(scans) <= set(df.columns) else F.lit(True)
    return [F.count_if(odd).alias("odd"), F.max(F.when(odd, F.coalesce(status, F.lit("null")))).alias("example"), F.count_if(~fits).alias("unfit")]


def check_status(found: Row) -> None:
    if found["odd"]:
        raise ValueError(f"unexpected recent_status in {found['odd']} rows, such as {found['example']}")
    if found["unfit"]:
        raise ValueError(f"recent_status of {found['unfit']} rows doesn't follow from their months")


def ensure_status(df: DataFrame, scans: list[str] | None = None) -> DataFrame:
    """df with a recent_status that fits the scans; refused if it has another, or values that no status has. A status that
    is made from the scans here needs no check."""
    known = with_status(df, scans)
    if known is df:
        check_status(df.agg(*wrong_status(df, scans)).first())
    return known


def in_pieces(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df, written once, with `__piece`, the range of (by, order) that a row is in, and `__at`, its place: pieces follow
    one another in the order, and so do the rows of a piece. As both are stored with the rows, all that reads them
    agrees on them, however Spark would sample ranges or coalesce partitions another time."""
    keys = [*map(F.col, by or []), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    return written(placed.withColumn("__piece", F.shiftright("__at", 33)), "pieces")


def _begin(rows: DataFrame, begins: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their piece and key; null keys are equal."""
    keyed = begins.withColumnsRenamed({c: f"__key_{c}" for c in ["__piece", *by]})
    on = reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"`__key_{c}`")) for c in by), F.col("__piece") == F.col("__key___piece"))
    return rows.join(keyed, on)


def global_row_number(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """row_number over (partition by `by` order by `order`) for partitions of any size: a row's place in its piece, after
    the rows of the pieces before. No task sees all rows; one task sees a row for each piece and key of `by`."""
    by = by or []
    rows = in_pieces(df, order, by)
    counts = rows.groupBy("__piece", *by).agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*by, F.lit(0)).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("__piece", *by, (before - F.col("__first") + 1).alias("__shift"))
    return _begin(rows, begins, by).select(*(f"`{c}`" for c in df.columns), (F.col("__at") + F.col("__shift")).alias(name))


def running_sums(df: DataFrame, order: list[Column], sums: list[str], by: list[str] | None = None) -> DataFrame:
    """df with, for each column c of sums, `c_until`, its sum up to the row (the order must be without ties), and
    `c_total`, its sum over the key of `by`; summed piece by piece."""
    by = by or []
    rows = in_pieces(df, order, by)
    pieces = rows.groupBy("__piece", *by).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    key, earlier = W.partitionBy(*by, F.lit(0)), W.partitionBy(*by, F.lit(0)).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    begins = pieces.select("__piece", *by, *(x for c in sums for x in (F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__b_{c}"), F.sum(f"__{c}").over(key).alias(f"{c}_total"))))
    here = W.partitionBy("__piece", *by).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    own = rows.select("*", *(F.sum(c).over(here).alias(f"__own_{c}") for c in sums))
    return _begin(own, begins, by).select(
        *(f"`{c}`" for c in df.columns), *((F.col(f"__own_{c}") + F.col(f"__b_{c}")).alias(f"{c}_until") for c in sums), *(f"{c}_total" for c in sums))


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str]) -> DataFrame:
    """Exact quantiles of each group (between two values linearly), beside its number of values, least and greatest one.
    The values are placed by range pieces and only those at the wanted places are picked, so no task holds a group."""
    numbered = global_row_number(df.filter(F.col(value).isNotNull()).select(*by, value), [F.col(value).asc()], "__r", by)
    sizes = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    sized = _keyed(numbered, sizes, by)
    place = lambda q: 1 + (F.col("n") - 1) * F.lit(float(q))
    near = lambda q: F.when(F.abs(F.col("__r") - place(q)) < 1, 1 - F.abs(F.col("__r") - place(q)))
    wanted = sized.filter(reduce(Column.__or__, (near(q).isNotNull() for q in at.values())))
    return wanted.groupBy(*by, "n", "least", "greatest").agg(*(F.sum(near(q) * F.col(value)).alias(name) for name, q in at.items()))


def _keyed(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group; null keys are equal."""
    renamed = groups.withColumnsRenamed({c: f"__key_{c}" for c in by})
    on = reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(f"`__key_{c}`")) for c in by))
    return rows.join(renamed, on).drop(*(f"__key_{c}" for c in by))


def rank_within(df: DataFrame, score: str, tie: str, segment: str = "recent_status", place: str | None = None) -> DataFrame:
    """rank_within_recent_status: by score downwards, ties by `tie`; null for a row without a score, though `place`, if
    named, goes on with those."""
    numbered = global_row_number(df, [F.col(score).desc_nulls_last(), F.col(tie).asc()], "__rank", by=[segment])
    rank = F.when(F.col(score).isNotNull(), F.col("__rank")).cast("long").alias("rank_within_recent_status")
    return numbered.select(*df.columns, rank, *([F.col("__rank").alias(place)] if place else []))


def prioritise(scored: DataFrame, rule: dict[str, Any] | None, score: str = "risk_score", tie: str = "row_order", scans: list[str] | None = None) -> DataFrame:
    """Ranks under within_recent_status, recently_scanning_first, custom_segment_order or score_only. The score stays."""
    kind = (rule or {}).get("type")
    if is_undecided(kind):
        raise DecisionRequired("prioritization_strategy.type must be configured")
    if score not in scored.columns:
        raise ValueError(f"no column {score}")
    order = list(STATUSES)
    if kind == "custom_segment_order":
        order = (rule or {}).get("segment_order")
        if not isinstance(order, list) or sorted(order) != sorted(STATUSES):
            raise DecisionRequired("custom_segment_order needs a segment_order of exactly the two statuses")
    elif kind not in ("within_recent_status", "recently_scanning_first", "score_only"):
        raise DecisionRequired(f"unsupported prioritization strategy: {kind}")
    known = with_status(scored, scans)
    leads = F.col("recent_status") == order[0]
    rows = in_pieces(known.withColumn("__second", F.when(leads, 0).otherwise(1)), [F.col(score).desc_nulls_last(), F.col(tie).asc()], ["__second"])
    # the pieces tell what would else be counted in passes of their own: rows of each status, and statuses that none is
    counts = rows.groupBy("__piece", "__second").agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"), *wrong_status(rows, scans))
    check_status(counts.agg(F.sum("odd").alias("odd"), F.max("example").alias("example"), F.sum("unfit").alias("unfit")).first())
    earlier = lambda *by: F.coalesce(F.sum("__c").over(W.partitionBy(*by, F.lit(0)).orderBy("__second", "__piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("__first") + 1
    begins = counts.select("__piece", "__second", earlier("__second").alias("__within"), earlier().alias("__overall"))
    placed = _begin(rows, begins, ["__second"])
    rank = F.when(F.col(score).isNotNull(), F.col("__at") + F.col("__within")).cast("long").alias("rank_within_recent_status")
    led = kind in ("recently_scanning_first", "custom_segment_order")  # one status before the other, each in its own order
    overall = (F.col("__at") + F.col("__overall") if led else F.lit(None)).cast("long").alias("operational_rank")
    return placed.select(
        *(f"`{c}`" for c in known.columns), rank, F.col(score).alias("raw_model_probability"), F.col("recent_status").alias("operational_priority_segment"),
        F.lit(kind).alias("prioritization_strategy"), *([F.col("__second").alias("segment_order")] if led else []), overall)
