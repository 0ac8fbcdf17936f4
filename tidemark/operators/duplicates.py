"""Rows that share a mobile: resolved, reported, checked for conflicts, or refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.cleaning import is_blank
from tidemark.functions.months import MONTHS

RULE, KEPT = "aggregate_by_mobile_year", "invalid_mobile_kept_each_source_row_flagged"


def representative(c: str) -> Column:
    """The most frequent value that isn't blank; of equally frequent ones the least."""
    return F.mode(F.when(F.trim(c) != "", F.col(c)), True)


def joined(c: str) -> Column:
    """The different values, sorted, between bars."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")


def resolve(cleaned: DataFrame, rule: str = RULE, scan_aggregation: str = "sum", months: Sequence[str] = MONTHS) -> DataFrame:
    """One row for each year and valid mobile, months summed (0 where all are null); invalid rows stay as they are."""
    if rule != RULE:
        raise ValueError(f"unsupported duplicate rule: {rule}")
    if scan_aggregation != "sum":
        raise ValueError(f"unsupported scan aggregation: {scan_aggregation}")
    texts = ("State", "Name", "MobileNo1", "mobile_digits", "mobile_cleaning_issue")
    valid = cleaned.filter("mobile_is_valid").groupBy("source_year", "mobile_id").agg(
        *(representative(c).alias(c) for c in texts), F.lit(True).alias("mobile_is_valid"),
        joined("source_file").alias("source_file"), joined("source_sheet").alias("source_sheet"), F.min("source_row_number").alias("source_row_number"),
        F.lit(RULE).alias("duplicate_resolution_rule"), F.count(F.lit(1)).alias("source_duplicate_row_count"),
        *(F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in months),
    )
    invalid = cleaned.filter("not coalesce(mobile_is_valid, false)").withColumns({"duplicate_resolution_rule": F.lit(KEPT), "source_duplicate_row_count": F.lit(1).cast("long")})
    return valid.unionByName(invalid, allowMissingColumns=True)


def report(cleaned: DataFrame) -> DataFrame:
    """Valid mobiles with more than one row in a year."""
    return cleaned.filter("mobile_is_valid").groupBy("source_year", "mobile_id").agg(
        F.count(F.lit(1)).alias("duplicate_row_count"), joined("source_file").alias("source_files"), joined("source_sheet").alias("source_sheets"),
        joined("MobileNo1").alias("raw_mobile_values")).filter("duplicate_row_count > 1")


def _signature(scans: Sequence[str]) -> Column:
    return F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in scans))


def conflict_samples(df: DataFrame, key: str, scans: Sequence[str], order: str, most: int = 3) -> DataFrame:
    """Keys with different scan rows: rows, how many different ones, and the first `most` of these in the order of rows.
    Rows shrink to one for each key and pattern, and of those no task passes on more than `most` of a key, so a key with
    very many patterns is never gathered."""
    patterns = df.filter(F.col(key).isNotNull()).groupBy(key, _signature(scans).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    whole = patterns.groupBy(key).agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("unique_scan_patterns")).filter("unique_scan_patterns > 1")
    place = F.row_number().over(W.partitionBy(key).orderBy("first", "pattern"))
    first = patterns.withColumn("place", place).filter(F.col("place") <= most)
    samples = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pattern"))), lambda x: x.pattern).alias("sample_scan_patterns"))
    return whole.join(samples, key)


def conflicts(df: DataFrame, key: str, scans: Sequence[str]) -> DataFrame:
    """Keys with several rows: how many, and how many different scan rows (null and 0 differ)."""
    signature = _signature(scans)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(signature).alias("signatures")).filter("row_count > 1").withColumn(
        "has_conflict", F.col("signatures") > 1)


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order; all rows without a key stay."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    first = df.filter(F.col(key).isNotNull()).withColumn("__n", n).filter("__n = 1").drop("__n")
    return first.unionByName(df.filter(F.col(key).isNull()))


def apply_policy(df: DataFrame, key: str, order: str, scans: Sequence[str], policy: str = "error") -> DataFrame:
    """error: duplicate keys are refused. first_occurrence: the first is kept, if no key's scans differ."""
    if policy not in ("error", "first_occurrence"):
        raise ValueError(f"unsupported duplicate policy: {policy}")
    found = conflicts(df, key, scans)
    keys, bad = found.agg(F.count(F.lit(1)), F.count_if("has_conflict")).first()
    if not keys:
        return df
    if policy == "error" or bad:
        some = [r[0] for r in found.filter(F.col("has_conflict") | F.lit(not bad)).orderBy(key).limit(3).collect()]
        raise ValueError(f"{keys} duplicate values of {key}, {bad} with different scans, such as {some}")
    return first_occurrence(df, key, order)


def blank_free(df: DataFrame, key: str) -> DataFrame:
    return df.filter(~is_blank(F.col(key)))
