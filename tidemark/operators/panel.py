"""The monthly panel: reshaping, coverage and continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import months as M
from tidemark.functions.cleaning import entity_id


def pivot_months(long: DataFrame, ids: Sequence[str], month: str = "month_name", value: str = "scan_points") -> DataFrame:
    """Long rows to Jan..Dec; months without a row are null."""
    return long.groupBy(*ids).pivot(month, list(M.MONTHS)).agg(F.sum(value))


def unpivot_months(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Jan..Dec to long rows (month_name, scan_points), a row for each month, null or not."""
    return wide.unpivot(list(ids), list(M.MONTHS), "month_name", "scan_points")


def build_panel(yearly: DataFrame) -> DataFrame:
    """Cleaned yearly tables to one row for each entity and month."""
    lineage = ("source_year", "source_file", "source_sheet", "source_row_number")
    ids = ["mobile_id", "mobile_is_valid", "mobile_cleaning_issue", "State", "Name", "MobileNo1", *lineage, "duplicate_resolution_rule", "source_duplicate_row_count"]
    long = unpivot_months(yearly.select(*ids, *M.MONTHS), ids)
    return long.select(
        entity_id(F.col("mobile_id"), F.col("mobile_is_valid"), *map(F.col, lineage)).alias("influencer_id"), "mobile_id", "mobile_is_valid", "mobile_cleaning_issue",
        F.col("State").alias("original_state"), F.col("Name").alias("original_customer_name"), F.col("MobileNo1").alias("original_mobile_number"),
        F.make_date("source_year", M.name_number(F.col("month_name")), F.lit(1)).alias("month_date"), F.col("source_year").cast("int").alias("calendar_year"),
        M.name_number(F.col("month_name")).alias("calendar_month"), "month_name", "scan_points", *lineage, "duplicate_resolution_rule", "source_duplicate_row_count",
    )


def coverage(panel: DataFrame, key: str = "influencer_id", ord: str = "ord", value: str = "scan_points") -> DataFrame:
    """First and last month of each entity, months seen and missing, years, totals; its mobile_id, mobile_is_valid and
    source_duplicate_row_count_max, where the panel has what they need. A hot entity is summed by parts."""
    sources = {"mobile_id": "mobile_id", "mobile_is_valid": "mobile_is_valid", "source_duplicate_row_count_max": "source_duplicate_row_count"}
    own = {new: c for new, c in sources.items() if c in panel.columns}
    monthly = panel.groupBy(key, ord).agg(*(F.max(c).alias(new) for new, c in own.items()), F.sum(F.coalesce(value, F.lit(0.0))).alias("v"), F.count_if(F.col(value) > 0).alias("p"))
    year = M.ordinal_year(F.col(ord))
    out = monthly.groupBy(key).agg(
        *(F.max(c).alias(c) for c in own),
        F.min(ord).alias("lo"), F.max(ord).alias("hi"), F.count(F.lit(1)).alias("observed_month_count"),
        F.array_sort(F.collect_set(year)).alias("years"), F.sum("v").alias("total_scan_points"), F.sum("p").alias("positive_scan_month_count"))
    expected = F.col("hi") - F.col("lo") + 1
    return out.select(
        key, M.ordinal_label(F.col("lo")).alias("first_month"), M.ordinal_label(F.col("hi")).alias("last_month"), "observed_month_count",
        expected.cast("long").alias("expected_month_count"), (expected - F.col("observed_month_count")).alias("missing_month_count"),
        (expected - F.col("observed_month_count")).alias("continuity_gap_count"),
        F.array_join(F.transform("years", lambda y: y.cast("string")), "|").alias("years_covered"), F.size("years").cast("long").alias("year_count"),
        (F.size("years") > 1).alias("has_cross_year_coverage"), "total_scan_points", "positive_scan_month_count", *own,
    )


def build_stats(covered: DataFrame) -> DataFrame:
    """One row of totals over what `coverage` gives."""
    gap = F.col("missing_month_count")
    return covered.agg(
        F.count(F.lit(1)).alias("influencer_count"), F.coalesce(F.sum("observed_month_count"), F.lit(0)).alias("panel_rows"), F.count_if(gap > 0).alias("influencers_with_missing_months"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("total_missing_months"), F.coalesce(F.max(gap), F.lit(0)).cast("long").alias("max_missing_months"),
        F.coalesce(F.max("continuity_gap_count"), F.lit(0)).cast("long").alias("max_continuity_gaps"), F.count_if("has_cross_year_coverage").alias("influencers_across_years"))


def year_summary(panel: DataFrame, key: str = "influencer_id", ord: str = "ord") -> DataFrame:
    months = F.bit_count(F.bit_or(F.col("months")))  # of the year's twelve
    per = panel.groupBy(M.ordinal_year(F.col(ord)).cast("long").alias("year"), key).agg(
        F.count(F.lit(1)).alias("n"), F.min(ord).alias("lo"), F.max(ord).alias("hi"), F.bit_or(F.call_function("shiftleft", F.lit(1), M.ordinal_month(F.col(ord)))).alias("months"))
    return per.groupBy("year").agg(
        F.sum("n").alias("panel_rows"), F.count(F.lit(1)).alias("unique_influencers"), months.cast("long").alias("months_present"),
        M.ordinal_label(F.min("lo")).alias("min_month"), M.ordinal_label(F.max("hi")).alias("max_month"))


def source_year_counts(yearly: DataFrame, key: str = "influencer_id") -> DataFrame:
    """source_year, cleaned_year_rows, unique_influencers of cleaned yearly rows; a hot entity is one row of each task."""
    per = yearly.groupBy("source_year", key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source_year").agg(F.sum("n").alias("cleaned_year_rows"), F.count(F.lit(1)).alias("unique_influencers"))


def cross_year_continuity(panel: DataFrame, key: str = "influencer_id", ord: str = "ord") -> DataFrame:
    """For each pair of successive years: entities in both, with December and January, and without."""
    per = panel.groupBy(key, M.ordinal_year(F.col(ord)).alias("year")).agg(
        F.max((M.ordinal_month(F.col(ord)) == 12).cast("int")).alias("dec"), F.max((M.ordinal_month(F.col(ord)) == 1).cast("int")).alias("jan"))
    after = per.select(key, (F.col("year") - 1).alias("year"), F.col("jan").alias("next_jan"))
    return per.join(after, [key, "year"]).groupBy(F.format_string("%d-%d", "year", F.col("year") + 1).alias("year_pair")).agg(
        F.count(F.lit(1)).alias("in_both_years"), F.sum(F.col("dec") * F.col("next_jan")).alias("continuous_dec_to_jan"),
        F.sum(1 - F.col("dec") * F.col("next_jan")).alias("breaks"))
