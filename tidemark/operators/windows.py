"""Gap-strict sliding windows: six months of features, then three of target."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import months as M


@dataclass(frozen=True)
class WindowSpec:
    feature_months: int = 6
    horizon_months: int = 3
    holdout_year: int = 2025

    @property
    def width(self) -> int:
        return self.feature_months + self.horizon_months


#: About so many rows at most are grouped in one task.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, at most n of them, dealt by keys to so many tasks that what a task holds of them doesn't grow with n; as they
    are, where so few tasks are enough as Spark leaves in any case: of more shuffle partitions than there are cores, it
    puts as many together, whatever their number."""
    spark = rows.sparkSession
    parts, least = -(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys) if parts > least else rows


def monthly(panel: DataFrame, key: str, ord: str, value: str) -> DataFrame:
    """Sum by entity and month, null as 0."""
    return panel.groupBy(key, ord).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(value))


def last_nonblank(c: str, order: str) -> Column:
    """The value of the last row, by order, in which c isn't blank."""
    some = (F.trim(F.col(c).cast("string")) != "") & (F.lower(F.col(c).cast("string")) != "nan")
    return F.max_by(c, F.when(some, F.col(order)))


def sliding(panel: DataFrame, key: str, ord: str = "ord", value: str = "scan_points", spec: WindowSpec = WindowSpec(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Each start whose next months follow without a gap or a repeat: key, start and the values s1..sN.

    carry: columns of which each window has its entity's last value that isn't blank.

    All window functions share one sort by entity; the steps of exactly one month are counted, so that a month that
    occurs twice voids the window as a missing one does."""
    w = W.partitionBy(key).orderBy(ord)
    n = spec.width
    last = (last_nonblank(c, ord).over(W.partitionBy(key)).alias(c) for c in carry)
    step = panel.select(key, ord, value, *last, (F.col(ord) - F.lag(ord).over(w) == 1).cast("int").alias("__step"))
    return step.select(
        key, *carry, F.col(ord).alias("start"), F.sum("__step").over(w.rowsBetween(1, n - 1)).alias("__steps"),
        *(F.coalesce(F.lead(value, k).over(w) if k else F.col(value), F.lit(0.0)).alias(f"s{k + 1}") for k in range(n)),
    ).filter(F.col("__steps") == n - 1).drop("__steps")


def _sum(columns: list[str]) -> Column:
    return reduce(add, map(F.col, columns))


def _positive(columns: list[str]) -> Column:
    return reduce(add, ((F.col(c) > 0).cast("int") for c in columns)).cast("long")


def derive(windows: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """The columns of a window sample, from what `sliding` gives."""
    f, h = spec.feature_months, spec.horizon_months
    feats, fut = [f"feature_scan_m{k}" for k in range(1, f + 1)], [f"future_scan_m{k}" for k in range(1, h + 1)]
    ids = [c for c in windows.columns if c != "start" and not (c[0] == "s" and c[1:].isdigit())]
    at = F.col("start")
    named = windows.select(*ids, "start", *(F.col(f"s{k}").alias(x) for k, x in enumerate(feats + fut, 1)))
    ends = {"feature_window_start_month": at, "feature_window_end_month": at + f - 1, "target_window_start_month": at + f, "target_window_end_month": at + f + h - 1}
    summed = named.withColumns(
        {k: M.ordinal_label(v) for k, v in ends.items()}
        | {k: M.ordinal_year(v).cast("long") for k, v in zip(("feature_start_year", "feature_end_year", "target_start_year", "target_end_year"), ends.values(), strict=True)}
        | {"feature_6m_total": _sum(feats), "prior_3m_total": _sum(feats[: f // 2]), "recent_3m_total": _sum(feats[f // 2 :]), "future_3m_total": _sum(fut)}
        | {"feature_positive_month_count": _positive(feats), "recent_positive_month_count": _positive(feats[f // 2 :]), "future_positive_month_count": _positive(fut)}
    )
    recent, future = F.col("recent_3m_total"), F.col("future_3m_total")
    return summed.withColumns({
        "future_minus_recent": future - recent, "future_over_recent_ratio": F.try_divide(future, recent),
        "zero_scans_last_3m_flag": recent == 0, "zero_scans_next_3m_flag": future == 0,
        "recent_status": F.when(recent == 0, "recently_inactive").otherwise("recently_scanning"),
        "recently_inactive": recent == 0, "recently_scanning": recent != 0, "future_any_scan_flag": future > 0,
        "cross_year_feature_flag": F.col("feature_start_year") != F.col("feature_end_year"), "cross_year_target_flag": F.col("target_start_year") != F.col("target_end_year"),
        "cross_year_6_plus_3_flag": F.col("feature_start_year") != F.col("target_end_year"), "split": split(spec.holdout_year),
    })


def split(holdout_year: int) -> Column:
    start, end = F.col("target_start_year"), F.col("target_end_year")
    return F.when(end <= holdout_year - 1, "development").when((start == holdout_year) & (end == holdout_year), "holdout_2025").otherwise("excluded_split_gap")


def build(panel: DataFrame, key: str, ord: str = "ord", value: str = "scan_points", spec: WindowSpec = WindowSpec(), carry: tuple[str, ...] = ()) -> DataFrame:
    return derive(sliding(panel, key, ord, value, spec, carry), spec)


def stats(windows: DataFrame) -> DataFrame:
    """Counts and sums by split and recent status."""
    return windows.groupBy("split", "recent_status").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("zero_scans_last_3m_flag").alias("zero_last"), F.count_if("zero_scans_next_3m_flag").alias("zero_next"),
        F.count_if("cross_year_6_plus_3_flag").alias("cross_year"), F.sum("recent_3m_total").alias("recent_total"), F.sum("future_3m_total").alias("future_total"))


def shares(df: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """Counts by within + by, and their share of within; grouped first, so the window sees one row a group."""
    counts = df.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("row_count"))
    total = F.sum("row_count").over(W.partitionBy(*within))
    return counts.withColumn("total_rows", total).withColumn("label_share", F.col("row_count") / F.col("total_rows"))


def build_stats(panel: DataFrame, windows: DataFrame, key: str = "influencer_id", spec: WindowSpec = WindowSpec()) -> DataFrame:
    """One row: entities with and without windows, the places a window could start, windows by outcome. panel has a row
    for each entity and month."""
    places = F.greatest(F.col("n") - (spec.width - 1), F.lit(0))
    seen = panel.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("influencers_seen"), F.coalesce(F.sum(places), F.lit(0)).alias("total_candidate_windows"))
    count = lambda s: F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}_windows")
    per = windows.groupBy(key).agg(F.count(F.lit(1)).alias("generated"), *(F.count_if(F.col("split") == s).alias(a) for s, a in (("development", "development"), ("holdout_2025", "holdout"), ("excluded_split_gap", "excluded_split"))))
    made = per.agg(F.count(F.lit(1)).alias("influencers_with_windows"), *map(count, ("generated", "development", "holdout", "excluded_split")))
    skipped = (F.col("total_candidate_windows") - F.col("generated_windows")).alias("skipped_nonconsecutive_windows")
    return seen.join(F.broadcast(made)).select("*", skipped)  # one row each


#: First months of the windows that a build report counts by name.
EXAMPLES = ("2022-01", "2022-05", "2024-10")


def example_counts(windows: DataFrame, starts: tuple[str, ...] = EXAMPLES) -> DataFrame:
    """example, windows: how many have each of these first months. Those that none has are missing."""
    name = F.format_string("%s_to_%s_target_%s_to_%s", "feature_window_start_month", "feature_window_end_month", "target_window_start_month", "target_window_end_month")
    return windows.filter(F.col("feature_window_start_month").isin(*starts)).groupBy(name.alias("example")).agg(F.count(F.lit(1)).alias("windows"))


def legacy(windows: DataFrame, key: str = "mobile_id", state: str = "state", name: str = "customer_name") -> DataFrame:
    """The older layout of a window sample: mobile_id, State, Name, MobileNo1, four bounds, scan_m and future_scan_m."""
    bounds = {f"{part}_{end}": F.to_date(F.concat(f"{part}_window_{end}_month", F.lit("-01"))) for part in ("feature", "target") for end in ("start", "end")}
    return windows.select(
        F.col(key).alias("mobile_id"), F.col(state).alias("State"), F.col(name).alias("Name"), F.col(key).alias("MobileNo1"), *(c.alias(n) for n, c in bounds.items()),
        *(F.col(f"feature_scan_m{k}").alias(f"scan_m{k}") for k in range(1, 7)), *(f"future_scan_m{k}" for k in range(1, 4)))
