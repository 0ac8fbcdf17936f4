"""Potential: twice the best gap-free six months of an entity, and its band."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import months as M
from tidemark.operators.features import scan_columns
from tidemark.operators.ranking import quantiles
from tidemark.plans.errors import DecisionRequired
from tidemark.plans.rules import is_undecided

RUN = 6
#: A window counts as the best if it is so near the maximum.
RELATIVE, ABSOLUTE = 1e-5, 1e-8


def band(potential: Column) -> Column:
    """Fixed bands; 25,000 itself is in the third."""
    return F.when(potential < 12000, "<12k").when(potential < 15000, "12-15k").when(potential <= 25000, "15-25k").when(potential > 25000, ">25k")


def lookup(panel: DataFrame, key: str = "mobile_id", ord: str = "ord", value: str = "scan_points", first: int | None = None, last: int | None = None, run: int = RUN) -> DataFrame:
    """A row for each entity with a gap-free run: the greatest sum of `run` months, the earliest window that reaches it
    (within a tolerance), potential and band. A range frame over the month ordinal sees gaps by its row count."""
    own = panel.filter(F.col(key).isNotNull() & F.col(ord).isNotNull())
    if first is not None:
        own = own.filter(F.col(ord).between(first, last))
    monthly = own.groupBy(key, ord).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("v"))
    w = W.partitionBy(key).orderBy(ord).rangeBetween(-(run - 1), 0)
    sums = monthly.select(key, ord, F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n")).filter(F.col("n") == run)
    most = F.max("s").over(W.partitionBy(key))
    near = sums.withColumn("most", most).filter(F.abs(F.col("s") - F.col("most")) <= ABSOLUTE + RELATIVE * F.abs("most"))
    best = near.groupBy(key).agg(F.max("most").alias("best_run"), F.min(ord).alias("end"))
    return best.select(
        key, F.col("best_run").alias("max_continuous_6m_sum"), M.ordinal_label(F.col("end") - (run - 1)).alias("best_window_start_month"),
        M.ordinal_label(F.col("end")).alias("best_window_end_month"), (2 * F.col("best_run")).alias("Potential"), band(2 * F.col("best_run")).alias("Potential Band"))


def enrich(scored: DataFrame, table: DataFrame, key: str = "mobile_id") -> DataFrame:
    """scored with Potential and Potential Band; null where the lookup has no such entity. The join's strategy is left
    to Spark, which broadcasts the lookup only if its size is under the session's threshold."""
    return scored.join(table.select(key, "Potential", "Potential Band"), key, "left")


def lookup_stats(table: DataFrame) -> DataFrame:
    """Entities of each band, and least, median and greatest potential, all exact."""
    found = quantiles(table, "Potential", {"median_potential": 0.5}, ["Potential Band"])
    return found.withColumnsRenamed({"n": "entities", "least": "min_potential", "greatest": "max_potential"})


def top(table: DataFrame, n: int = 20, key: str = "mobile_id") -> DataFrame:
    return table.orderBy(F.desc("Potential"), key).limit(n)


def configured(windows: DataFrame, rule: dict[str, Any] | None) -> DataFrame:
    """windows with `potential` by a configured rule, of which there is one: explicit_column."""
    kind = (rule or {}).get("type")
    if is_undecided(kind):
        raise DecisionRequired("no potential definition is configured")
    if kind != "explicit_column":
        raise DecisionRequired(f"unsupported potential definition: {kind}")
    if rule.get("column") not in windows.columns:
        raise ValueError(f"no column {rule.get('column')} in windows")
    return windows.withColumn("potential", F.col(rule["column"]))


def option_report(windows: DataFrame, key: str = "mobile_id") -> DataFrame:
    """What a potential could be taken from: sum and maximum of six months, sum of the last three; null counts as
    nothing."""
    scans = scan_columns(windows.columns)
    start, end = (next(c for c in (f"feature_window_{x}_month", f"feature_{x}") if c in windows.columns) for x in ("start", "end"))
    total = lambda names: sum((F.coalesce(c, F.lit(0.0)) for c in names), F.lit(0.0))
    return windows.select(key, start, end, "recent_status", total(scans).alias("scan_sum_6m"), F.greatest(*scans).alias("scan_max_6m"), total(scans[3:]).alias("scan_sum_recent_3m"))
