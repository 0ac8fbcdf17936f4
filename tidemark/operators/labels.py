"""Labels of windows by a configured rule."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.errors import DecisionRequired
from tidemark.plans.rules import is_undecided

_COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__}


def compare(c: Column, operator: str, threshold: float) -> Column:
    """False where c is null."""
    if operator not in _COMPARE:
        raise DecisionRequired(f"unsupported target operator: {operator}")
    return F.coalesce(_COMPARE[operator](c, F.lit(float(threshold))), F.lit(False))


def label(windows: DataFrame, rule: dict[str, Any] | None) -> DataFrame:
    """windows with `target`. Rules: explicit_column, future_total_rule, decline_rule; anything else must be decided."""
    kind = (rule or {}).get("type")
    if is_undecided(kind):
        raise DecisionRequired("no target definition is configured")

    def need(key: str) -> Any:
        if is_undecided(rule.get(key)):
            raise DecisionRequired(f"{kind} needs {key}")
        return rule[key]

    def column(name: str) -> str:
        if name not in windows.columns:
            raise DecisionRequired(f"no column {name} in windows")
        return name

    if kind == "explicit_column":
        return windows.withColumn("target", F.col(column(need("column"))).cast("int"))
    if kind == "future_total_rule":
        threshold, operator = need("threshold"), need("operator")
        return windows.withColumn("target", compare(F.col(column(rule.get("source_column", "future_3m_total"))), operator, threshold).cast("int"))
    if kind == "decline_rule":
        base, other, operator, threshold = column(need("baseline_column")), column(need("comparison_column")), need("operator"), need("threshold")
        ratio = F.try_divide(F.col(other), F.col(base))
        return windows.withColumn("target_helper_decline_ratio", ratio).withColumn("target", compare(ratio, operator, threshold).cast("int"))
    raise DecisionRequired(f"unsupported target definition: {kind}")


def option_report(windows: DataFrame) -> DataFrame:
    total, future = F.col("feature_6m_total"), F.col("future_3m_total")
    return windows.select(
        "feature_window_start_month", "feature_window_end_month", "target_window_start_month", "target_window_end_month", "recent_status", "feature_6m_total", "future_3m_total",
        (future - total).alias("future_minus_feature_total"), F.try_divide(future, total).alias("future_to_feature_total_ratio"))
