"""The 42 features of six months, as row-local column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import add
from pathlib import Path

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import number

#: Identity columns.
BLOCKED = ("customer_mobile_number", "mobile_id", "influencer_id", "customer_name", "Name", "MobileNo1", "original_mobile_number", "original_customer_name")
_SCANS = (tuple(f"scan_m{k}" for k in range(1, 7)), tuple(f"feature_scan_m{k}" for k in range(1, 7)), tuple(f"month_{k}" for k in range(1, 7)))
MONTHS = tuple(f"month_{k}" for k in range(1, 7))


def scan_columns(columns: list[str]) -> tuple[str, ...]:
    for names in _SCANS:
        if set(names) <= set(columns):
            return names
    raise ValueError("no complete set of six scan columns")


def state_of(df: DataFrame) -> Column:
    for name in ("state", "State", "original_state"):
        if name in df.columns:
            x = F.upper(F.trim(F.col(name)))
            return F.coalesce(F.when(x != "", x), F.lit("UNKNOWN"))
    return F.lit("UNKNOWN")


def _total(xs: list[Column]) -> Column:
    return reduce(add, xs)


def _count(xs: list[Column]) -> Column:
    return _total([x.cast("int") for x in xs]).cast("long")


def _spread(xs: list[Column]) -> Column:
    mean = _total(xs) / len(xs)
    return F.sqrt(_total([(x - mean) * (x - mean) for x in xs]) / len(xs))


def expressions() -> dict[str, Column]:
    """Name -> expression over month_1..month_6, which are doubles without nulls."""
    m = [F.col(x) for x in MONTHS]
    d = [b - a for a, b in zip(m, m[1:], strict=False)]
    first3, last3, last2, last4, total = _total(m[:3]), _total(m[3:]), _total(m[4:]), _total(m[2:]), _total(m)
    s = F.array_sort(F.array(*m))
    active = [x > 0 for x in m]
    run = F.lit(0)
    for k, x in enumerate(m):  # a zero lengthens the run that ends there; the last month is outermost
        run = F.when(x == 0, run + 1).otherwise(0)
    std = _spread(m)
    out = {
        "sum_6m": total, "avg_6m": total / 6, "median_6m": (s[2] + s[3]) / 2, "min_6m": F.least(*m), "max_6m": F.greatest(*m), "std_6m": std,
        **{f"active_months_last_{k}": _count(active[-k:]) for k in range(2, 7)},
        "pct_change_last_3_vs_prev_3": F.try_divide(last3 - first3, first3), "first_3m_sum": first3, "last_3m_sum": last3, "last_2m_sum": last2, "last_1m": m[5],
        "ratio_last3_first3": F.try_divide(last3, first3), "ratio_last2_last4": F.try_divide(last2, last4), "delta_last3_first3": last3 - first3, "delta_last2_last3": last2 - last3,
        "trend_last_3_vs_prev_3": last3 / 3 - first3 / 3, "month6_vs_month1_ratio": F.try_divide(m[5], m[0]),
        "linear_trend_slope_6m": _total([F.lit(k - 2.5) * (x - total / 6) for k, x in enumerate(m)]) / 17.5,
        "avg_month_on_month_change": _total(d) / 5, "positive_change_count": _count([x > 0 for x in d]), "negative_change_count": _count([x < 0 for x in d]),
        "zero_month_count": _count([x == 0 for x in m]), "recent_consecutive_zero_count": run.cast("long"), "active_month_count": _count(active),
        "coefficient_of_variation": F.try_divide(std, total / 6), "share_recent3_of_total6": F.try_divide(last3, total), "volatility_std_mom_change": _spread(d),
        "volatility_range_6m": F.greatest(*m) - F.least(*m), "volatility_mean_abs_mom_change": _total([F.abs(x) for x in d]) / 5, "volatility_max_abs_mom_change": F.greatest(*[F.abs(x) for x in d]),
    }
    return out


NUMERIC = (*MONTHS, "sum_6m", "avg_6m", "median_6m", "min_6m", "max_6m", "std_6m", *(f"active_months_last_{k}" for k in range(2, 7)), "pct_change_last_3_vs_prev_3", "first_3m_sum", "last_3m_sum", "last_2m_sum", "last_1m", "ratio_last3_first3", "ratio_last2_last4", "delta_last3_first3", "delta_last2_last3", "trend_last_3_vs_prev_3", "month6_vs_month1_ratio", "linear_trend_slope_6m", "avg_month_on_month_change", "positive_change_count", "negative_change_count", "zero_month_count", "recent_consecutive_zero_count", "active_month_count", "coefficient_of_variation", "share_recent3_of_total6", "volatility_std_mom_change", "volatility_range_6m", "volatility_mean_abs_mom_change", "volatility_max_abs_mom_change")


def scan_value(df: DataFrame, c: str) -> Column:
    """A scan as double; 0 where it is null or no number."""
    value = number(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def add_features(df: DataFrame, keep: tuple[str, ...] = (), fill: float | None = None) -> DataFrame:
    """keep + the 41 numeric features + state. Scans that are null or no number count 0; ratios over zero are null, or
    `fill`. Identity columns can't be features."""
    scans = scan_columns(df.columns)
    base = df.select(*keep, *(scan_value(df, c).alias(x) for c, x in zip(scans, MONTHS, strict=True)), state_of(df).alias("state"))
    made = base.select(*keep, *MONTHS, *(e.alias(n) for n, e in expressions().items()), "state")
    return made if fill is None else made.fillna(fill, subset=[n for n in NUMERIC if n not in MONTHS])


def check_blocked(columns: list[str]) -> None:
    if bad := sorted(set(columns) & set(BLOCKED)):
        raise ValueError(f"identity columns can't be features: {bad}")


def write_manifest(path: str, used: Sequence[str] = (*NUMERIC, "state")) -> None:
    """The features that a model uses, as JSON beside it; identity columns among them are refused."""
    check_blocked(list(used))
    numeric = [c for c in used if c in NUMERIC]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest() | {"numeric": numeric, "categorical": [c for c in used if c not in numeric]}, indent=2), encoding="utf-8")


def manifest() -> dict[str, object]:
    return {"numeric": list(NUMERIC), "categorical": ["state"], "blocked": list(BLOCKED)}


class FeatureTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """add_features as a pipeline stage, so that training and scoring share it. It adds columns and keeps all others;
    ratios over zero stay null, for the model's imputer, unless `fill` is set."""

    fill = Param(Params._dummy(), "fill", "what stands for a ratio over zero", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, fill: float | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        scans, own = scan_columns(df.columns), expressions()
        base = df.withColumns({x: scan_value(df, c) for c, x in zip(scans, MONTHS, strict=True)} | {"state": state_of(df)})
        made = base.withColumns({n: e.cast("double") for n, e in own.items()})
        return made.fillna(self.getOrDefault(self.fill), subset=list(own)) if self.isSet(self.fill) else made
