"""Risk labels, and the dashboard that maps risk and potential to priority buckets."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import safe_number
from tidemark.plans.errors import ConfigError

log = logging.getLogger(__name__)

#: Thresholds, and the names and order of buckets, risks, levels and final columns.
HIGH, MEDIUM = 0.85, 0.50
BUCKETS = ("RED", "ORANGE", "GREEN", "OTHER")
RISKS = ("HIGH RISK", "MEDIUM RISK", "LOW RISK")
LEVELS = ("HIGH", "MEDIUM", "LOW", "OTHER")
FINAL_COLUMNS = ("State", "Customer name", "Customer mobile number", "Churn probability", "Risk", "Potential", "Potential Band")


def risk(p: Column) -> Column:
    """By fixed thresholds, both inclusive; null counts as 0."""
    p = F.coalesce(p, F.lit(0.0))
    return F.when(p >= HIGH, RISKS[0]).when(p >= MEDIUM, RISKS[1]).otherwise(RISKS[2])


@dataclass(frozen=True)
class BucketConfig:
    """Band -> level, and RISK|LEVEL -> bucket."""

    levels: dict[str, str] = field(default_factory=lambda: {">25k": "HIGH", "15-25k": "MEDIUM", "12-15k": "LOW", "<12k": "LOW", "BLANK": "OTHER"})
    buckets: dict[str, str] = field(default_factory=lambda: {
        "HIGH RISK|HIGH": "RED", "HIGH RISK|MEDIUM": "RED", "MEDIUM RISK|HIGH": "RED", "MEDIUM RISK|MEDIUM": "ORANGE", "MEDIUM RISK|LOW": "ORANGE",
        "HIGH RISK|LOW": "ORANGE", "LOW RISK|HIGH": "GREEN", "LOW RISK|MEDIUM": "GREEN", "LOW RISK|LOW": "OTHER"})

    @classmethod
    def read(cls, path: str) -> BucketConfig:
        """From a JSON file with potential_band_to_level and risk_potential_level_to_priority_bucket, trimmed and in upper
        case; a bucket that isn't known is OTHER, with a warning."""
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        try:
            own = [{_key(k): _key(v) for k, v in dict(held[name]).items()} for name in ("potential_band_to_level", "risk_potential_level_to_priority_bucket")]
        except (KeyError, TypeError, ValueError) as e:
            raise ConfigError(f"{path}: {e!r} is missing or no mapping") from e
        if bad := sorted(set(own[1].values()) - set(BUCKETS)):
            log.warning("%s: unknown buckets %s count as OTHER", path, bad)
        return cls(own[0], {k: v if v in BUCKETS else "OTHER" for k, v in own[1].items()})


def _key(value: object) -> str:
    return str(value).strip().upper()


def _mapped(key: Column, mapping: dict[str, str]) -> Column:
    """Whatever the case of keys."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (_key(k), v)]
    return F.try_element_at(F.create_map(*pairs), F.upper(key)) if pairs else F.lit(None).cast("string")


def dashboard_rows(final: DataFrame, config: BucketConfig = BucketConfig()) -> DataFrame:
    """final rows, normalised, with level and bucket (OTHER where the config has none) and which of them was missing."""
    if missing := [c for c in FINAL_COLUMNS if c not in final.columns]:
        raise ValueError(f"missing columns: {missing}")
    text = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit(""))
    band = F.coalesce(F.when(F.trim("Potential Band") != "", F.trim("Potential Band")), F.lit("BLANK"))
    numbers = {c: safe_number(F.col(c)) for c in ("Churn probability", "Potential")}
    rows = final.withColumns({"State": text("State"), "Risk": text("Risk"), "Potential Band": band} | numbers)
    level = _mapped(F.col("Potential Band"), config.levels)
    rows = rows.withColumns({"Potential Level": F.coalesce(level, F.lit("OTHER")), "unmapped_band": level.isNull()})
    bucket = _mapped(F.concat_ws("|", "Risk", "Potential Level"), config.buckets)
    return rows.withColumns({"Priority Bucket": F.coalesce(bucket, F.lit("OTHER")), "unmapped_combination": bucket.isNull()})


def counts(rows: DataFrame, column: str) -> DataFrame:
    """Count of each value that isn't blank."""
    return rows.filter(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def counts_in_order(rows: DataFrame, column: str, preferred: tuple[str, ...]) -> dict[str, int]:
    """The same as a dict: preferred values first, 0 if absent, then the others sorted. One small collect."""
    found = {r["value"]: r["n"] for r in counts(rows, column).collect()}
    return {k: found.get(k, 0) for k in preferred} | {k: found[k] for k in sorted(set(found) - set(preferred))}


def warnings(rows: DataFrame) -> DataFrame:
    """What the config doesn't map: kind, value, rows."""
    bands = rows.filter("unmapped_band").select(F.lit("band").alias("kind"), F.col("Potential Band").alias("value"))
    both = rows.filter("unmapped_combination").select(F.lit("combination").alias("kind"), F.concat_ws("|", "Risk", "Potential Level").alias("value"))
    return bands.unionByName(both).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def filtered(rows: DataFrame, state: str | None = None, risk: str | None = None, level: str | None = None) -> DataFrame:
    """Equality by trimmed upper case; blank or ALL filters nothing."""
    for column, wanted in (("State", state), ("Risk", risk), ("Potential Level", level)):
        wanted = (wanted or "").strip().upper()
        if wanted not in ("", "ALL"):
            rows = rows.filter(F.upper(F.trim(column)) == wanted)
    return rows


def bucket_rollup(rows: DataFrame) -> DataFrame:
    """Rows and their share by state and bucket, with a line ALL over all states; a share lies within 0..100."""
    small = rows.groupBy("State", F.col("Priority Bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    both = small.unionByName(small.groupBy(F.lit("ALL").alias("State"), "bucket").agg(F.sum("n").alias("n")))
    totals = both.groupBy("State").agg(F.sum("n").alias("total"))
    return both.join(totals, "State").withColumn("percent", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.col("n") / F.col("total"))))


def dashboard(final: DataFrame, config: BucketConfig = BucketConfig(), state: str | None = None, risk: str | None = None, level: str | None = None) -> dict[str, object]:
    """What a dashboard shows. The mapped rows are cached for the small aggregates; the records stay a DataFrame."""
    rows = dashboard_rows(final, config).persist()
    present = lambda c, preferred: [k for k, n in counts_in_order(rows, c, preferred).items() if n]
    out = {
        "row_count": rows.count(), "states": present("State", ()), "risks": present("Risk", RISKS), "levels": present("Potential Level", LEVELS),
        "by_bucket": counts_in_order(rows, "Priority Bucket", BUCKETS), "by_risk": counts_in_order(rows, "Risk", RISKS),
        "by_level": counts_in_order(rows, "Potential Level", LEVELS), "by_state": counts_in_order(rows, "State", ()),
        "warnings": [tuple(r) for r in warnings(rows).orderBy("kind", "value").collect()], "records": filtered(dashboard_rows(final, config), state, risk, level),
    }
    rows.unpersist()
    return out
