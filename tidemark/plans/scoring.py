"""An upload to scored, enriched and mapped rows: one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cleaning
from tidemark.operators import duplicates, potential, ranking, risk
from tidemark.plans import headers

SCORED = risk.FINAL_COLUMNS[:5]


def prepare(upload: DataFrame, policy: str = "error", scans: Sequence[str] | None = None, **columns: str | None) -> DataFrame:
    """upload (all text, with row_order) -> State, Name, MobileNo1, mobile_id, scan_m1..6, recent_status, row_order."""
    own = [c for c in upload.columns if c != "row_order"]
    ids = headers.scoring_identifiers(own, **columns)
    names = {ids.state: "State", ids.name: "Name", ids.mobile: "MobileNo1"}
    order = headers.scan_columns([names.get(c, c) for c in own], manual=scans)
    renamed = upload.withColumnsRenamed(names)
    m = F.col("__mobile")
    rows = renamed.withColumn("__mobile", cleaning.mobile(F.col("MobileNo1"))).select(
        "State", "Name", "MobileNo1", m.id.alias("mobile_id"), m.valid.alias("mobile_is_valid"), m.issue.alias("mobile_cleaning_issue"),
        *(cleaning.number(cleaning.unless_blank(F.col(f"`{c}`"))).alias(f"scan_m{k}") for k, c in enumerate(order, 1)), "row_order")
    names6 = [f"scan_m{k}" for k in range(1, 7)]
    kept = duplicates.apply_policy(rows, "mobile_id", "row_order", names6, policy)
    lineage = {"scoring_scan_source_columns": ",".join(order), "scoring_identifier_source_columns": f"State={ids.state},Name={ids.name},MobileNo1={ids.mobile}"}
    return ranking.ensure_status(kept, names6).withColumns({k: F.lit(v) for k, v in lineage.items()})


def score(prepared: DataFrame, predict: Callable[[DataFrame], DataFrame], column: str = "risk_score") -> DataFrame:
    """The five columns of a scored file, and mobile_id, row_order."""
    p = F.col(column)
    return predict(prepared).select(
        F.col("State"), F.col("Name").alias("Customer name"), F.col("MobileNo1").alias("Customer mobile number"), p.alias("Churn probability"), risk.risk(p).alias("Risk"), "mobile_id", "row_order")


def enrich(scored: DataFrame, lookup: DataFrame) -> DataFrame:
    """The seven final columns, in the upload's order by row_order."""
    return potential.enrich(scored, lookup).select(*risk.FINAL_COLUMNS, "row_order")


def measures(columns: Sequence[str]) -> list[Column]:
    """Aggregates of a scored or final table: rows, nulls by column, rows by risk, probabilities that are none."""
    risks = [F.count_if(F.coalesce(F.col("Risk"), F.lit("BLANK")) == r).alias(f"risk:{r}") for r in (*risk.RISKS, "BLANK")] if "Risk" in columns else []
    p = "Churn probability"
    odd = [F.count_if(cleaning.safe_number(F.col(p)).isNull()).alias("no_probability")] if p in columns else []
    return [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null:{c}") for c in columns), *risks, *odd]


def told(n: int, found: dict[str, int], columns: Sequence[str], expected: Sequence[str]) -> dict[str, object]:
    """The summary from the number of input rows and what `measures` counted."""
    part = lambda kind: {k.removeprefix(kind): v for k, v in found.items() if k.startswith(kind)}
    own, m = [c for c in columns if c not in ("row_order", "mobile_id")], found["rows"]
    return {
        "input_rows": n, "output_rows": m, "schema_expected": list(expected), "schema_actual": own, "schema_matches": own == list(expected), "nulls": part("null:"),
        "risk_counts": {k: v for k, v in part("risk:").items() if v}, "churn_probability_missing_or_nonnumeric": found.get("no_probability", 0),
        "warnings": [] if n == m else [f"{n} rows became {m}"]}


def summary(before: DataFrame, after: DataFrame, expected: Sequence[str]) -> dict[str, object]:
    """Rows before and after, the schema's match, nulls by column, rows by risk; each frame is read once."""
    return told(before.count(), after.agg(*measures(after.columns)).first().asDict(), after.columns, expected)
