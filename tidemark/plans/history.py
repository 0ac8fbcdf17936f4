"""Activity of the past: the monthly panel, or the cleaned yearly files where there is none."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cleaning, months
from tidemark.operators import panel
from tidemark.sources import files

log = logging.getLogger(__name__)

#: What window building calls a panel's columns.
WINDOW_NAMES = {"month_date": "period", "scan_points": "scan_value", "original_state": "State", "original_customer_name": "Name", "original_mobile_number": "MobileNo1"}


def window_columns(df: DataFrame) -> DataFrame:
    """A panel with WINDOW_NAMES; a column that has its name already stays."""
    return df.withColumnsRenamed({old: new for old, new in WINDOW_NAMES.items() if old in df.columns and new not in df.columns})


def panel_columns(df: DataFrame) -> DataFrame:
    """mobile_id (influencer_id where there is none), ord, scan_points of a panel; rows without a month go."""
    key = next((c for c in ("mobile_id", "influencer_id") if c in df.columns), None)
    if missing := [c for c in ("month_date", "scan_points") if c not in df.columns] + ([] if key else ["mobile_id"]):
        raise ValueError(f"the panel has no {missing}")
    date = F.col("month_date").try_cast("date")
    return df.select(F.col(key).cast("string").alias("mobile_id"), months.ordinal(date).alias("ord"), F.col("scan_points").try_cast("double").alias("scan_points")).filter("ord is not null")


def _yearly(spark: SparkSession, directory: str, years: Sequence[int]) -> list[DataFrame]:
    wanted, parts = {f"yearly_{y}_cleaned.csv": y for y in years}, []
    try:
        paths = files.find(spark, directory, ("csv",))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        paths = []
    for path in paths:
        if (year := wanted.get(path.rsplit("/", 1)[-1])) is None:
            continue
        df = files.read_csv(spark, path)
        if "mobile_id" not in df.columns:
            df = df.withColumn("mobile_id", cleaning.mobile(F.col("MobileNo1")).id)
        parts.append(panel.unpivot_months(df.select("mobile_id", *months.MONTHS), ["mobile_id"]).select(
            "mobile_id", (months.name_number(F.col("month_name")) + 12 * year).alias("ord"), F.col("scan_points").try_cast("double").alias("scan_points")))
    return parts


def yearly_paths(spark: SparkSession, directory: str) -> list[str]:
    """The files yearly_*_cleaned.csv below a directory; where there are none, yearly_*.csv."""
    found = {p: p.rsplit("/", 1)[-1] for p in files.find(spark, directory, ("csv",))}
    plain = [p for p, name in found.items() if name.startswith("yearly_")]
    if not plain:
        raise FileNotFoundError(f"no yearly files below {directory}")
    return [p for p in plain if found[p].endswith("_cleaned.csv")] or plain


def read_yearly_files(spark: SparkSession, directory: str) -> DataFrame:
    """All rows of `yearly_paths`, as text; a column that a file lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (files.read_csv(spark, p) for p in yearly_paths(spark, directory)))


def load(spark: SparkSession, panel_path: str, yearly_dir: str, years: Sequence[int] = (2024, 2025)) -> tuple[DataFrame, str]:
    """mobile_id, ord, scan_points and where they are from: the panel (Parquet or CSV), or, where none is there, the
    files yearly_<year>_cleaned.csv."""
    try:
        df = files.read_csv(spark, panel_path) if panel_path.lower().endswith(".csv") else spark.read.parquet(panel_path)
        return panel_columns(df), f"monthly_panel:{panel_path}"
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    log.warning("no monthly panel at %s; the cleaned yearly files are read", panel_path)
    if not (parts := _yearly(spark, yearly_dir, years)):
        raise FileNotFoundError(f"neither a panel at {panel_path} nor cleaned files of {list(years)} below {yearly_dir}")
    return reduce(DataFrame.unionByName, parts), f"cleaned_yearly_fallback:{yearly_dir}"
