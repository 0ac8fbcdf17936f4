"""Score an upload, or add potentials to a scored file: `python -m tidemark.cli score|enrich ...`."""

from __future__ import annotations

import argparse
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cleaning
from tidemark.operators import duplicates, models, potential, risk
from tidemark.plans import headers, history, scoring
from tidemark.sources import delimited, files, xlsx


#: Where a trained model is sought if none is named.
MODEL = "artifacts/production/model"


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A CSV file (or a folder of them) or the first sheet of a workbook, all text, with row_order; and its rows."""
    if path.lower().endswith(".xlsx"):
        if sheets := list(xlsx.read_xlsx(spark, path, first_only=True).values()):
            return sheets[0], sheets[0].count()
        raise ValueError(f"{path} has no rows")
    if path.lower().rstrip("/").endswith(".csv") or files.is_folder(spark, path):
        return delimited.read(spark, path)
    raise ValueError(f"neither .csv nor .xlsx: {path}")


def scored_path(source: str) -> str:
    """Beside the source: its name with _scored.csv."""
    stem = source.rstrip("/")
    return re.sub(r"\.[^./]*$", "", stem) + "_scored.csv"


def score_file(
    spark: SparkSession, source: str, model: str = MODEL, target: str | None = None, policy: str = "error", scans: Sequence[str] | None = None, **columns: str | None
) -> dict[str, object]:
    """Upload in, five columns in its order out; the summary of `scoring.told`. columns: state, name, mobile, where their
    headers are not to be guessed."""
    (upload, n), held = read_upload(spark, source), models.load(model)
    out = scoring.score(scoring.prepare(upload, policy, scans, **columns), lambda df: models.predict(held, df))
    return _write(n, out, scoring.SCORED, target or scored_path(source))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A lookup that is ready: mobile_id, Potential, Potential Band, from Parquet or CSV."""
    table = files.read_csv(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    headers.require(table, ("mobile_id", "Potential", "Potential Band"))
    table = table.withColumns({"mobile_id": cleaning.mobile(F.col("mobile_id").cast("string")).id, "Potential": cleaning.safe_number(F.col("Potential"))})
    return duplicates.first_occurrence(table.filter("mobile_id is not null"), "mobile_id", "Potential")


def enrich_file(spark: SparkSession, source: str, panel: str | None, yearly: str | None, target: str, years: tuple[int, int] = (2024, 2025), lookup: str | None = None) -> dict[str, object]:
    """Five scored columns in, seven in their order out. The potentials are from a ready lookup, or from a history: the
    panel's, or the yearly files'."""
    scored, n = read_upload(spark, source)
    if (own := tuple(c for c in scored.columns if c != "row_order")) != scoring.SCORED:
        raise ValueError(f"a scored file has the columns {list(scoring.SCORED)}, not {list(own)}")
    if lookup:
        table, origin = read_lookup(spark, lookup), f"lookup:{lookup}"
    else:
        rows, origin = history.load(spark, panel, yearly, range(years[0], years[1] + 1))
        table = potential.lookup(rows, first=years[0] * 12 + 1, last=years[1] * 12 + 12)
    keyed = scored.withColumns({"mobile_id": cleaning.mobile(F.col("Customer mobile number")).id, "Churn probability": cleaning.number(F.col("Churn probability"))})
    return _write(n, scoring.enrich(keyed, table), risk.FINAL_COLUMNS, target) | {"history": origin}


def _write(n: int, after: DataFrame, columns: Sequence[str], target: str) -> dict[str, object]:
    """after, in the order of the input, as CSV; what is told of it is counted while it is written."""
    seen, rows = Observation(), after.orderBy("row_order").select(*columns)
    files.write_csv(rows.observe(seen, *scoring.measures(rows.columns)), target)
    return scoring.told(n, seen.get, rows.columns, columns) | {"output": target}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    score, enrich = commands.add_parser("score"), commands.add_parser("enrich")
    for command in (score, enrich):
        command.add_argument("--input", required=True)
    score.add_argument("--model", default=MODEL)
    score.add_argument("--output", help="default: beside the input, with _scored.csv")
    score.add_argument("--duplicates", choices=("error", "first_occurrence"), default="error")
    score.add_argument("--scan-columns", help="six headers, oldest first, between commas")
    for c in ("state", "name", "mobile"):
        score.add_argument(f"--{c}-column")
    enrich.add_argument("--output", required=True)
    for option in ("panel", "yearly", "lookup"):
        enrich.add_argument(f"--{option}")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if given.command == "score":
        scans = given.scan_columns.split(",") if given.scan_columns else None
        told = score_file(spark, given.input, given.model, given.output, given.duplicates, scans, state=given.state_column, name=given.name_column, mobile=given.mobile_column)
    else:
        if not given.lookup and not (given.panel and given.yearly):
            parser.error("enrich needs --lookup, or --panel and --yearly")
        told = enrich_file(spark, given.input, given.panel, given.yearly, given.output, lookup=given.lookup)
    print(json.dumps(told))


if __name__ == "__main__":
    main()
