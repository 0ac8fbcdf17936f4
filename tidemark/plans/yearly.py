"""Raw files of any known layout to cleaned yearly tables, and on to the panel."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cleaning, months
from tidemark.operators import duplicates
from tidemark.plans import headers
from tidemark.sources import files, xlsx

log = logging.getLogger(__name__)


#: (file, sheet) -> what is counted while the table is written.
Watch = dict[tuple[str, str], Observation]


def _watched(df: DataFrame, values: Sequence[str], watch: Watch | None, where: tuple[str, str], *more: Column) -> DataFrame:
    if watch is None:
        return df
    watch[where] = Observation()
    return df.observe(watch[where], *cleaning.counters(values), *more)


def quality_report(watch: Watch) -> list[dict[str, object]]:
    """What was counted, of each file and sheet, once what `build_yearly` gave has been written (or read in another way);
    it waits for that. Labels that name no month are warned of, as their values are in no column."""
    out = []
    for (file, sheet), seen in watch.items():
        out.append({"source_file": file, "source_sheet": sheet} | seen.get)
        if n := out[-1].get("unread_months"):
            log.warning("%s, %s: %d values under labels that name no month", file, sheet, n)
    return out


def from_long(df: DataFrame, year: int | None, watch: Watch | None = None, where: tuple[str, str] = ("", "")) -> DataFrame:
    """A monthly-long table (with source_row_number) to one row for each identity and year, with Jan..Dec and the number
    of its first row. Real rows only are pivoted, so no combination of identities is made up."""
    year_column, month, value = headers.long_columns(df.columns)
    y = F.col(year_column).try_cast("double").cast("int") if year_column else F.lit(year).cast("int")
    unread = months.abbreviation(F.col(month)).isNull() & cleaning.number(cleaning.unless_blank(F.col(value))).isNotNull()
    df = _watched(df, [value], watch, where, F.count_if(unread).alias("unread_months"))
    rows = df.select(*headers.IDENTITY, "source_row_number", y.alias("source_year"), months.abbreviation(F.col(month)).alias("month_name"), cleaning.number(cleaning.unless_blank(F.col(value))).alias("v"))
    return rows.groupBy(*headers.IDENTITY, "source_year").agg(
        F.min("source_row_number").alias("source_row_number"), *(F.sum(F.when(F.col("month_name") == m, F.col("v"))).alias(m) for m in months.MONTHS))


def one_table(df: DataFrame, source_file: str, source_sheet: str, year: int | None, aliases: Mapping[str, Sequence[str]] | None = None, watch: Watch | None = None) -> DataFrame | None:
    """A raw table, all text, as cleaned rows; None, with a warning, if its layout isn't known."""
    df = df.withColumnRenamed("row_order", "source_row_number") if "row_order" in df.columns else files.with_row_number(df, "source_row_number", 2)
    df = headers.canonical(df, aliases).withColumn("source_row_number", F.col("source_row_number").cast("long"))
    kind = headers.layout(df.columns)
    if kind == "unknown":
        log.warning("%s, %s: no known layout, skipped", source_file, source_sheet)
        return None
    headers.require(df, headers.IDENTITY)
    if kind == "long":
        wide = from_long(df, year, watch, (source_file, source_sheet))
    else:
        df = _watched(df, months.MONTHS, watch, (source_file, source_sheet))
        wide = df.select(*headers.IDENTITY, F.lit(year).cast("int").alias("source_year"), "source_row_number", *months.MONTHS)
    named = wide.withColumns({"source_file": F.lit(source_file), "source_sheet": F.lit(source_sheet)} | {m: F.col(m).cast("string") for m in months.MONTHS})
    return cleaning.clean(named, months.MONTHS)


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows, numbered from 2 on: the header is row 1."""
    df = files.read_csv(spark, path, order=True)
    return df.withColumn("row_order", F.col("row_order") + 2)


def build_yearly(spark: SparkSession, directory: str, aliases: Mapping[str, Sequence[str]] | None = None, watch: Watch | None = None) -> DataFrame:
    """All raw files below a directory, cleaned, and resolved over all sources of a year at once. watch gets what is
    counted of each on the way, for `quality_report`."""
    tables = []
    for path in files.find(spark, directory, ("csv", "xlsx")):
        year, name = files.year_of(path), path.rsplit("/", 1)[-1]
        if path.lower().endswith(".csv"):
            tables.append(one_table(_csv_rows(spark, path), name, "csv", year, aliases, watch))
        else:
            tables += [one_table(df, name, sheet, year or files.year_of(sheet), aliases, watch) for (_, sheet), df in xlsx.read_xlsx(spark, path).items()]
    if not (known := [t for t in tables if t is not None]):
        raise FileNotFoundError(f"no raw file with a known layout below {directory}")
    return duplicates.resolve(reduce(lambda a, b: a.unionByName(b), known))
