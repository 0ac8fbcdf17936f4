"""Raw files: found, dated by their path, and read as text. All reads go through Spark's own readers, so any store that
Spark knows will do."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources import delimited
from tidemark.sources.shared import written


def find(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = ("csv", "xlsx", "xls")) -> list[str]:
    """Paths below a directory, sorted; file contents aren't read."""
    either = ["".join(f"[{x.lower()}{x.upper()}]" for x in s) for s in suffixes]  # .CSV is one too
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(either)}}}").load(directory).select("path").collect()
    return sorted(r["path"] for r in rows)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def year_of(path: str) -> int | None:
    """The one year 20dd in a path; None with none or several."""
    runs = ("".join(run) for digit, run in groupby(path, lambda c: c in "0123456789") if digit)
    match {run for run in runs if len(run) == 4 and run.startswith("20")}:
        case found if len(found) == 1:
            return int(found.pop())
    return None


def with_row_number(df: DataFrame, name: str, first: int) -> DataFrame:
    """Rows numbered from `first` on without gaps, in the order of the file: a row's place in its split, after the rows of
    the splits before."""
    rows = written(df.withColumn("__at", F.monotonically_increasing_id()), "numbered-rows")
    counts = rows.groupBy(F.shiftright("__at", 33).alias("__split")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(F.lit(0)).orderBy("__split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("__split", before.alias("__before"))
    place = (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + first).alias(name)
    return rows.join(begins, F.shiftright("__at", 33) == F.col("__split")).select(*(f"`{c}`" for c in df.columns), place)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, order: bool = False) -> DataFrame:
    """A CSV, or a folder of them, with a header, every column as text. order: with row_order, by place in the file.
    Without an encoding, the first of UTF-8, windows-1252 and Latin-1 that all bytes are valid in."""
    df, _ = delimited.read(spark, path, encoding)
    return df if order else df.drop("row_order")


def read_yearly(spark: SparkSession, directory: str) -> DataFrame:
    """Cleaned yearly tables, as `write_yearly` leaves them."""
    return spark.read.parquet(directory)


def write_yearly(df: DataFrame, directory: str) -> None:
    """By year, so that a read of some years skips the others' files."""
    df.write.mode("overwrite").partitionBy("source_year").parquet(directory)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Quotes inside fields are doubled, and white space at a field's ends stays. one_file is for small results that a
    contract wants as one file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_split(windows: DataFrame, path: str) -> None:
    """Development and holdout windows in one pass."""
    windows.filter("split <> 'excluded_split_gap'").write.mode("overwrite").partitionBy("split").parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refused over `most` rows."""
    cell = lambda v: "" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])
