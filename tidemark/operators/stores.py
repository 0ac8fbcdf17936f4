"""The panel and its windows kept on disk: month by month without building all again, and by entity without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.operators.windows import WindowSpec
from tidemark.sources.files import is_folder


class WindowStore:
    """Windows that grow with the panel, in a folder that all executors share.

    The panel's sums lie in a partition for each month, and so do the windows that end in it. A month that comes, or comes
    again, replaces its partition, and the windows that end in it or up to eight months later; for these, only the months
    that they reach back to are read. So appending a month twice changes nothing, and month by month gives what building
    at once gives. carry: columns of which a window has its entity's last value that isn't blank; as a later month may
    change it for earlier windows, the values lie in a frame of their own that is joined when windows are read.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, spec: WindowSpec = WindowSpec(), carry: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.spec, self.carry = spark, path.rstrip("/"), key, spec, carry

    def _replace(self, df: DataFrame, name: str, by: str, months: list[int]) -> None:
        """The partitions of these months by what df has for them; those that it has nothing for go."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")
        there = {r[0] for r in self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").filter(F.col(by).isin(months)).select(by).distinct().collect()}  # of partitions, few
        written = {r[0] for r in df.select(by).distinct().collect()}
        for m in there - written:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{by}={m}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _panel(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/panel")

    def _steps(self) -> list[str]:
        return [f"s{k}" for k in range(1, self.spec.width + 1)]

    def append(self, panel: DataFrame, ord: str = "ord", value: str = "scan_points") -> list[int]:
        """Rows of whole months (key, ord, value, carry); the months whose windows were built."""
        rows = panel.select(self.key, F.col(ord).cast("int").alias("ord"), F.col(value).alias("scan_points"), *self.carry)
        months = sorted(r[0] for r in rows.select("ord").distinct().collect())
        if not months:
            return []
        last = [windows.last_nonblank(c, "ord").alias(c) for c in self.carry]
        monthly = rows.groupBy(self.key, "ord").agg(F.sum(F.coalesce("scan_points", F.lit(0.0))).alias("scan_points"), *last)
        self._replace(monthly, "panel", "ord", months)
        span = self.spec.width - 1
        newest = self._panel().agg(F.max("ord")).first()[0]  # from the partitions' names
        ends = sorted({e for m in months for e in range(m, m + span + 1) if e <= newest})
        reach = self._panel().filter(F.col("ord").isin(sorted({m for e in ends for m in range(e - span, e + 1)})))
        built = windows.sliding(reach.select(self.key, "ord", "scan_points"), self.key, spec=self.spec).withColumn("window_end", F.col("start") + span)
        self._replace(built.filter(F.col("window_end").isin(ends)), "windows", "window_end", ends)
        return ends

    def windows(self) -> DataFrame:
        """What `windows.build` gives for the whole panel."""
        key = self._panel().schema[self.key].dataType.simpleString()  # there may be no window yet to tell it
        held = self.spark.read.schema(f"`{self.key}` {key}, start int, {', '.join(f'{s} double' for s in self._steps())}").parquet(f"{self.path}/windows")
        if self.carry:
            values = self._panel().groupBy(self.key).agg(*(windows.last_nonblank(c, "ord").alias(c) for c in self.carry))
            held = held.join(values, self.key, "left")
        return windows.derive(held.select(self.key, *self.carry, "start", *self._steps()), self.spec)


class EntityLayout:
    """Rows by year, each year's in the same buckets by entity, sorted in them. A scan reads a bucket's files of all years
    in one task, so sums, windows and joins by entity need no exchange. Years are replaced one by one.

    The number of buckets follows from the rows of the first year and is kept beside the table, so that a path can be
    opened again."""

    ROWS = 2_000_000

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        """schema: the other columns, as DDL, without the year."""
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.name = f"entity_layout_{uuid.uuid4().hex}"
        self.buckets: int | None = None

    def _open(self, rows: int | None) -> None:
        meta = f"{self.path}-buckets"
        if self.buckets is None:
            if not is_folder(self.spark, meta):
                if rows is None:
                    raise FileNotFoundError(f"no layout at {self.path}")
                self.spark.range(1).select(F.lit(max(8, -(-rows // self.ROWS))).alias("buckets")).write.parquet(meta)
            self.buckets = int(self.spark.read.parquet(meta).first()["buckets"])
            self.spark.sql(
                f"CREATE TABLE {self.name} ({self.key} BIGINT, {self.schema}, source_year INT) USING parquet PARTITIONED BY (source_year) "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            if is_folder(self.spark, self.path):
                self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def write(self, df: DataFrame) -> None:
        """The rows of some years, in place of what those years had. One shuffle, by bucket."""
        self._open(df.count() if self.buckets is None else None)
        columns = [c for c in self.spark.table(self.name).columns]
        out = df.select(*columns).repartition(self.buckets, self.key).sortWithinPartitions("source_year", self.key)
        mode = "spark.sql.sources.partitionOverwriteMode"  # a table's insert takes it from the session alone
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            out.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        self._open(None)
        return self.spark.table(self.name)
