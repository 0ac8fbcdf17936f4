"""What the training-data operators share: tables, row ids, written cuts, lookups that stand a hot key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import new_path, shared_dir  # noqa: F401
from tidemark.sources.shared import written as cut

ROW_ID = "__row_id"
#: A group with more than this share of all rows is hot. At most HOT_GROUPS groups can be, whatever the data.
HOT_GROUPS = 1024
#: So many ids at most are broadcast to a scan (some 64 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; else workers that go on to the next stage keep
    what the largest batch of an earlier one took."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library has none
        pass


def in_slices(texts: pa.Array, rows: int = 256) -> Iterator[list[str | None]]:
    """Texts some at once, so that no worker holds all of a batch as Python's strings beside it."""
    for begin in range(0, len(texts), rows):
        yield texts.slice(begin, rows).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if there are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one column more, and its name: a struct that names the same row however often and in whatever splits
    the table is read. It is the row's file and place in it, where docs is a table of files; another frame is written
    once with its numbers."""
    name = fresh(docs, ROW_ID)
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))), name
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return cut(docs.withColumn(name, number), "numbered"), name


def without(docs: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """The rows of docs (with an id of `identified` in column `name`) but those that dropped (a frame of ROW_ID) names,
    without that column. Few ids are broadcast, so that the texts aren't shuffled."""
    gone = few(cut(dropped.select(F.col(ROW_ID).alias(name)), "dropped"))
    return docs.join(gone, name, "left_anti").drop(name)


def with_row_id(df: DataFrame) -> DataFrame:
    """df with ROW_ID, which tells even repeated rows apart. It depends on how a scan is split, which
    may change with the cores there are when it is read again: where the ids are used by more than one job, take
    identified."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of an id as text; null stays null."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary"))


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their group. groups has each key once, and its number of rows in `size`.

    A group of more than a HOT_GROUPS-th of all rows is joined by broadcast: there are fewer than HOT_GROUPS of them,
    by their sizes' sum. So no task gets a hot key's rows; the rest is an ordinary join.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = total // HOT_GROUPS + 1
    hot = groups.filter(F.col(size) > least)
    mark = hot.select(key, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(mark), key, "left")
    few = marked.filter("__hot").drop("__hot").join(F.broadcast(hot), key)
    rest = marked.filter("__hot is null").drop("__hot").join(groups.filter(F.col(size) <= least), key)
    return few.unionByName(rest)


def crc32_sql(text: str) -> tuple[str, str]:
    """DuckDB SQL for crc32 of an expression's UTF-8: a common table expression, and the expression, for a FROM that has
    crc_table beside its rows. The table of the 256 remainders follows from the polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: {step}) AS v FROM range(256) r(i)))"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda j: CAST('0x' || substr(hex(encode({text})), CAST(2 * j + 1 AS INT), 2) AS BIGINT))"
    reduced = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(crc_table.t[(xor(c, b) & 255) + 1], c >> 8))"
    return table, f"xor({reduced}, 4294967295)"
