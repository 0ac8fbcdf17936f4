"""Exact de-duplication with a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row for each distinct text. New data is grouped by
digest with partial aggregation (a hot group of copies shrinks to a row per task before the shuffle), anti-joined with
the index by sort-merge, without a shuffle of the index, and what is new is appended.

Texts are equal when identical after deletion of the characters [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts
the row with the most code points stays, then the smallest doc_id (null last), then the first by file and place. Repeated rows
are copies like any others. An empty table gives an empty result. Only doc_id and text are read; other columns, whatever
their names, pass through `deduplicate` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import is_folder

from .common import ROW_ID, cut, identified, look_up, new_path, table, without

#: Buckets of an index at least, and rows that a bucket is meant for.
BUCKETS, BUCKET_ROWS = 24, 2_000_000


def normalised(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """docs (with ROW_ID) -> ROW_ID, doc_id, digest, n_points."""
    return docs.select(
        ROW_ID, "doc_id",
        F.unhex(F.sha2(normalised("text").cast("binary"), 256)).alias("digest"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """rows of `digests` -> digest, group_size, keep_id, keep_row."""
    first = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", ROW_ID))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("s")).select(
        "digest", "group_size", F.col("s.doc_id").alias("keep_id"), F.col(f"s.{ROW_ID}").alias("keep_row"))


class DigestIndex:
    """Digests seen so far, at `path` in a store that all executors share: bucketed and sorted by digest.

    Opening a path again, in another session too, finds what was appended, and the number of buckets, which is written
    beside the index when it is begun: `buckets`, or as many as `rows` that are to come want.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 0):
        self.spark, self.name = spark, f"digest_index_{uuid.uuid4().hex}"
        meta = f"{path.rstrip('/')}-buckets"
        if not is_folder(spark, meta):
            spark.range(1).select(F.lit(buckets or max(BUCKETS, -(-rows // BUCKET_ROWS))).alias("buckets")).write.parquet(meta)
        buckets = spark.read.parquet(meta).first()["buckets"]
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, group_size BIGINT, keep_id BIGINT, keep_row STRUCT<file: BIGINT, row: BIGINT>, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Those of groups whose digest the index lacks: a sort-merge anti-join."""
        return groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Appends groups, none of which the index may have. Each bucket is written by one task."""
        out = groups.select("digest", "group_size", "keep_id", "keep_row", F.lit(batch).alias("batch"))
        out.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def mark_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs (with ROW_ID) -> ROW_ID, doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.

    Against an index that knows a text already, none of its rows in docs is kept, and keep_id is the one in the index.
    Without an index, a new one is begun, which is removed when the session ends.
    """
    spark = docs.sparkSession
    batch = batch or uuid.uuid4().hex
    rows = cut(digests(docs), "digests")
    index = index or DigestIndex(spark, new_path(spark, "digest-index"), rows=rows.count())
    index.append(index.unseen(groups_of(rows)), batch)
    own = F.col("batch") == batch
    sizes = groups_of(rows).select("digest", F.col("group_size").alias("here"))
    known = index.rows().join(sizes, "digest").select(
        "digest", "here", "keep_id", "keep_row", own.alias("own"), F.when(own, F.col("group_size")).otherwise(F.col("group_size") + F.col("here")).alias("group_size"))
    return look_up(rows, cut(known, "digest-groups"), "digest", "here").select(
        ROW_ID, "doc_id", "keep_id", "group_size",
        (F.col("own") & (F.col("keep_row") == F.col(ROW_ID))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs, name = identified(docs)
    return without(docs, name, mark_copies(docs.select(F.col(f"`{name}`").alias(ROW_ID), "doc_id", "text"), index).filter("not kept"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = identified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return mark_copies(docs.withColumnRenamed(name, ROW_ID)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
