"""Sharding by a k-d tree over metadata, into shards of nearly equal bytes.

A node of m shards is split where the bytes before the split are to those behind it as m // 2 to the rest, along the
dimension in which its rows are widest: size (its logarithm), language or source. Rows with equal coordinates are
ordered by their text's checksum, and then by row. Copies of a text take the least language and source among them, so
they stay in one shard, unless together they weigh over WHOLE of a shard: such a group is split where the bytes ask it.

The weighted median is found by histograms: each pass bins the rows of all nodes of a level at once (partial sums, at
most BINS rows a node reach the driver), then only the bin that holds the median is binned anew, until it weighs under
TOLERANCE of a shard or holds one row. A level of the tree is a broadcast join with its splits; none moves or writes rows. The passes are
some three a level, whatever the data's size.

A null text has no bytes; each row counts 16 bytes more. Null language or source is a value of its own. Repeated rows
are sharded each for itself; with fewer rows than shards some shards stay empty; an empty table gives an empty result.
Columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ROW_ID, cut, fresh, identified, look_up, table, with_row_id

SHARDS = 40
OVERHEAD = 16
BINS = 1024
TOLERANCE = 0.001
#: Copies of one text that weigh under this part of a shard are never parted.
WHOLE = 0.02
DIMENSIONS = ("by_size", "by_lang", "by_source")
TIES = ("by_text", "by_row")
#: Rows that are numbered by one task.
NUMBERED = 100_000


@dataclass
class Node:
    id: int
    first: int  # shard
    shards: int
    dimension: int = 0
    at: tuple[int, ...] = ()  # a row goes left if its coordinate and ties, cut to this length, are less
    kids: list[Node] = field(default_factory=list)


@dataclass
class _Search:
    """Where a node's median may lie: rows whose key begins with `fixed`, with the next column from lo to hi."""

    node: Node
    fixed: tuple[int, ...]
    lo: int | None  # not known yet
    hi: int | None
    want: float  # bytes to the left, less those before lo


def measured(docs: DataFrame) -> DataFrame:
    """docs, with ROW_ID or not, -> ROW_ID, doc_id, size, text_crc32 and the coordinates, as integers below 2**31."""
    docs = docs if ROW_ID in docs.columns else with_row_id(docs)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    part = lambda c: F.shiftright(F.xxhash64(c), 33) + F.lit(1 << 30)
    rows = docs.select(
        ROW_ID, "doc_id", size.alias("size"), crc.alias("text_crc32"),
        F.floor(F.log2(size) * F.lit(float(1 << 25))).alias("by_size"), part("lang").alias("by_lang"), part("source").alias("by_source"),
        crc.alias("by_text"), (F.shiftright(F.xxhash64(ROW_ID), 1) + F.lit(1 << 62)).alias("by_row"),
        F.xxhash64(crc, size).alias("copies"),
    )
    rows = cut(rows, "shard-rows")
    groups = rows.groupBy("copies").agg(F.count(F.lit(1)).alias("n"), F.min("by_lang").alias("l"), F.min("by_source").alias("s"))
    copies = look_up(rows, cut(groups, "shard-copies"), "copies", "n")
    return copies.withColumns({"by_lang": F.col("l"), "by_source": F.col("s")}).drop("n", "l", "s", "copies")


def _leaves(root: Node) -> list[Node]:
    return [x for kid in root.kids for x in _leaves(kid)] if root.kids else [root]


def _inner(root: Node) -> list[Node]:
    return [root, *(x for kid in root.kids for x in _inner(kid))] if root.kids else []


def _small(rows: DataFrame, of: list[tuple], schema: str) -> DataFrame:
    """A row for each node at most, so it may be broadcast."""
    return F.broadcast(rows.sparkSession.createDataFrame(of, schema))


def _coordinate(dimensions: tuple[str, ...]) -> Column:
    return F.array(*dimensions)[F.col("dimension")]


def place(rows: DataFrame, root: Node, dimensions: tuple[str, ...] = DIMENSIONS, ties: tuple[str, ...] = TIES) -> DataFrame:
    """rows with `node`, the leaf that each is in: a broadcast join with the splits of each level."""
    rows = rows.withColumn("node", F.lit(root.id).cast("long"))
    inner = _inner(root)
    for level in range(max([0, *(x.id.bit_length() for x in inner)])):
        splits = [(x.id, x.dimension, *(*x.at, None, None)[:3]) for x in inner if x.id.bit_length() == level + 1]
        at = _small(rows, splits, "node bigint, dimension int, a0 bigint, a1 bigint, a2 bigint")
        v, t, r = _coordinate(dimensions), F.col(ties[0]), F.col(ties[1])
        less = (v < F.col("a0")) | ((v == F.col("a0")) & ((t < F.col("a1")) | ((t == F.col("a1")) & (r < F.col("a2")))))
        rows = rows.join(at, "node", "left").withColumn(
            "node", F.when(F.col("a0").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(less, 0).otherwise(1))
        ).drop("dimension", "a0", "a1", "a2")
    return rows


def _searched(rows: DataFrame, searches: list[_Search], dimensions: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The rows that the searches are about, with the search's number n, and the value v that it is about."""
    of = [(s.node.id, k, s.node.dimension, len(s.fixed), *(*s.fixed, None, None)[:2], s.lo, s.hi, 1 if s.lo is None else -(-(s.hi - s.lo + 1) // BINS)) for k, s in enumerate(searches)]
    of = _small(rows, of, "node bigint, n int, dimension int, depth int, f0 bigint, f1 bigint, first bigint, last bigint, width bigint")
    v0, t, r = _coordinate(dimensions), F.col(ties[0]), F.col(ties[1])
    found = rows.join(of, "node").withColumn("v", F.when(F.col("depth") == 0, v0).when(F.col("depth") == 1, t).otherwise(r))
    inside = F.coalesce(v0 == F.col("f0"), F.lit(True)) & F.coalesce(t == F.col("f1"), F.lit(True))
    return found.filter(inside & F.coalesce(F.col("v").between(F.col("first"), F.col("last")), F.lit(True)))


def _pass(rows: DataFrame, searches: list[_Search], tolerance: float, dimensions: tuple[str, ...], ties: tuple[str, ...]) -> list[_Search]:
    """Searches that need another pass; the others' nodes get their split."""
    if new := [s for s in searches if s.lo is None]:
        for r in _searched(rows, new, dimensions, ties).groupBy("n").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            new[r["n"]].lo, new[r["n"]].hi = r["lo"], r["hi"]
    sums = _searched(rows, searches, dimensions, ties).groupBy("n", F.expr("(v - first) div width").alias("bin")).agg(
        F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    again = []
    for k, s in enumerate(searches):
        before, found = 0, sorted((r for r in sums if r["n"] == k), key=lambda r: r["lo"])
        for r in found:
            if before + r["w"] > s.want or r is found[-1]:
                break
            before += r["w"]
        rest, one = s.want - before, r["lo"] == r["hi"]
        light = tolerance if not one or not s.fixed else tolerance / TOLERANCE * WHOLE  # there the rows are copies
        if r["rows"] == 1 or r["w"] <= light or one and len(s.fixed) == len(ties):
            s.node.at = (*s.fixed, r["lo"] if rest < r["w"] / 2 else r["hi"] + 1)
        elif one:  # its rows are told apart by the next column
            again.append(_Search(s.node, (*s.fixed, r["lo"]), None, None, rest))
        else:
            again.append(_Search(s.node, s.fixed, r["lo"], r["hi"], rest))
    return again


def tree(rows: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, ties: tuple[str, ...] = TIES) -> Node:
    """The k-d tree of rows, which have size, the dimensions and the ties as long columns."""
    root = Node(1, 0, shards)
    whole: list[float] = []
    while True:
        open_nodes = {x.id: x for x in _leaves(root) if x.shards > 1}
        placed = place(rows, root, dimensions, ties)
        ends = [f(c).alias(f"{name}{k}") for k, c in enumerate(dimensions) for name, f in (("lo", F.min), ("hi", F.max))]
        searches, tolerance = [], math.inf
        for r in placed.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect() if open_nodes else []:
            if (node := open_nodes.get(r["node"])) is None:
                continue
            wide = [r[f"hi{k}"] - r[f"lo{k}"] for k in range(len(dimensions))]
            whole = whole or [max(1, x) for x in wide]
            node.dimension = max(range(len(dimensions)), key=lambda k: wide[k] / whole[k])  # noqa: B023
            tolerance = min(tolerance, TOLERANCE * r["w"] / node.shards)
            searches.append(_Search(node, (), r[f"lo{node.dimension}"], r[f"hi{node.dimension}"], r["w"] * (node.shards // 2) / node.shards))
        if not searches:
            return root
        while searches:
            searches = _pass(placed, searches, tolerance, dimensions, ties)
        for node in open_nodes.values():
            if node.at:
                left = node.shards // 2
                node.kids = [Node(2 * node.id, node.first, left), Node(2 * node.id + 1, node.first + left, node.shards - left)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs -> ROW_ID, doc_id, size, text_crc32, shard, slot."""
    rows = cut(measured(docs), "shard-points")
    root = tree(rows, shards)
    total = rows.count()
    first = _small(rows, [(x.id, x.first) for x in _leaves(root)], "node bigint, shard int")
    placed = place(rows, root).join(first, "node").select(ROW_ID, "doc_id", "size", "text_crc32", "shard").withColumn(
        "__piece", F.pmod(F.xxhash64(ROW_ID), F.lit(max(1, math.ceil(total / NUMBERED)))))
    # a shard's rows are numbered piece by piece; a piece has some NUMBERED rows over all shards
    pieces = placed.groupBy("shard", "__piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1))
    begins = pieces.select("shard", "__piece", F.coalesce(before, F.lit(0)).alias("begin"))
    row = F.row_number().over(W.partitionBy("shard", "__piece").orderBy(ROW_ID))
    return placed.withColumn("__row", row).join(begins, ["shard", "__piece"]).select(
        ROW_ID, "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("__row") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs, with all their columns, written by shard: a column more, `shard`, or `shard_` where that name is taken."""
    docs, name = identified(docs)
    own = fresh(docs, "shard")
    placed = shard(docs.select(F.col(name).alias(ROW_ID), "doc_id", "text", "lang", "source"), shards).select(F.col(ROW_ID).alias(name), F.col("shard").alias(own))
    docs.join(placed, name).drop(name).write.partitionBy(own).parquet(path)


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
