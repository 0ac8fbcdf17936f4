"""N-gram Jaccard self-join by prefixes under several global orders.

A document's set is its different shingles of five words. Under any global order of shingles, two sets whose Jaccard
similarity is at least t = 0.8 have one in common among the first n - ceil(t n) + 1 of each, and k among the first
n - ceil(t n) + k. So a pair is a candidate only if it shares prefix shingles under each of three orders:

1. By a hash, with k a quarter of the set: a document goes on only if it shares as many shingles of this prefix with
   any others as it would have to share with one that it links with. That leaves some tenth of ordinary text.
2. Rarest first, of what the documents that went on share: a shingle that no other of them has can't be in common, so
   it is left out of the prefix, and passages that many have come last. Pairs come from these prefixes.
3. By another hash: of the pairs, those whose prefixes meet under this order as well are verified on the shared sets.

In all orders the shingles of over a HEAVY-th of all documents come last (of the MOST_HEAVY most frequent ones; what is
not among these is in under a MOST_HEAVY-th of all postings). Orders only decide how much is compared; links are exact.

Documents with equal sets, by a signature of 128 bits, are one class. Its number is the first 64 of them; of classes that
share these, all but one get another number, which tasks are told. Some n * n / 2^65 of n classes do: few, whatever n.

Pairs of a group, the classes that have a prefix shingle, aren't listed at
once. First each is compared with one, the group's center; links join classes into components. Then, in groups of
several components, the members outside the largest are compared with the members of other components, in blocks of at
most SIDE. A pair is left out only if its ends are in one component already, if the sizes of their sets and of their
shared parts rule a link out, or if 1024 bits of parity tell that the sets differ in too many places. So the components
are those of all links. All of it is a fixed number of steps but for the connected components, whose rounds grow with
the logarithm of the longest path.

With fewer than five words the whole sequence is the one shingle. A document without words, or a null text, has an empty
set, links with nothing and stays. Repeated rows link like other copies. An empty table gives an empty result. Only
doc_id and text are read; `one_of_each` keeps the other columns, whatever their names. Its kept row is the one with the
least doc_id (null last), then the first by file and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_IDS, ROW_ID, cut, few, identified, look_up, release, table, without
from .components import components
from .text import word_keys

WORDS = 5
HEAVY, MOST_HEAVY = 1000, 1 << 18
#: Shingles of a block of documents.
BLOCK = 1_000_000
#: Members of a group that one key of the comparison holds, and pairs that one copy of a set is compared for.
SIDE, ASKED = 256, 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text, sorted."""
    k = word_keys(text).view(np.uint64)
    if not len(k):
        return np.zeros(0, np.int64)
    n = min(WORDS, len(k))
    s = np.full(len(k) - n + 1, n, np.uint64)
    for j in range(n):
        s = (s ^ (s >> np.uint64(29))) * _MIX[0] + k[j : len(k) - n + 1 + j]
    return np.unique((s ^ (s >> np.uint64(32))).view(np.int64))


def least_common(n: int) -> int:
    """What a set of n has in common, at least, with one that it links with: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def prefix_length(n: int, shared: int = 1) -> int:
    """How many of n shingles, in any order, hold the first `shared` of those in common with one that links."""
    return n - least_common(n) + shared


def quarter(n: int) -> int:
    return (n + 3) // 4


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Numbers:
    """The numbers of classes. bits: of a number at first. moved: other numbers, by signature."""

    def __init__(self, bits: int = 64):
        self.bits = bits
        self.moved: dict[bytes, int] = {}

    def __call__(self, sig: bytes) -> int:
        found = self.moved.get(sig)
        return int.from_bytes(sig[:8], "little", signed=True) >> (64 - self.bits) if found is None else found

    def move(self, sig: bytes, times: int) -> None:
        self.moved[sig] = int.from_bytes(hashlib.blake2b(sig, digest_size=8, salt=times.to_bytes(8, "little")).digest(), "little", signed=True)

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (c, sig) with c as it is now."""
        if not self.moved:
            return rows
        new = rows.sparkSession.createDataFrame(list(self.moved.items()), "sig binary, moved bigint")
        return rows.join(F.broadcast(new), "sig", "left").withColumn("c", F.coalesce("moved", "c")).select(*rows.columns)


class Order:
    """What global orders have in common: the heavy shingles, by their number."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray):
        self.heavy = heavy[np.argsort(heavy)]
        rank = np.empty(len(heavy), np.uint64)
        rank[np.lexsort((heavy, counts))] = np.arange(1, len(heavy) + 1, dtype=np.uint64)
        self.rank = rank[np.argsort(heavy)]

    def is_heavy(self, s: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(s), bool)
        return self.heavy[np.minimum(np.searchsorted(self.heavy, s), len(self.heavy) - 1)] == s

    def sort(self, s: np.ndarray, which: int, number: np.ndarray | None = None) -> np.ndarray:
        """s in order `which`: by number, if given, then by the order's hash; heavy ones last, by their rank."""
        key = (s.view(np.uint64) * _MIX[which]) >> np.uint64(25)
        heavy = self.is_heavy(s)
        major = np.zeros(len(s), np.uint64) if number is None else number.astype(np.uint64)
        if heavy.any():
            major[heavy] = (np.uint64(1) << np.uint64(63)) + self.rank[np.searchsorted(self.heavy, s[heavy])]
        return s[np.lexsort((s, key, major))]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows some hundred at once, without their last column, the text, and the sets."""
    for b in batches:
        for begin in range(0, b.num_rows, 256):
            part = b.slice(begin, 256)
            yield part.select(range(b.num_columns - 1)), [shingles(x) for x in part.column(b.num_columns - 1).to_pylist()]
    release()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64))


def _read(docs: DataFrame, numbers: Numbers) -> DataFrame:
    """docs (any columns, then text) -> these columns, n, c and sig of a row's set; and, in other rows, shingles s that
    may be heavy, and how many rows of a block have them: what is in over a HEAVY-th of all is so in some block."""
    own = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, kinds = [], 0, []

        def counted() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(block), return_counts=True)
            at = n >= max(2, len(block) // HEAVY)
            nulls = [pa.nulls(int(at.sum()), k) for k in [*kinds, pa.int64(), pa.int64(), pa.binary()]]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(s[at]), pa.array(n[at])], names=[*own, "n", "c", "sig", "s", "times"])

        for rows, sets in _texts(batches):
            kinds = rows.schema.types
            sigs = [signature(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(map(numbers, sigs), pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*own, "n", "c", "sig", "s", "times"])
            block += sets
            held += sum(map(len, sets))
            if held > BLOCK:
                yield counted()
                block, held = [], 0
        if block:
            yield counted()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{schema}, n bigint, c bigint, sig binary, s bigint, times bigint")


def _heavy(read: DataFrame) -> Order:
    least = max(2, read.filter("c is not null").count() // HEAVY)
    counts = read.filter("s is not null").groupBy("s").agg(F.sum("times").alias("n")).filter(F.col("n") >= least)
    heavy = counts.orderBy(F.desc("n"), "s").limit(MOST_HEAVY).toPandas()
    return Order(heavy["s"].to_numpy(np.int64), heavy["n"].to_numpy(np.int64))


def _sharing(docs: DataFrame, order: Broadcast, numbers: Numbers) -> DataFrame:
    """c of the classes that share enough of their longer prefix under the first order. A shingle's postings (s, c, want)
    meet by its hash; heavy ones, which others have anyway, are counted where they are, so no posting is of these.
    A class that wants no more gives a posting of its own beside them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for _, sets in _texts(batches):
            found, cs, wants = [], [], []
            for s in sets:
                n = len(s)
                c = numbers(signature(s)) if n else None
                if c is None or c in told:
                    continue
                if len(told) > 1_000_000:
                    told.clear()  # then a copy's postings are told again, and counted once
                told.add(c)
                prefix = order.value.sort(s, 0)[: prefix_length(n, quarter(n))]
                light = prefix[~order.value.is_heavy(prefix)]
                want = quarter(least_common(n)) - (len(prefix) - len(light))
                found.append(light if want > 0 else np.append(light, c))
                cs.append(np.full(len(found[-1]), c, np.int64))
                wants.append(np.full(len(found[-1]), want, np.int32))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, cs, wants)], names=["s", "c", "want"])

    postings = docs.select("text").mapInArrow(emit, "s bigint, c bigint, want int")
    # copies of a class, told by several tasks, are one
    w = W.partitionBy("s")
    shared = postings.withColumns({"lo": F.min("c").over(w), "hi": F.max("c").over(w)}).filter("lo <> hi or want <= 0")
    return shared.groupBy("c").agg(F.count_distinct("s").alias("shared"), F.min("want").alias("want")).filter("shared >= want").select("c")


#: 1024 bits of parity.
BITS = tuple(f"b{k}" for k in range(16))


def parity(s: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit. Two sets' bits differ in no more places than the sets have shingles apart, so many
    pairs that can't link are told from these alone."""
    at = (s.view(np.uint64) * _MIX[1]) >> np.uint64(54)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view(np.int64)


def _whole_sets(docs: DataFrame, wanted: DataFrame, order: Broadcast, numbers: Numbers) -> DataFrame:
    """c, n, light and heavy, a class's set, of texts whose hash wanted (th) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for _, sets in _texts(batches):
            new = {numbers(signature(s)): s for s in sets if len(s)}
            new = {c: s for c, s in new.items() if c not in told}
            if len(told) > 1_000_000:
                told.clear()
            told.update(new)
            heavy = [order.value.is_heavy(s) for s in new.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.int64()), pa.array([len(s) for s in new.values()], pa.int64()), _lists([s[~h] for s, h in zip(new.values(), heavy, strict=True)]), _lists([s[h] for s, h in zip(new.values(), heavy, strict=True)])],
                names=["c", "n", "light", "heavy"],
            )

    texts = docs.select(F.xxhash64("text").alias("th"), "text").join(few(wanted), "th", "left_semi").select("text")
    return texts.mapInArrow(run, "c bigint, n bigint, light array<bigint>, heavy array<bigint>").dropDuplicates(["c"])


def _ranked(sets: DataFrame, order: Broadcast) -> DataFrame:
    """sets -> c, n, q, shared, two, three, BITS: the shingles that others of sets have too, q of them; prefixes under
    the second and third order; parity. Of the classes that share enough of their whole sets."""
    w = W.partitionBy("s")
    numbered = sets.select("c", F.explode("light").alias("s")).withColumn("df", F.count(F.lit(1)).over(w)).filter("df > 1")
    lists = numbered.groupBy("c").agg(F.collect_list(F.struct("s", "df")).alias("x"))
    none = F.array().cast("array<bigint>")
    both = sets.select("c", "n", "heavy").join(lists, "c", "left").select("c", "n", "heavy", F.coalesce("x.s", none).alias("light"), F.coalesce("x.df", none).alias("df"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            bits = []
            columns = [b.column(0).to_pylist(), b.column(1).to_pylist(), *([x.values.to_numpy(zero_copy_only=False) for x in b.column(k)] for k in (2, 3, 4))]
            for c, n, heavy, light, df in zip(*columns, strict=True):
                q = len(heavy) + len(light)
                if q < least_common(n):
                    continue
                s, number = (np.concatenate(x).astype(np.int64) for x in ((light, heavy), (df, np.zeros(len(heavy)))))
                length = q - least_common(n) + 1
                for x, y in zip(out, (c, n, q, np.sort(s), order.value.sort(s, 1, number)[:length], order.value.sort(s, 2)[:length]), strict=True):
                    x.append(y)
                bits.append(parity(s))
            if bits:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *map(_lists, out[3:]), *map(pa.array, np.stack(bits, 1))], names=["c", "n", "q", "shared", "two", "three", *BITS])

    schema = "c bigint, n bigint, q bigint, shared array<bigint>, two array<bigint>, three array<bigint>, " + ", ".join(f"{x} bigint" for x in BITS)
    return both.mapInArrow(run, schema)


def _may_link(n1: Column, q1: Column, n2: Column, q2: Column) -> Column:
    """100 common >= 80 union is 9 common >= 4 (n1 + n2), and what is in common is in both shared parts."""
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * F.least(q1, q2) >= 4 * (n1 + n2))


def _beside(pairs: DataFrame, end: str, other: str, rows: DataFrame, columns: list[str], many: DataFrame | None) -> DataFrame:
    """pairs with columns of the class at `end`. A class that is in many pairs (one of `many`, by end) has a copy for each
    ASKED of them, so no task gets all of its pairs."""
    held = rows.select(F.col("c").alias(end), *(F.col(x).alias(f"{x}_{end}") for x in columns))
    if many is None:
        return pairs.join(held, end)
    own = many.filter(F.col("end") == end).select(F.col("c").alias(end), F.ceil(F.col("size") / ASKED).alias("copies"))
    dealt = pairs.join(own, end, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("copies")), F.lit(0).cast("long"))).drop("copies")
    held = held.join(own, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1))).drop("copies")
    return dealt.join(held, [end, "part"]).drop("part")


def _many(pairs: DataFrame) -> DataFrame | None:
    """end, c, size of the classes that are in over ASKED of the written pairs at an end; None if none is. Fewer than
    BROADCAST_IDS, by their sizes' sum; of more pairs those stay as one that have under a BROADCAST_IDS-th of all ends. One
    plan for both ends, and no more where no class is in many: each plan that runs leaves the driver something to keep."""
    least = max(ASKED, 2 * pairs.count() // BROADCAST_IDS)
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("end"), F.col(x).alias("c")) for x in ("a", "b"))))
    sizes = pairs.select(sides.alias("x")).groupBy("x.end", "x.c").agg(F.count(F.lit(1)).alias("size"))
    many = cut(sizes.filter(F.col("size") > least), "asked")
    return None if many.isEmpty() else F.broadcast(many)


def _linked(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that link: first those whose prefixes under the third order meet, then by what the sets have
    in common."""
    met, many = pairs, _many(pairs)
    for end, other in (("a", "b"), ("b", "a")):
        met = _beside(met, end, other, ranked, ["three"], many)
    met = cut(met.filter(F.arrays_overlap("three_a", "three_b")).select("a", "b"), "candidates")
    # of fewer pairs a class has no more than before
    many = _many(met) if many is not None else None
    for end, other in (("a", "b"), ("b", "a")):
        met = _beside(met, end, other, ranked, ["n", "shared"], many)
    return cut(met.filter(9 * F.size(F.array_intersect("shared_a", "shared_b")) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "links")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _components_of(ranked: DataFrame) -> DataFrame:
    """ranked -> c, component of the classes that link with any."""
    postings = ranked.select(F.explode("two").alias("s"), "c", "n", "q")
    # of each group one is the center, the same in all groups that have it and no prior one
    prior = F.struct(F.xxhash64("c").alias("h"), "c", "n", "q")
    groups = cut(postings.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min(prior).alias("m")).filter("size > 1"), "groups")
    met = look_up(postings, groups, "s", "size").filter(F.col("c") != F.col("m.c"))
    pairs = cut(met.filter(_may_link(F.col("n"), F.col("q"), F.col("m.n"), F.col("m.q"))).select(*_ordered("c", "m.c")).distinct(), "pairs")
    first = components(_linked(pairs, ranked).withColumnsRenamed({"a": "u", "b": "v"})).select(F.col("node").alias("c"), F.col("label").alias("component"))
    label = cut(ranked.select("c").join(first, "c", "left").select("c", F.coalesce("component", "c").alias("component")), "labels")
    # groups of several components; of groups with the same members, one is enough
    members = cut(ranked.select("c", F.explode("two").alias("s")).join(label, "c"), "members")
    by = members.groupBy("s", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c")).alias("who"))
    mixed = by.groupBy("s").agg(F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.bit_xor("who").alias("who"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    mixed = cut(mixed.groupBy("size", "who", "largest").agg(F.min("s").alias("s")), "mixed")
    held = cut(look_up(members, mixed.drop("who"), "s", "size"), "held")
    held = held.join(ranked.select("c", "n", "q", *BITS), "c")
    parts = F.ceil(F.col("size") / SIDE)
    named = lambda x, k: x.select(*(F.col(y).alias(f"{y}{k}") for y in ("s", "part", "c", "component", "n", "q", "outside", *BITS)))
    held = held.withColumn("outside", F.col("component") != F.col("largest"))
    right = named(held.withColumn("part", F.pmod(F.xxhash64("c"), parts)), 2)
    left = named(held.filter("outside").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), 1)
    apart = sum((F.bit_count(F.col(f"{b}1").bitwiseXOR(F.col(f"{b}2"))) for b in BITS), F.lit(0))
    apart = apart + F.expr("(n1 - q1) + (n2 - q2)")
    on = (F.col("s1") == F.col("s2")) & (F.col("part1") == F.col("part2")) & (F.col("component1") != F.col("component2")) & (~F.col("outside2") | (F.col("c1") < F.col("c2")))
    # 9 common >= 4 (n1 + n2) is the same as 9 (those of one set alone) <= n1 + n2
    on = on & _may_link(F.col("n1"), F.col("q1"), F.col("n2"), F.col("q2")) & (9 * apart <= F.col("n1") + F.col("n2"))
    pairs = cut(left.join(right, on).select(*_ordered("c1", "c2")).distinct(), "pairs")
    links = _linked(pairs, ranked)
    of = lambda x, k: label.select(F.col("c").alias(x), F.col("component").alias(k))
    moved = components(links.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v")).select(F.col("node").alias("component"), "label")
    return label.join(moved, "component", "left").select("c", F.coalesce("label", "component").alias("component"))


def _classes(some: DataFrame, numbers: Numbers, own: list[str]) -> DataFrame:
    """The classes of rows that have words: c, size, first, th. Those that have one number get others in `numbers`."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), *reversed(own))
    for times in count(1):
        rows = numbers.apply(some)
        classes = cut(rows.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min(first).alias("first"), F.min("th").alias("th"), F.min("sig").alias("sig"), F.max("sig").alias("sig2")), "classes")
        shared = classes.filter("sig <> sig2").select("c")
        if shared.isEmpty():
            return classes
        kept: set[int] = set()
        for c, sig in rows.join(F.broadcast(shared), "c").select("c", "sig").distinct().orderBy("c", "sig").collect():
            if c in kept:
                numbers.move(bytes(sig), times)
            kept.add(c)


def near_copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """docs (doc_id, text; ROW_ID too, if it is to be told which row stays) -> doc_id, n_shingles, component_id (the least
    doc_id of its component); with ROW_ID, that and kept (its row, the first of those with that id). bits: of a class's
    number at first; fewer than 64 only try out what numbers that are shared do."""
    spark = docs.sparkSession
    release()  # on the driver too, which may have fitted models before
    own = [c for c in (ROW_ID, "doc_id") if c in docs.columns]
    docs = docs.select(*own, "text")
    numbers = Numbers(bits)
    read = cut(_read(docs.select(*own, F.xxhash64("text").alias("th"), "text"), numbers), "shingles")
    rows = read.filter("c is not null")
    classes = _classes(rows.filter("n > 0"), numbers, own)
    some = numbers.apply(rows.filter("n > 0"))
    order = spark.sparkContext.broadcast(_heavy(read))
    wanted = cut(classes.select("c", "th").join(_sharing(docs, order, numbers), "c", "left_semi").select("th"), "wanted")
    sets = cut(_whole_sets(docs, wanted, order, numbers), "sets")
    ranked = cut(_ranked(sets, order), "ranked")
    order.destroy()
    label = _components_of(ranked)
    placed = cut(classes.join(label, "c", "left").select("c", "size", "first", F.coalesce("component", "c").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    answers = cut(placed.join(least, "component").select("c", "size", "least"), "components")
    told = look_up(some.select(*own, "n", "c"), answers, "c", "size")
    out = ["doc_id", F.col("n").alias("n_shingles")]
    ids = [ROW_ID] if ROW_ID in own else []
    kept = [(F.col(ROW_ID) == F.col(f"least.{ROW_ID}")).alias("kept")] if ids else []
    alone = rows.filter("n = 0").select(*ids, *out, F.col("doc_id").alias("component_id"), *([F.lit(True).alias("kept")] if ids else []))
    return told.select(*ids, *out, F.col("least.doc_id").alias("component_id"), *kept).unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns."""
    docs, name = identified(docs)
    return without(docs, name, near_copies(docs.select(F.col(f"`{name}`").alias(ROW_ID), "doc_id", "text")).filter("not kept"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
