"""Substring de-duplication by difference-cover anchors.

Words are runs of anything but [\\x20\\x09-\\x0D]. A window is WINDOW words of one document in a row; it is repeated if the
same words also begin somewhere in a document with a smaller doc_id. Each word that a repeated window covers goes; windows
are judged on what the documents hold at first.

COVER is a difference cover modulo PERIOD: of any two places there is a shift below PERIOD that takes both to places in
it. So two equal windows share an anchor, the WINDOW - PERIOD + 1 words at such a place, and only anchors, three of seven
places, are hashed of all text:

1. Whole copies of a document with a smaller id go first, by a digest of their words. The others are taken in blocks,
   rows that follow one another in a file; how many, so that a block has at most BLOCK_WORDS words, is measured.
2. A block deals its different anchors to buckets by hash, 32 bits of each; a bucket tells the blocks which of theirs
   are in several documents.
3. Such anchors are extended, in both directions, to all windows that hold them. A block deals these windows' 96-bit
   keys (beside those of the bucket) and their least doc_id, each key once; a bucket answers with a bit for each: whether
   another block has a smaller doc_id.
4. A block finds its repeated windows from the bits, and the words that they cover.

Chance equality of anchors costs work only. A passage that very many documents have is one entry for each block. Buckets
follow the number of words, so a bucket's size doesn't grow with the input.

A null or empty text has no words and loses none. A null doc_id is after all others and removes nothing from documents
with an id. Repeated rows with one doc_id, being of no smaller id, remove nothing from one another. Texts of any length are
whole; a block has one document at least. Empty tables give empty results. Only doc_id and text are read; `clean` keeps
the other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, cut, few, identified, look_up, table

WINDOW = 13
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Words of a block and of a bucket, about; rows of a block that are tried for it.
BLOCK_WORDS, BUCKET_WORDS = 2_000_000, 4_000_000
BLOCK_ROWS = (1024, 256, 64, 16, 4, 1)
#: What a null doc_id counts as.
LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").split()


def _read(docs: DataFrame) -> DataFrame:
    """docs (ROW_ID, doc_id, text) -> ROW_ID, doc_id, id, n_words, digest of the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
            digests = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, words), pa.int64()), pa.array(digests, pa.binary())], names=[ROW_ID, "doc_id", "n_words", "digest"])

    kinds = f"{ROW_ID} struct<file:bigint,row:bigint>, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, digest binary"
    return docs.select(ROW_ID, "doc_id", "text").mapInArrow(run, kinds).withColumn("id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))


class Text:
    """A document's words in one string, and where each begins and ends."""

    def __init__(self, raw: bytes | None):
        words = words_of(raw)
        self.n, self.joined = len(words), b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def slices(self, at: np.ndarray, words: int) -> Iterator[bytes]:
        joined = self.joined
        return (joined[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + words - 1].tolist(), strict=True))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cover, and hashes of the anchors there."""
        import xxhash

        at = np.arange(max(0, self.n - ANCHOR + 1))
        at = at[np.isin(at % PERIOD, COVER)] if self.n >= WINDOW else at[:0]
        return at, np.fromiter(map(xxhash.xxh3_64_intdigest, self.slices(at, ANCHOR)), np.uint64, len(at))

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows that hold one of these anchors, and their hashes as four 32-bit numbers each."""
        import xxhash

        edges = np.zeros(self.n + PERIOD + 1, np.int64)
        np.add.at(edges, np.maximum(anchors - PERIOD + 1, 0), 1)
        np.add.at(edges, anchors + 1, -1)
        at = np.flatnonzero(np.cumsum(edges)[: self.n - WINDOW + 1] > 0) if len(anchors) else anchors
        return at, np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.slices(at, WINDOW))), "<u4").reshape(-1, 4)

    def without(self, windows: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
        """Runs of words (first, number) that these windows cover, and the other words joined by one space."""
        edges = np.zeros(self.n + 1, np.int64)
        np.add.at(edges, windows, 1)
        np.add.at(edges, windows + WINDOW, -1)
        gone = np.cumsum(edges)[: self.n] > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [(int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2], strict=True)]
        kept, at = [], 0
        for first, number in [*spans, (self.n, 0)]:
            if first > at:
                kept.append(self.joined[self.starts[at] : self.ends[first - 1]])
            at = first + number
        return spans, b" ".join(kept)


def _dealt(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, where it is) of sorted bucket numbers."""
    begins = np.flatnonzero(np.diff(buckets, prepend=-1))
    for a, b in zip(begins, np.append(begins[1:], len(buckets)), strict=False):
        yield int(buckets[a]), slice(int(a), int(b))


def _coded(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits of a hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


_OF_BLOCK = "file bigint, block bigint, bucket int"


def _deal_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (file, block, text) -> file, block, bucket, tags, several: the different anchors of a block, or of the part of
    one that a task has, and bits that tell which are in several of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def told() -> Iterator[pa.RecordBatch]:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            parts = list(_dealt((codes >> np.uint64(32)).astype(np.int64)))
            if parts:
                n = len(parts)
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([key[0]] * n, pa.int64()), "block": pa.array([key[1]] * n, pa.int64()), "bucket": pa.array([k for k, _ in parts], pa.int32()),
                    "tags": pa.array([codes[s].astype("<u4").tobytes() for _, s in parts], pa.binary()), "several": pa.array([np.packbits(counts[s] > 1).tobytes() for _, s in parts], pa.binary())})

        for b in batches:
            for file, block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if held and ((file, block) != key or size > BLOCK_WORDS):
                    yield from told()
                    held, size = [], 0
                key = (file, block)
                own = np.unique(_coded(Text(raw).anchors()[1], buckets))
                held.append(own)
                size += len(own)
        if held:
            yield from told()

    return rows.select("file", "block", "text").mapInArrow(run, f"{_OF_BLOCK}, tags binary, several binary")


def _shared_anchors(rows: pa.Table) -> pa.Table:
    """Of a bucket: to each block those of its tags that several documents have."""
    tags = [np.frombuffer(x, "<u4") for x in rows["tags"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)).astype(bool) for x, t in zip(rows["several"].to_pylist(), tags, strict=True)]
    every = np.concatenate(tags)
    found, counts = np.unique(every, return_counts=True)
    shared = np.union1d(found[counts > 1], every[np.concatenate(several)])
    own = [t[_among(t, shared)] for t in tags]
    return pa.table([rows["file"], rows["block"], rows["bucket"], pa.array([x.astype("<u4").tobytes() for x in own], pa.binary())], names=["file", "block", "bucket", "data"]).filter(pa.array([len(x) > 0 for x in own]))


class Block:
    """The windows, in a block, that hold shared anchors: their documents' numbers, places and keys; and the different
    keys, sorted by bucket, with their least id."""

    def __init__(self, docs: pa.Table, shared: pa.Table, buckets: int):
        docs = docs.sort_by("row")
        self.rows, self.ids = docs["row"].to_pylist(), docs["id"].to_numpy()
        codes = [np.uint64(b) << np.uint64(32) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in zip(shared["bucket"].to_pylist(), shared["data"].to_pylist(), strict=True)]
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]))
        self.texts: list[Text | None] = []
        doc, place, keys = [], [], []
        for k, raw in enumerate(docs["text"].cast(pa.binary()).to_pylist()):
            text = Text(raw)
            at, hashes = text.anchors()
            at, hashes = text.windows(at[_among(_coded(hashes, buckets), known)])
            self.texts.append(text if len(at) else None)
            if len(at):
                doc.append(np.full(len(at), k))
                place.append(at)
                keys.append(hashes)
        self.doc, self.place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (doc, place))
        k = np.concatenate([np.zeros((0, 4), np.uint32), *keys])
        bucket, hi, lo = (k[:, 0] % np.uint32(buckets)).astype(np.int64), k[:, 1].astype(np.uint64) << np.uint64(32) | k[:, 2], k[:, 3]
        order = np.lexsort((self.ids[self.doc], lo, hi, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(bucket[order]) != 0) | (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)
        first = order[new]
        self.bucket, self.hi, self.lo, self.least = bucket[first], hi[first], lo[first], self.ids[self.doc[first]]
        self.of = np.empty(len(order), np.int64)  # which of the different keys a window has
        self.of[order] = np.cumsum(new) - 1


_DEALT_WINDOWS = f"{_OF_BLOCK}, hi binary, lo binary, ids binary"


def _deal_windows(buckets: int):
    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        block, parts = None, []
        if shared.num_rows and docs.num_rows:
            block = Block(docs, shared, buckets)
            parts = list(_dealt(block.bucket))
        n, of = len(parts), lambda name, kind: pa.array([getattr(block, name)[s].astype(kind).tobytes() for _, s in parts], pa.binary())
        return pa.table({
            "file": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([key[1].as_py()] * n, pa.int64()), "bucket": pa.array([k for k, _ in parts], pa.int32()),
            "hi": of("hi", "<u8"), "lo": of("lo", "<u4"), "ids": of("least", "<i8")})

    return run


def _smaller_elsewhere(rows: pa.Table) -> pa.Table:
    """Of a bucket: to each block a bit for each of its keys, whether a smaller id than its own has that key."""
    hi, lo, ids = (np.concatenate([np.frombuffer(x, kind) for x in rows[c].to_pylist()]) for c, kind in (("hi", "<u8"), ("lo", "<u4"), ("ids", "<i8")))
    order = np.lexsort((ids, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)
    least = ids[order][new][np.cumsum(new) - 1]
    smaller = np.empty(len(order), bool)
    smaller[order] = least < ids[order]
    ends = np.cumsum([len(x) // 4 for x in rows["lo"].to_pylist()])
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, ends[:-1])]
    return pa.table([rows["file"], rows["block"], rows["bucket"], pa.array(bits, pa.binary())], names=["file", "block", "bucket", "data"])


def _removed(buckets: int, digests: bool):
    schema = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))), ("kept", pa.string())])

    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        answered = told["answer"].to_numpy(zero_copy_only=False).astype(bool)
        if answered.any() and docs.num_rows:
            block = Block(docs, told.filter(pa.array(~answered)), buckets)
            bits = dict(told.filter(pa.array(answered)).select(["bucket", "data"]).to_pandas().itertuples(index=False))
            smaller = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=s.stop - s.start) for b, s in _dealt(block.bucket)]).astype(bool)
            gone = smaller[block.of] | (block.ids[block.doc] > block.least[block.of])
            doc, place = block.doc[gone], block.place[gone]
            for k, s in _dealt(doc):
                spans, kept = block.texts[k].without(place[s])
                out.append({"file": key[0].as_py(), "row": block.rows[k], "n_removed": sum(n for _, n in spans), "spans": [{"first": a, "n": n} for a, n in spans], "kept": hashlib.sha256(kept).hexdigest() if digests else kept.decode()})
        return pa.Table.from_pylist(out, schema)

    return run


def _block_rows(told: DataFrame) -> int:
    """The most of BLOCK_ROWS by which no block has over BLOCK_WORDS words, else 1."""
    for rows in BLOCK_ROWS[:-1]:
        sizes = told.groupBy(f"{ROW_ID}.file", F.floor(F.col(f"{ROW_ID}.row") / rows)).agg(F.sum("n_words").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= BLOCK_WORDS:
            return rows
    return BLOCK_ROWS[-1]


def repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """docs (ROW_ID, doc_id, text) -> ROW_ID, doc_id, n_words, n_removed, spans (of removed words: the first and how many),
    kept: the words left, joined by one space, or the SHA-256 of that; null, but in digests, where nothing goes."""
    told = cut(_read(docs), "words")
    long = told.filter(F.col("n_words") >= WINDOW)
    classes = cut(long.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "copies")
    copies = cut(look_up(long.select(ROW_ID, "id", "n_words", "digest"), classes, "digest", "size").filter("id > least").select(ROW_ID, "n_words"), "copies")
    buckets = max(1, -(-(told.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    rows = _block_rows(told)
    file, row = F.col(f"{ROW_ID}.file").alias("file"), F.col(f"{ROW_ID}.row")
    rest = docs.join(few(copies.select(ROW_ID)), ROW_ID, "left_anti").select(
        file, row.alias("row"), F.floor(row / rows).cast("bigint").alias("block"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), "text")
    by = ["file", "block"]
    shared = cut(_deal_anchors(rest, buckets).groupBy("bucket").applyInArrow(_shared_anchors, f"{_OF_BLOCK}, data binary"), "anchors")
    blocks = rest.groupBy(by)
    dealt = blocks.cogroup(shared.groupBy(by)).applyInArrow(_deal_windows(buckets), _DEALT_WINDOWS)
    answers = cut(dealt.groupBy("bucket").applyInArrow(_smaller_elsewhere, f"{_OF_BLOCK}, data binary"), "answers")
    both = shared.withColumn("answer", F.lit(False)).unionByName(answers.withColumn("answer", F.lit(True)))
    gone = blocks.cogroup(both.groupBy(by)).applyInArrow(_removed(buckets, digests), "file bigint, row bigint, n_removed bigint, spans array<struct<first:bigint,n:bigint>>, kept string")
    whole = copies.select(ROW_ID, F.col("n_words").alias("n_removed"), F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("n_words").alias("n"))).alias("spans"), F.lit(_EMPTY if digests else "").alias("kept"))
    gone = gone.select(F.struct("file", "row").alias(ROW_ID), "n_removed", "spans", "kept").unionByName(whole)
    none = F.lower(F.hex("digest")) if digests else F.lit(None).cast("string")
    return told.join(gone, ROW_ID, "left").select(
        ROW_ID, "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,n:bigint>>")).alias("spans"),
        F.coalesce("kept", none).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, in whose texts repeated passages are gone; a text that has none is as it was."""
    docs, name = identified(docs)
    found = repeats(docs.select(F.col(f"`{name}`").alias(ROW_ID), "doc_id", "text")).filter("n_removed > 0")
    both = docs.join(found.select(F.col(ROW_ID).alias(name), F.col("kept").alias(f"{name}kept")), name, "left")
    return both.withColumn("text", F.coalesce(f"{name}kept", "text")).select(*(f"`{c}`" for c in docs.columns if c != name))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = identified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return repeats(docs.withColumnRenamed(name, ROW_ID), digests=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) t(i)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
x AS (SELECT DISTINCT g.doc_id, i + k AS i FROM g JOIN m USING (s), unnest(range({WINDOW})) r(k) WHERE least < g.doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT w.doc_id, count(x.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (x.i IS NULL) AS kept FROM w LEFT JOIN x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
