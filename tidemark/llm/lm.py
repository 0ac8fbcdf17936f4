"""Language model scoring by Katz backoff.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, then one end. Order two: P(w | h) is
d_r r / c(h) for a pair seen r times in training, with Good-Turing discount d_r, else alpha(h) P(w); P(w) is the
Good-Turing discounted unigram, whose left mass goes to the unknown word. alpha(h) is exact: the left mass of h over the
unigram mass of the words not seen behind h. So for any h the chances of all V words and the unknown one sum to one.

Pairs are counted over all words. The at most DICTIONARY most frequent words are broadcast with their counts, which bounds
no statistics, only what has a short name: pairs of two such words are counted in blobs, by ids, dealt by history to parts
of about PART tokens (a history that would fill an eighth of one by pair); the other pairs are rows, by the keys of both
words, joined with what their words and histories have. A block of documents is scored in two steps: what the broadcast
tables tell (dictionary words, and the fewer than HOT pairs that each make up over a HOT-th of all) is summed where the
text is; for the other tokens, sorted keys and the documents that have them go to the keys' parts, and only sums by
document come back. So no hot word or pair meets in one task. (`fit` with a `dictionary` gives a class model instead: pairs
over that many words, all others as one class. No query asks for it.)

A null text is empty: one end. A null doc_id is not held out and not learned from. Without training rows, N is 0, every
token is unknown and the score is the base score. Repeated rows are scored each for itself; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import new_path, remove

from .common import ROW_ID, cut, id_crc, table, with_row_id
from .pack import parts_of, spread, squeeze
from .text import word_codes

#: Words that are broadcast, with three numbers of each: some 50 MB at most.
DICTIONARY = 2**20 - 3
HOT = 65_536
PART = 2_000_000
#: Tokens of a block, which may have more only in one slice; bytes of text that are cut into words at once.
BLOCK, SLICE = 1_000_000, 2_000_000
RARE, END, START, FIRST = 0, 1, 2, 3
START_KEY, END_KEY = 0, 1
CUTOFF = 5
_PAIR = np.int64(1) << np.int64(20)
#: A rare word's key: negative, so that no pair has it.
_RARE_BIT = np.int64(-(2**63))
_RARE_PAIR = np.int64(2**62)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of b with successive row ids and at most SLICE bytes of text and ends, or one row."""
    row = b.column(0).to_numpy()
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False) + np.int64(1))
    begin = 0
    for stop in [*(np.flatnonzero(np.diff(row) != 1) + 1), len(row)]:
        while begin < stop:
            most = (ends[begin - 1] if begin else 0) + SLICE
            end = min(int(stop), max(begin + 1, int(np.searchsorted(ends, most, "right"))))
            yield b.slice(begin, end - begin)
            begin = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row id, ids of documents, token keys, place there of each token's key, tokens of each document) of rows with
    successive row ids. A key may stand there a few times."""
    first, ids, keys, places, sizes, held, known = 0, [], [], [], [], 0, 0
    for s in (s for b in batches for s in _slices(b)):
        row, docs = s.column(0)[0].as_py(), s.column(1).to_pylist()
        different, codes, n = word_codes(s.column(2))
        if ids and (held + len(codes) + len(docs) > BLOCK or row != first + len(ids)):
            yield first, ids, np.concatenate(keys), np.concatenate(places), np.concatenate(sizes)
            ids, keys, places, sizes, held, known = [], [], [], [], 0, 0
        if not ids:
            first = row
        ids += docs
        keys.append(np.append(different, END_KEY))
        places.append(np.insert(codes.astype(np.int64), np.cumsum(n), len(different)) + known)  # an end behind each text
        sizes.append(n + 1)
        held, known = held + len(places[-1]), known + len(keys[-1])
    if ids:
        yield first, ids, np.concatenate(keys), np.concatenate(places), np.concatenate(sizes)


def good_turing(n: dict[int, int], cutoff: int = CUTOFF) -> np.ndarray:
    """d[r] for counts r up to cutoff, from the numbers n[r] of things counted r times; above it, counts are kept. Where
    the counts don't give a discount between 0 and 1, half a count is taken off."""
    d = np.ones(cutoff + 1)
    common = (cutoff + 1) * n.get(cutoff + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, cutoff + 1):
        x = -1.0
        if n.get(1) and n.get(r) and n.get(r + 1) and common < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


@dataclass
class Words:
    """Unigrams: what is known of each dictionary word (by id, from FIRST on) and of counts in general."""

    keys: np.ndarray  # sorted keys of the dictionary
    ids: np.ndarray  # id of each
    counts: np.ndarray  # by id; RARE: of all other words
    total: int
    different: int
    discount: np.ndarray
    rest: float  # the unknown word's chance; 0: add one half instead of discounting

    def chance(self, c: np.ndarray) -> np.ndarray:
        """Of a word counted c times, 0: the unknown one."""
        if not self.rest:
            return (c + 0.5) / (self.total + 0.5 * (self.different + 1))
        return np.where(c > 0, self.discount[np.minimum(c, CUTOFF + 1) % (CUTOFF + 1)] * c / max(1, self.total), self.rest)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.different + 1)))

    def id_of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], RARE).astype(np.int64)


@dataclass
class Pairs:
    """By id: log10 of a word's chance and of its backoff weight; the hot pairs and what they add."""

    word: np.ndarray
    back: np.ndarray
    scale: np.ndarray  # log10 of s(h) / c(h)
    discount: np.ndarray
    hot: np.ndarray
    hot_value: np.ndarray

    def value(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of P(w | h) over alpha(h) P(w) for pairs seen in training."""
        h, w = keys >> np.int64(20), keys & (_PAIR - 1)
        d = self.discount[np.minimum(counts, CUTOFF + 1) % (CUTOFF + 1)]
        return np.log10(d * counts) + self.scale[h] - self.word[w] - self.back[h]


@dataclass
class Model:
    words: Words
    pairs: Pairs
    counts: DataFrame  # part, keys, counts, values: rare words and pairs; values, if there, are what each adds
    parts: int
    held: Broadcast  # of words and pairs
    whole: bool = False  # pairs of all words, by the keys of both


def _before(tokens: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """Of each token the one before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = start
    return before


def _pair_keys(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token with the one before it, and the ids of those before."""
    before = _before(ids, sizes, START)
    return before * _PAIR + ids, before


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key of 63 bits for a pair of word keys."""
    x = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB) + w.view(np.uint64)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(29)) >> np.uint64(1)).view(np.int64)


def _count_words(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, keys, at, _ in _blocks(batches):
            k, n = np.unique(keys[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "c"])

    return cut(train.mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")), "lm-words")


def _weights(seen: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s(h) / c(h) and alpha(h), from the count of each history, what discounts leave of it, and the unigram mass of the
    words seen behind it."""
    full = kept > seen * (1 - 1e-9)  # nothing is left: one more count makes room
    below = np.where(full, seen + 1, np.maximum(seen, 1))
    complete = lower > 1 - 1e-9  # no word is left to back off to
    below = np.where(complete, np.maximum(kept, 1e-12), below)
    return 1 / below, np.where((seen > 0) & ~complete, (1 - kept / below) / np.maximum(1 - lower, 1e-12), 1.0)


def _dictionary(counted: DataFrame, most: int) -> int:
    """The least count of a word of the dictionary, so that it has at most `most` words. Counts are told apart up to a
    ninth of their size, so this takes some hundred rows and no sort of the words."""
    step = F.floor(F.log2("c") * 8)
    sizes = counted.filter(F.col("k") != END_KEY).groupBy(step.alias("step")).agg(F.count("k").alias("n"), F.min("c").alias("least"), F.max("c").alias("top")).collect()
    held, least = 0, max((r["top"] for r in sizes), default=0) + 1
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least


def _part_of(words: Words, pairs: np.ndarray, parts: int) -> np.ndarray:
    """The part of pairs of dictionary words: one for all of a history, but for each pair its own if the history is so
    frequent that it would fill an eighth of a part."""
    h = pairs >> np.int64(20)
    return parts_of(np.where((h == START) | (words.counts[h] >= PART // 8), pairs, h), parts)


def _by_part(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part there is and where it is, in order: one sort, not a pass for each part."""
    order = np.argsort(of, kind="stable")
    there, starts = np.unique(of[order], return_index=True)
    for p, a, b in zip(there, starts, [*starts[1:], len(of)], strict=False):
        yield int(p), order[a:b]


def _add(batches: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    different, where = np.unique(np.concatenate([k for k, _ in batches]), return_inverse=True)
    return different, np.bincount(where, weights=np.concatenate([c for _, c in batches])).astype(np.int64)


def _kept(discount: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the discount leaves of counts."""
    return discount[np.minimum(c, CUTOFF + 1) % (CUTOFF + 1)] * c


def _rare_rows(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """h, w, c of a block's different pairs in which a word is not of the dictionary."""
    h, own = _before(keys, sizes, START_KEY), (ids == RARE) | (_before(ids, sizes, START) == RARE)
    h, w = h[own], keys[own]
    _, at, c = np.unique(_mixed(h, w), return_index=True, return_counts=True)
    return _counted(h=pa.array(h[at]), w=pa.array(w[at]), c=pa.array(c))


#: What a block counts: pairs of the dictionary as blobs of a part, or another pair.
_COUNTED = {"part": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "h": pa.int64(), "w": pa.int64(), "c": pa.int64()}


def _counted(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, t)) for x, t in _COUNTED.items()], names=list(_COUNTED))


def _rare_pairs(counted: DataFrame, held: Broadcast, rare: DataFrame) -> DataFrame:
    """The different pairs in which a word is not of the dictionary: h, w, known (h's id or RARE), c, lower (w's unigram
    chance). counted: h, w, c of blocks. rare: k, c of the words outside the dictionary."""

    def know(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, h, w = held.value, b["h"].to_numpy(np.int64), b["w"].to_numpy(np.int64)
            ids = words.id_of(w)
            known = np.where(h == START_KEY, START, words.id_of(h))
            yield b.assign(known=known, own=np.where(ids == RARE, np.nan, words.chance(words.counts[ids])))

    def chances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["k"], "told": held.value.chance(b["c"].to_numpy(np.int64))})

    pairs = counted.groupBy("h", "w").agg(F.sum("c").alias("c"))
    pairs = pairs.mapInPandas(know, "h bigint, w bigint, c bigint, known bigint, own double").withColumn("own", F.nanvl("own", F.lit(None)))
    # dictionary words need no lookup, so their rows, of which one word may have many, are dealt by pair
    pairs = pairs.withColumn("key", F.when(F.col("own").isNull(), F.col("w")).otherwise(F.xxhash64("h", "w")))
    told = rare.mapInPandas(chances, "key bigint, told double")
    return cut(pairs.join(told, "key", "left").select("h", "w", "known", "c", F.coalesce("own", "told").alias("lower")), "lm-rare-pairs")


def fit(train: DataFrame, dictionary: int | None = None) -> Model:
    """A model of train (doc_id, text), over pairs of all words; with a dictionary, over pairs of at most that many words
    and one class of all others."""
    spark = train.sparkSession
    whole, dictionary = dictionary is None, DICTIONARY if dictionary is None else dictionary
    if not 1 <= dictionary <= _PAIR - FIRST:
        raise ValueError("the dictionary must have 1 to 2**20 - 3 words")
    rows = with_row_id(train.select("doc_id", "text")).select(ROW_ID, "doc_id", "text")
    counted = _count_words(rows)
    total, different = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("k")).first()
    n = {r["c"]: r["n"] for r in counted.filter(F.col("c") <= CUTOFF + 1).groupBy("c").agg(F.count("k").alias("n")).collect()}
    discount = good_turing(n)
    left = sum((1 - discount[r]) * r * n.get(r, 0) for r in range(1, CUTOFF + 1)) / max(1, total)
    frequent = (F.col("k") != END_KEY) & (F.col("c") >= _dictionary(counted, dictionary))
    top = counted.filter(frequent).select("k", "c").toArrow()
    rare = counted.filter((F.col("k") != END_KEY) & ~frequent)
    ends = counted.filter(F.col("k") == END_KEY).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = np.zeros(FIRST + len(top), np.int64)
    counts[END], counts[FIRST:] = ends, top["c"].to_numpy()
    counts[RARE] = total - counts.sum()
    order = np.argsort(keys := np.append(top["k"].to_numpy(), np.int64(END_KEY)))
    words = Words(keys[order], np.append(np.arange(FIRST, len(counts), dtype=np.int32), np.int32(END))[order], counts, total, different, discount, left if left > 1e-12 else 0.0)
    parts = max(4, math.ceil(total / PART))
    held = spark.sparkContext.broadcast(words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, keys, at, sizes in _blocks(batches):
            w, keys = held.value.id_of(keys)[at], keys[at]
            k, before = _pair_keys(w, sizes)
            if whole:
                yield _rare_rows(keys, w, sizes)
                k = k[(w != RARE) & (before != RARE)]
            k, c = np.unique(k, return_counts=True)
            for p, own in _by_part(_part_of(held.value, k, parts)):
                yield _counted(part=pa.array([p], pa.int32()), keys=pa.array([squeeze(np.diff(k[own], prepend=0))], pa.binary()), counts=pa.array([squeeze(c[own])], pa.binary()))

    def add(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
        k, c = _add([(np.cumsum(spread(x, np.int64)), spread(y, np.int64)) for x, y in zip(group["keys"], group["counts"], strict=True)])
        return pd.DataFrame({"part": [key[0]], "keys": [squeeze(np.diff(k, prepend=0))], "counts": [squeeze(c)]})

    schema = "part int, keys binary, counts binary"
    # both kinds come of one pass over the texts, written until each is put together
    path = new_path(spark, "lm-counted")
    rows.mapInArrow(emit, "part int, keys binary, counts binary, h bigint, w bigint, c bigint").write.parquet(path)
    both = spark.read.schema("part int, keys binary, counts binary, h bigint, w bigint, c bigint").parquet(path)
    pairs = cut(both.filter("part is not null").select("part", "keys", "counts").groupBy("part").applyInPandas(add, schema), "lm-pairs")
    others = _rare_pairs(both.filter("part is null").select("h", "w", "c"), held, rare) if whole else None
    remove(spark, path)

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["counts"]:
                n = np.bincount(np.minimum(spread(x, np.int64), CUTOFF + 2), minlength=CUTOFF + 3)
                yield pd.DataFrame({"c": np.arange(1, CUTOFF + 2), "n": n[1 : CUTOFF + 2]})

    n2 = pairs.mapInPandas(few, "c bigint, n bigint")
    if whole:
        n2 = n2.unionByName(others.filter(F.col("c") <= CUTOFF + 1).groupBy("c").agg(F.count("h").alias("n")))
    discount2 = good_turing({r["c"]: r["n"] for r in n2.groupBy("c").agg(F.sum("n").alias("n")).collect()})
    chance = words.chance(counts)
    chance[START] = 0
    if not whole:  # what is not in the dictionary has the mass of its class
        chance[RARE] = max(1e-300, 1 - chance[1:].sum())

    def by_before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, c in zip(b["keys"], b["counts"], strict=True):
                k, c = np.cumsum(spread(keys, np.int64)), spread(c, np.int64)
                h = k >> np.int64(20)
                sums = [np.bincount(h, weights=x, minlength=len(counts)) for x in (c, _kept(discount2, c), chance[k & (_PAIR - 1)])]
                at = np.flatnonzero(sums[0])
                yield pd.DataFrame({"h": at} | {name: s[at] for name, s in zip("nkl", sums, strict=True)})

    def by_rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b["c"].to_numpy(np.int64)
            yield pd.DataFrame({"h": b["h"], "known": b["known"], "n": c.astype(np.float64), "k": _kept(discount2, c), "l": b["lower"]})

    sums = pairs.mapInPandas(by_before, "h bigint, n double, k double, l double")
    if whole:
        of_all = others.mapInPandas(by_rare, "h bigint, known bigint, n double, k double, l double").groupBy("h", "known").agg(*(F.sum(x).alias(x) for x in "nkl"))
        sums = sums.unionByName(of_all.filter(F.col("known") != RARE).select(F.col("known").alias("h"), *"nkl"))
    # a row for each word of the dictionary at most
    told = sums.groupBy("h").agg(*(F.sum(x).alias(x) for x in "nkl")).toArrow()
    seen, kept, lower = np.zeros(len(counts)), np.zeros(len(counts)), np.zeros(len(counts))
    for array, name in zip((seen, kept, lower), "nkl", strict=True):
        array[told["h"].to_numpy()] = told[name].to_numpy()
    scale, alpha = _weights(seen, kept, lower)
    if whole:  # these two are no words of the dictionary
        chance[RARE] = chance[START] = 1
    with np.errstate(divide="ignore"):
        model = Pairs(np.log10(chance), np.log10(alpha), np.log10(scale), discount2, np.zeros(0, np.int64), np.zeros(0))
    least = max(1, total) // HOT + 1

    def hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, c in zip(b["keys"], b["counts"], strict=True):
                c = spread(c, np.int64)
                own = c >= least
                yield pd.DataFrame({"k": np.cumsum(spread(keys, np.int64))[own], "c": c[own]})

    # fewer than HOT, as each is a HOT-th of all; a word outside the dictionary has no such pair
    most = pairs.mapInPandas(hot, "k bigint, c bigint").toPandas().sort_values("k")
    model.hot, model.hot_value = most["k"].to_numpy(np.int64), model.value(most["k"].to_numpy(np.int64), most["c"].to_numpy(np.int64))
    pairs = pairs.withColumn("values", F.lit(None).cast("binary"))
    held.destroy()  # what it was needed for is written
    held = spark.sparkContext.broadcast((words, model))
    if whole:
        return Model(words, model, pairs.unionByName(_rare_values(others, of_all, rare, held, discount2, parts)), parts, held, True)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, k, c, _ in _packed(_rare(b["k"].to_numpy(np.int64)), b["c"].to_numpy(np.int64), None, parts):
                yield pd.DataFrame({"part": [p], "keys": [k], "counts": [c]})

    return Model(words, model, pairs.unionByName(rare.mapInPandas(pack, schema).withColumn("values", F.lit(None).cast("binary"))), parts, held)


def _packed(k: np.ndarray, c: np.ndarray, v: np.ndarray | None, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes | None]]:
    """The part, sorted keys, counts and values of rows, for each part."""
    order = np.argsort(k)
    for p, own in _by_part(parts_of(k[order], parts)):
        at = order[own]
        yield p, squeeze(np.diff(k[at], prepend=0)), squeeze(c[at]), None if v is None else squeeze(v[at])


def _rare_values(others: DataFrame, sums: DataFrame, rare: DataFrame, held: Broadcast, discount: np.ndarray, parts: int) -> DataFrame:
    """part, keys, counts, values of the pairs and words outside the dictionary."""

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scale, alpha = _weights(*(b[x].to_numpy(np.float64) for x in "nkl"))
            with np.errstate(divide="ignore"):
                yield pd.DataFrame({"key": b["h"], "move": np.log10(scale) - np.log10(alpha), "back": np.log10(alpha)})

    histories = cut(sums.filter(F.col("known") == RARE).mapInPandas(weights, "key bigint, move double, back double"), "lm-histories")
    # histories of the dictionary are broadcast, so their rows are dealt by pair
    moved = others.withColumn("key", F.when(F.col("known") == RARE, F.col("h")).otherwise(F.xxhash64("h", "w"))).join(histories.select("key", "move"), "key", "left")

    def pack_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = held.value[1]
        for b in batches:
            h, w, known, c = (b[x].to_numpy(np.int64) for x in ("h", "w", "known", "c"))
            move = np.where(known == RARE, b["move"].to_numpy(np.float64), pairs.scale[known] - pairs.back[known])
            v = np.log10(_kept(discount, c)) - np.log10(b["lower"].to_numpy()) + move
            yield pd.DataFrame(_packed(_rare_pair(h, w), c, v, parts), columns=["part", "keys", "counts", "values"])

    def pack_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b["c"].to_numpy(np.int64)
            v = np.log10(held.value[0].chance(c)) + b["back"].fillna(0).to_numpy(np.float64)
            yield pd.DataFrame(_packed(_rare(b["k"].to_numpy(np.int64)), c, v, parts), columns=["part", "keys", "counts", "values"])

    schema = "part int, keys binary, counts binary, values binary"
    alone = rare.join(histories.select(F.col("key").alias("k"), "back"), "k", "left").select("k", "c", "back")
    return moved.select("h", "w", "known", "c", "lower", "move").mapInPandas(pack_pairs, schema).unionByName(alone.mapInPandas(pack_words, schema))


def _rare_pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key for a pair with a word outside the dictionary: over those of dictionary pairs."""
    return _mixed(h, w) | _RARE_PAIR


def _rare(keys: np.ndarray) -> np.ndarray:
    """A key of 63 bits and a sign, so that it is no pair's."""
    return keys | _RARE_BIT


SUMS = "n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> ROW_ID, doc_id and SUMS."""
    words_held, parts, whole = model.held, model.parts, model.whole
    rows = with_row_id(docs.select("doc_id", "text")).select(ROW_ID, "doc_id", "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = words_held.value
        for first, ids, keys, at, sizes in _blocks(batches):
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            w, keys = words.id_of(keys)[at], keys[at]
            pair, before = _pair_keys(w, sizes)
            own = w != RARE
            both = own & (before != RARE) if whole else np.ones(len(w), bool)
            part = _part_of(words, pair, parts)
            if whole:
                pair[~both] = _rare_pair(_before(keys, sizes, START_KEY)[~both], keys[~both])
                part[~both] = parts_of(pair[~both], parts)
            value = pairs.word[w] + pairs.back[before]
            if len(pairs.hot):
                at = np.minimum(np.searchsorted(pairs.hot, pair), len(pairs.hot) - 1)
                is_hot = pairs.hot[at] == pair
                value += np.where(is_hot, pairs.hot_value[at], 0)
            else:
                is_hot = np.zeros(len(pair), bool)
            total = lambda x: np.bincount(doc, weights=x, minlength=len(ids))
            known = total(own & (words.counts[w] > 0))
            sums = np.stack([sizes, known, total(np.where(own, words.base(words.counts[w]), 0)), total(value)])
            yield _batch({"part": [first % parts], ROW_ID: [first], "ids": [ids], "docs": [squeeze(np.arange(len(ids), dtype=np.uint32))], "sums": [squeeze(sums)]})
            k = np.concatenate([pair[~is_hot], _rare(keys[~own])])
            d = np.concatenate([doc[~is_hot], doc[~own]])
            of = np.concatenate([part[~is_hot], parts_of(_rare(keys[~own]), parts)])
            order = np.argsort(k, kind="stable")
            k, d, of = k[order], d[order], of[order]
            # only the parts that the block has: there are no more rows than tokens, however many parts there are
            for p, own in _by_part(of):
                different, n = np.unique(k[own], return_counts=True)
                yield _batch({"part": [p], ROW_ID: [first], "keys": [squeeze(np.diff(different, prepend=0))], "counts": [squeeze(n)], "docs": [squeeze(d[own])]})

    def tell(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        words, pairs = words_held.value
        k = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(spread(x, np.int64)) for x in known["keys"])])
        c = np.concatenate([np.zeros(0, np.int64), *(spread(x, np.int64) for x in known["counts"])])
        order = np.argsort(k)
        k, c = k[order], c[order]
        if whole:
            value = np.concatenate([np.zeros(0), *(np.zeros(len(spread(y, np.int64))) if x is None else spread(x, np.float64) for x, y in zip(known["values"], known["counts"], strict=True))])[order]
        else:
            value = np.log10(words.chance(np.where(k < 0, c, 1))) - pairs.word[RARE]
        pair = (k >= 0) & (k < _RARE_PAIR)
        value[pair] = pairs.value(k[pair], c[pair])
        none = float(np.log10(words.chance(np.zeros(1, np.int64)))[0] - pairs.word[RARE])
        out = []
        for x in asked.itertuples(index=False):
            if x.sums is not None:  # what a block knows of itself passes
                out.append({ROW_ID: x[1], "docs": x.docs, "sums": x.sums, "ids": x.ids})
                continue
            keys, n, docs = np.cumsum(spread(x.keys, np.int64)), spread(x.counts, np.int64), spread(x.docs, np.uint32)
            at = np.minimum(np.searchsorted(k, keys), max(0, len(k) - 1))
            hit = k[at] == keys if len(k) else np.zeros(len(keys), bool)
            is_rare = keys < 0
            v = np.where(hit, value[at] if len(k) else 0.0, np.where(is_rare, none, 0.0))
            b = np.where(is_rare, words.base(np.where(hit, c[at] if len(k) else 0, 0)), 0.0)
            add = lambda y: np.bincount(docs, weights=np.repeat(y, n))  # noqa: E731, B023
            sums = np.stack([add(np.zeros(len(keys))), add(hit & is_rare), add(b), add(v)])
            some = np.flatnonzero(sums.any(0))
            out.append({ROW_ID: x[1], "docs": squeeze(some.astype(np.uint32)), "sums": squeeze(sums[:, some]), "ids": None})
        return pd.DataFrame(out, columns=[ROW_ID, "docs", "sums", "ids"])

    def gather(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        ids = next(x for x in block["ids"] if x is not None)
        sums = np.zeros((4, len(ids)))
        for docs, x in zip(block["docs"], block["sums"], strict=True):
            sums[:, spread(docs, np.uint32)] += spread(x, np.float64).reshape(4, -1)
        return pd.DataFrame({
            ROW_ID: key[0] + np.arange(len(ids)), "doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], "Int64"),
            "n_tokens": sums[0].round().astype(np.int64), "n_known": sums[1].round().astype(np.int64), "base_score": sums[2], "score": sums[3],
        })

    asked = rows.mapInArrow(ask, ", ".join(f"{c} {t}" for c, (t, _) in _COLUMNS.items()))
    told = asked.groupBy("part").cogroup(model.counts.groupBy("part")).applyInPandas(tell, f"{ROW_ID} bigint, docs binary, sums binary, ids array<bigint>")
    # a row for each block and part comes back, not one for each document
    return told.groupBy(ROW_ID).applyInPandas(gather, f"{ROW_ID} bigint, doc_id bigint, {SUMS}")


_COLUMNS = {"part": ("int", pa.int32()), ROW_ID: ("bigint", pa.int64()), "keys": ("binary", pa.binary()), "counts": ("binary", pa.binary()), "docs": ("binary", pa.binary()), "ids": ("array<bigint>", pa.list_(pa.int64())), "sums": ("binary", pa.binary())}


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(1, t) for c, (_, t) in _COLUMNS.items()], names=list(_COLUMNS))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(5)) == 1, F.lit(False))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.filter(F.pmod(id_crc("doc_id"), F.lit(5)) != 1))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score")
