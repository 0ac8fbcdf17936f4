"""Chroma audio fingerprints over a media column, and their alignment.

A recording (WAV bytes, 16-bit PCM) becomes frames of twelve pitch classes. Sixteen filters, each a difference of
rectangle sums over WIDTH frames, are read off the integral image of the frames; each gives two bits by three
thresholds, in Gray code, so that neighbours differ in one bit. So each position has a packed 32-bit integer.

Two recordings are aligned by a histogram of the offsets at which their integers are equal; a run of equal integers counts
once, where it begins, so silence or a held note of n frames gives one vote and not n squared. Each offset with at least
VOTES is verified by the share of differing bits over the overlap, which must cover half of the shorter and have at most
ERROR; of those that pass, the one with most votes is taken (ties: nearest to zero, then smallest). Recordings with equal
fingerprints are one class with one set of postings, so a hot group of copies is one recording. The search takes each recording whose id is divisible by
100 as a query against all, and gives each recording its best query: least bit error, then smallest id. A class that has
a query itself has that one as its best, and is searched by the queries of other classes like any class. Each further
match of a class is a row more, once for the class, under its least id; so no match is dropped, and copies don't repeat
them.

Bytes that are null, no WAV, of other than 16-bit samples, or shorter than WIDTH frames have an empty fingerprint and match nothing. Repeated rows are
copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_ID, cut, look_up, table, with_row_id

FRAME, HOP, WIDTH = 1024, 256, 16
LOWEST, HIGHEST = 55.0, 1760.0
VOTES, ERROR = 3, 0.25
#: A value's part of the frame-wise energy by which the thresholds stand apart.
STEP = 0.15
RATE, NOTE = 4000, 512
#: Frames that are transformed at once.
AT_ONCE = 1024


@functools.cache
def _classes(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency bins in range, and the pitch class of each."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    own = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    return own, np.round(12 * np.log2(f[own] / 440)).astype(int) % 12


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames): each kind at several places and sizes."""
    return [(k % 4, (5 * k) % (13 - h), h, w) for k, (h, w) in enumerate((h, w) for w in (4, 8, 12, 16) for h in (2, 4, 6, 12))]


FILTERS = _filters()


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch class, each frame at length one; silence stays zero. samples: from -1 to 1, or 16-bit ones in a
    column for each channel. AT_ONCE frames are transformed at a time, so a recording of any length takes little more
    memory than its samples."""
    (own, pitch), out = _classes(rate), [np.zeros((0, 12))]
    for begin in range(0, (len(samples) - FRAME) // HOP + 1, AT_ONCE):
        x = samples[begin * HOP : (begin + AT_ONCE - 1) * HOP + FRAME]
        x = x.mean(1) / 32768 if x.ndim == 2 else x
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
        by = np.stack([energy[:, own[pitch == k]].sum(1) for k in range(12)], 1)
        size = np.sqrt((by * by).sum(1, keepdims=True))
        out.append(by / np.where(size > 1e-9, size, 1))
    return np.concatenate(out)


def packed(frames: np.ndarray) -> np.ndarray:
    """The packed integer of each position."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    rect = lambda t, w, y, h: image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y]
    bits = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:
            v = rect(0, w, y, h // 2) - rect(0, w, y + h // 2, h // 2)
        elif kind == 1:
            v = rect(0, w // 2, y, h) - rect(w // 2, w // 2, y, h)
        elif kind == 2:
            v = rect(0, w // 2, y, h // 2) + rect(w // 2, w // 2, y + h // 2, h // 2) - rect(w // 2, w // 2, y, h // 2) - rect(0, w // 2, y + h // 2, h // 2)
        else:
            v = 2 * rect(w // 4, w // 2, y, h) - rect(0, w, y, h)
        level = np.searchsorted([-STEP, 0, STEP], v / w)
        bits = bits << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return bits.view(np.int32)


def fingerprint(raw: bytes | None) -> np.ndarray:
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0, np.int32)
            if not w.getframerate():
                return np.zeros(0, np.int32)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
            return packed(chroma(x, w.getframerate()))
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return np.zeros(0, np.int32)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fingerprints(recordings: pd.Series) -> pd.Series:
    """A column of WAV bytes -> fingerprints."""
    return pd.Series([fingerprint(x) for x in recordings], dtype=object)


def melody(values) -> bytes:
    """WAV bytes with a note for each value: one of 24 halftones from 110 Hz on, by the value itself: -0.3 the lowest, 0.3 the highest."""
    v = np.nan_to_num(np.asarray(values if values is not None else [], float))
    note = np.clip(np.floor((v + 0.3) * 40), 0, 23)
    f = np.repeat(110 * 2 ** (note / 12), NOTE)
    x = np.sin(2 * np.pi * np.cumsum(f) / RATE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 20000).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def rendered(values: pd.Series) -> pd.Series:
    """A column of numbers -> a column of recordings, where a table has none."""
    return pd.Series([melody(x) for x in values], dtype=object)


def _bit_error(a: Column, b: Column, offset: Column) -> Column:
    """The share of differing bits where b, moved back by offset, lies over a."""
    begin_a, begin_b = F.greatest(F.lit(0), -offset), F.greatest(F.lit(0), offset)
    n = F.least(F.size(a) - begin_a, F.size(b) - begin_b)
    cut_of = lambda x, begin: F.slice(x, begin + 1, n)
    wrong = F.aggregate(F.zip_with(cut_of(a, begin_a), cut_of(b, begin_b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(2 * n >= F.least(F.size(a), F.size(b)), wrong / (32 * n))


def search(recordings: DataFrame, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """recordings (rec_id, fp) -> rec_id, n_codes, fp_hash, class_id, match_id, offset, votes, bit_error: a row for each
    recording, with its best match; and one for each further match of a class, which all recordings of fp_hash have."""
    rows = cut(with_row_id(recordings).select(ROW_ID, "rec_id", "fp", F.xxhash64("fp").alias("fp_hash")), "fingerprints")
    query = F.when(F.pmod("rec_id", F.lit(every)) == 0, F.col("rec_id"))
    some = rows.filter(F.size("fp") > 0)
    classes = cut(some.groupBy("fp_hash").agg(F.min(ROW_ID).alias(ROW_ID), F.min("rec_id").alias("class_id"), F.min(query).alias("query"), F.min(F.size("fp")).alias("n_codes"), F.count(F.lit(1)).alias("size")), "classes")
    reps = cut(some.select(ROW_ID, "fp").join(classes.drop("n_codes"), ROW_ID), "class-fingerprints")
    # a run of one code (silence, a held note) votes once, where it begins
    place = F.transform("fp", lambda x, k: F.struct(k.alias("pos"), x.alias("code"), F.get("fp", k - 1).alias("last")))
    codes = reps.select("fp_hash", "query", F.inline(F.filter(place, lambda x: ~x.code.eqNullSafe(x.last)))).drop("last")
    asked = codes.filter("query is not null").select(F.col("query").alias("q"), F.col("fp_hash").alias("q_hash"), F.col("pos").alias("q_pos"), "code")
    votes = asked.join(codes.select("fp_hash", "pos", "code"), "code").filter("fp_hash <> q_hash").groupBy("q", "fp_hash", (F.col("pos") - F.col("q_pos")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    queries = reps.filter("query is not null").select(F.col("query").alias("q"), F.col("fp").alias("q_fp"))
    tried = votes.filter(F.col("votes") >= VOTES).join(queries, "q").join(reps.select("fp_hash", "fp"), "fp_hash")
    passed = tried.withColumn("bit_error", _bit_error(F.col("q_fp"), F.col("fp"), F.col("offset"))).filter(F.col("bit_error") <= ERROR)
    first = F.min(F.struct((-F.col("votes")).alias("v"), F.abs("offset").alias("o"), "offset", "votes", "bit_error")).alias("b")
    found = cut(passed.groupBy("q", "fp_hash").agg(first).select("q", "fp_hash", "b.offset", "b.votes", "b.bit_error"), "found")
    nearest = found.groupBy("fp_hash").agg(F.min(F.struct("bit_error", "q", "offset", "votes")).alias("m"))
    own = F.col("query").isNotNull()
    answers = cut(classes.join(nearest, "fp_hash", "left").select(
        "fp_hash", "size", "class_id", F.coalesce("query", "m.q").alias("match_id"), F.when(own, 0).otherwise(F.col("m.offset")).alias("offset"),
        F.when(~own, F.col("m.votes")).alias("votes"), F.when(own, 0.0).otherwise(F.col("m.bit_error")).alias("bit_error")), "answers")
    told = look_up(some.select("rec_id", F.size("fp").alias("n_codes"), "fp_hash"), answers, "fp_hash", "size").drop("size")
    told_already = answers.filter("votes is not null").select("fp_hash", F.col("match_id").alias("q"))
    further = found.join(told_already, ["fp_hash", "q"], "left_anti").join(classes, "fp_hash").select(
        F.col("class_id").alias("rec_id"), "n_codes", "fp_hash", "class_id", F.col("q").alias("match_id"), "offset", "votes", "bit_error")
    none = rows.filter(F.size("fp") == 0).select("rec_id", F.lit(0).alias("n_codes"), "fp_hash", F.col("rec_id").alias("class_id"))
    return told.unionByName(none, allowMissingColumns=True), further


def align(recordings: DataFrame, every: int = 100) -> DataFrame:
    """The best matches of search."""
    return search(recordings, every)[0]


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no recordings, so each vector of `embeddings` is rendered as one, a note for each value."""
    rows = table(spark, sf_dir, "embeddings")
    best, further = search(rows.select(F.col("vec_id").alias("rec_id"), fingerprints(rendered("embedding")).alias("fp")))
    return best.withColumn("further", F.lit(False)).unionByName(further.withColumn("further", F.lit(True))).select(
        F.col("rec_id").alias("vec_id"), "n_codes", "fp_hash", "class_id", "match_id", "offset", "votes", "bit_error", "further")
