"""Packing by power-of-two decomposition.

A document's ids, with the end id 0 behind them, are cut into pieces whose lengths are the binary digits of their
number: as many of `longest` as fit, then one for each set bit of the rest, longest first. Each piece is a sequence of
its own, at offset 0, so no sequence crosses documents and none is padded; pieces of equal length share a bucket, from
which batches of one shape can be drawn. It is one pass without a shuffle.

A null text is empty: one piece with the end id alone. Repeated rows are packed each for itself, a null doc_id is kept,
an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

LONGEST = 1024
END = np.uint32(0)
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id bigint, start bigint, length bigint, bucket int, ids_crc32 bigint, doc_tokens bigint, ids array<int>"
#: Bytes of text handed to the tokenizer at once, unless one text has more.
AT_ONCE = 2_000_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """text -> ids as unsigned 32-bit integers, as the `tokenizers` library gives them for the byte-level BPE file at
    path, without special tokens of its own (their strings in a text are such tokens). The file's vocabulary is run by
    tiktoken's engine, at a third of the time; a text that it refuses, such as a million spaces in a row, over which its
    split pattern runs out of stack, is encoded by `tokenizers`."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import tiktoken

        self.path = path
        held, byte_of = json.loads(Path(path).read_text(encoding="utf-8")), _byte_of()
        special = {x["content"]: x["id"] for x in held["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in held["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding(Path(path).name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.engine.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as a sum of powers of two of at most longest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def parts(texts: pa.Array) -> Iterator[slice]:
    begin, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > AT_ONCE:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def pack(docs: DataFrame, path: str, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """docs -> SCHEMA and sequence_id, offset; a row for each piece. path: a tokenizer's file. with_ids=False leaves
    the ids out."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encode = encoder(path)
        release()  # reading the vocabulary's file takes several times its size
        for b in batches:
            ids_of, texts = b.column(0), b.column(1)
            for part in parts(texts):
                out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "crc", "total")}
                ids_out: list[np.ndarray] = []
                for k, text in enumerate(texts[part].to_pylist()):
                    ids = np.append(encode(text), END)
                    raw, at = memoryview(ids).cast("B"), 0
                    for n in binary_lengths(len(ids), longest):
                        out["doc"].append(part.start + k)
                        out["start"].append(at)
                        out["length"].append(n)
                        out["crc"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        out["total"].append(len(ids))
                        at += n
                    ids_out.append(ids)
                length = np.array(out["length"], np.int64)
                ids_column = pa.nulls(len(length), pa.list_(pa.int32()))
                if with_ids:
                    ids_column = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), np.concatenate(ids_out).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(out["doc"], pa.int64())), pa.array(out["start"], pa.int64()), pa.array(length), pa.array(np.log2(length).astype(np.int32)), pa.array(out["crc"], pa.int64()), pa.array(out["total"], pa.int64()), ids_column],
                    names=["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens", "ids"],
                )
        release()

    pieces = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
    pieces = pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return pieces if with_ids else pieces.drop("ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes packed sequences by bucket of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
