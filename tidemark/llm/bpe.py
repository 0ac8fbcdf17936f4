"""Byte-level BPE encoding and decoding by recursive queries of DuckDB, one database in memory for each Python worker.

Encoding: the split pattern cuts each text into words. The words of a batch that are new to the worker become rows of
token and position, at first a row for each byte. A recursive query joins neighbours with the merge table and contracts
each word's leftmost pair of least rank, all words at once, until no pair of any word is in the table. A word that is a
token itself is that token. Decoding selects the vocabulary's pieces by each text's list of ids and puts them together in
the list's order.

A recursion contracts one pair of a word at a time, so its work grows with the square of a word's length: a million
bytes without a space would be a million steps over a million rows. So words over LONG bytes (none in ordinary text) are
merged by a heap instead, by the same rule: an exact way for the rest, where the recursion can't end in time.

A null text is empty: no ids. Texts of any length are handled whole; repeated rows are encoded each for itself; an empty
table gives an empty result; other columns are kept by `encode` and `decode`.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 1024
#: Different words kept by a worker, at about 250 bytes each; words of one query; characters or tokens handled at once.
KEPT, WORDS, AT_ONCE = 700_000, 50_000, 1_000_000

#: A row of t is one number for a token: step << 45 | word << 28 | position << 18 | id. So rows sort by word and position
#: within a step, and neighbours follow one another.
ENCODE = """
WITH RECURSIVE t(x) AS (
    SELECT (w << 28) | (pos << 18) | id FROM bytes
    UNION ALL
    SELECT CASE WHEN x >> 18 = best >> 18 THEN best ELSE x END + 35184372088832 FROM (
        WITH n AS MATERIALIZED (SELECT x, lead(x) OVER s AS y, lag(x) OVER s AS z FROM t WINDOW s AS (ORDER BY x)),
        b AS (SELECT x >> 28 AS w, min((merged << 10) | ((x >> 18) & 1023)) AS best FROM n JOIN merges ON pair = (((x & 262143) << 18) | (y & 262143))
              WHERE x >> 28 = y >> 28 GROUP BY ALL)
        SELECT x, z, (b.w << 28) | ((best & 1023) << 18) | (best >> 10) AS best FROM n JOIN b ON b.w = x >> 28)
    WHERE z >> 18 IS DISTINCT FROM best >> 18)
SELECT (t.x >> 28) & 131071 AS w, t.x & 262143 AS id
FROM t JOIN (SELECT max(x >> 28) AS last FROM t GROUP BY (x >> 28) & 131071) ON last = t.x >> 28 ORDER BY t.x & 35184372088831
"""
DECODE = "SELECT coalesce(array_to_string(list_select(pieces, ids), ''), '') FROM tokens, vocabulary ORDER BY d"


class Codec:
    def __init__(self, path: str):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
        merges = [(self.ranks[x[:k]] << 18 | self.ranks[x[k:]], r) for x, r in self.ranks.items() for k in range(1, len(x)) if x[:k] in self.ranks and x[k:] in self.ranks]
        self._table("merges", zip(("pair", "merged"), np.array(merges, np.int64).T, strict=True))
        pieces = [""] * (max(self.ranks.values()) + 1)
        for x, r in self.ranks.items():
            pieces[r] = x.decode("latin-1")
        self._table("vocabulary", [("pieces", [pieces])])
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, columns) -> None:
        held = pa.table({k: pa.array(v) for k, v in columns})
        self.db.register("held", held)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM held")
        self.db.unregister("held")

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, none of which is a token, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        w = np.repeat(np.arange(len(words)), lengths)
        self._table("bytes", [("w", w), ("pos", np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)), ("id", ids)])
        found = self.db.sql(ENCODE).to_arrow_table()
        raw = found["id"].to_numpy().astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(found["w"].to_numpy(), minlength=len(words))) * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def long_word(self, word: bytes) -> bytes:
        """The same by a heap of pairs, in n log n steps."""
        ids, right, left = [*self.byte[np.frombuffer(word, np.uint8)].tolist()], [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        parts = [word[k : k + 1] for k in range(len(word))]
        heap: list[tuple[int, int, bytes, bytes]] = []

        def push(k: int) -> None:
            if k >= 0 and right[k] >= 0 and (r := self.ranks.get(parts[k] + parts[right[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))

        for k in range(len(word)):
            push(k)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            n = right[k]
            if parts[k] != a or n < 0 or parts[n] != b:
                continue
            ids[k], parts[k], right[k], parts[n] = r, a + b, right[n], b""
            if right[k] >= 0:
                left[right[k]] = k
            push(k)
            push(left[k])
        return np.array([i for i, p in zip(ids, parts, strict=True) if p], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KEPT:
            self.known.clear()
        ranks, rest = self.ranks, []
        for word in words.difference(self.known):
            raw = word.encode("utf-8", "replace")
            if (r := ranks.get(raw)) is not None:
                self.known[word] = r.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[word] = self.long_word(raw)
            else:
                rest.append((word, raw))
        for begin in range(0, len(rest), WORDS):
            part = rest[begin : begin + WORDS]
            self.known.update(zip([x for x, _ in part], self.words([x for _, x in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for part in runs(texts, lambda x: len(x or "")):
            split = list(map(words_of, part))
            self.learn(set().union(*split))
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each run of ids stands for."""
        return [x for part in runs(ids, lambda x: len(x) // 4) for x in self._decode(part)]

    def _decode(self, ids: list[bytes]) -> list[bytes]:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64) + 1  # lists count from one
        self._table("tokens", [("d", np.arange(len(ids))), ("ids", pa.LargeListArray.from_arrays(ends, flat))])
        return [x.encode("latin-1") for (x,) in self.db.execute(DECODE).fetchall()]


def runs(values: list, size) -> Iterator[list]:
    """values in parts of at most AT_ONCE by size, or of one value."""
    part, held = [], 0
    for v in values:
        n = size(v)
        if part and held + n > AT_ONCE:
            yield part
            part, held = [], 0
        part.append(v)
        held += n
    if part:
        yield part


@functools.cache
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


#: The properties of the split pattern, which `re` doesn't have, or has otherwise.
PROPERTY = r"\\p\{\w+\}|\\[sS]"


@functools.cache
def ascii_pattern() -> re.Pattern:
    """The same for ASCII texts by `re`, which takes half the time there: each property as the ASCII characters that have
    it by `regex`, all else as it is."""
    import public_tokenizers
    import regex

    def put(found: re.Match) -> str:
        if found[0][0] == "[":
            return re.sub(PROPERTY, lambda m: having(m[0]), found[0])
        return f"[{having(found[0])}]"

    having = lambda x: "".join(f"\\x{b:02x}" for b in range(128) if regex.fullmatch(x, chr(b)))
    return re.compile(re.sub(rf"\[[^\]]*\]|{PROPERTY}", put, public_tokenizers.PATTERN))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (ascii_pattern() if text.isascii() else pattern()).findall(text)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: str | Column, path: str) -> Column:
    """A text column's ids as little-endian unsigned 32-bit integers in a binary column."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(codec(path).encode(texts.tolist()), dtype=object)

    return run(text)


def decode(ids: str | Column, path: str) -> Column:
    """The bytes, in a binary column, of ids as `encode` gives them; null for null."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        found = codec(path).decode([x or b"" for x in ids])
        return pd.Series([None if x is None else y for x, y in zip(ids, found, strict=True)], dtype=object)

    return run(ids)


def encode_and_decode(text: str | Column, path: str) -> Column:
    """A struct of `ids`, as `encode` gives them, and `decoded`, what `decode` makes of them. A column of `decode` over one of
    `encode` is evaluated as a chain beside it, so that a query with both would encode each text twice."""

    @F.pandas_udf("ids binary, decoded binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        ids = codec(path).encode(texts.tolist())
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(codec(path).decode(ids), dtype=object)})

    return run(text)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", encode_and_decode("text", path).alias("coded"))
    return docs.select("doc_id", "coded.ids", "coded.decoded").select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
