"""Words of a text as numbers: A-Z lower-cased, cut at [\\x20\\x09-\\x0D], each word a 64-bit hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


MOST = 100_000


class _Keys(dict):
    """word -> hash; each Python worker keeps those of MOST words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MOST:
            self.clear()
        self[word] = k = xxhash.xxh3_64_intdigest(word) - 2**63
        return k


_keys = _Keys()


def word_keys(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    return np.fromiter(map(_keys.__getitem__, words), np.int64, len(words))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the different words of texts, the place there of each word, and the number of each text's words: as
    `word_keys`, but each different word is hashed once for each run of blanks behind it, however many there are."""
    import xxhash

    texts = pc.fill_null(texts, "").cast(pa.binary())
    bounds = np.frombuffer(texts.buffers()[1] or b"\0" * 4, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    raw = texts.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes().translate(_LOWER)
    bounds = bounds - bounds[0]
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    begins = ~blank
    begins[1:] &= blank[:-1]
    first = bounds[:-1][bounds[:-1] < len(raw)]
    begins[first] = ~blank[first]
    starts = np.flatnonzero(begins).astype(np.int32)
    # each word with the blanks behind it, so up to the next word
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, np.int32(len(raw)))), pa.py_buffer(raw)]).dictionary_encode()
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.rstrip, words.dictionary.to_numpy(zero_copy_only=False))), np.uint64, len(words.dictionary))
    return (keys - np.uint64(2**63)).view(np.int64), words.indices.to_numpy(), np.diff(np.searchsorted(starts, bounds))
