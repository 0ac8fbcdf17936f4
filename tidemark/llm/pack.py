"""Arrays of numbers as bytes, for rows that carry a block at once through a shuffle."""

from __future__ import annotations

import numpy as np


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes by significance, so that those that hardly differ stand together, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def spread(raw: bytes, kind: type) -> np.ndarray:
    """The array, in one dimension, that squeeze got."""
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key, evenly."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
