"""Word and shingle hashes of whole texts, for use inside tasks."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


def tidy(run):
    """A task's function over batches that gives freed memory back to the system at its end, so that idle workers stay small."""

    @functools.wraps(run)
    def wrapped(*batches):
        yield from run(*batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to trim
            pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(text: str | None) -> list[bytes]:
    """Runs of other bytes than ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=U, count=len(parts))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring words, in order."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, dtype=U)
    keys = mix(_STEP * np.arange(1, width + 1, dtype=U)) | U(1)
    total = np.zeros(n, dtype=U)
    for j in range(width):
        total += hashes[j : j + n] * keys[j]
    return mix(total)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingles; of fewer words than ``width`` the whole sequence as one; of none none."""
    hashes = word_hashes(words(text))
    if 0 < len(hashes) < width:
        return window_hashes(hashes, len(hashes)) ^ U(len(hashes))
    return np.unique(window_hashes(hashes, width))
