"""Sets of word shingles and their MinHash sketches, computed in Arrow batches.

Words are hashed from the UTF-8 bytes of a whole batch at once: a polynomial over random byte values, from running
sums, so there is no loop over words. A shingle is the hash of consecutive words. Sets are the sorted distinct
shingles, kept as 48 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SKETCH = 64
SHINGLE_BYTES = 6
# UTF-8 bytes hashed at once; a longer text is hashed by itself.
CHUNK_BYTES = 1_000_000

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _random.integers(1, 1 << 62, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _random.integers(1, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in bytes that end with white space."""
    space = _SPACE[data]
    begins = ~space & np.concatenate([[True], space[:-1]])
    ends = space & np.concatenate([[False], ~space[:-1]])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    powers = np.empty(len(data), dtype=np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(_BASE)
    np.cumprod(powers, out=powers)
    total = np.cumsum(_BYTE[data] * powers)
    before = np.where(first > 0, total[first - 1], np.uint64(0))
    back = np.empty(len(data), dtype=np.uint64)
    back[0] = 1
    back[1:] = np.uint64(_INVERSE)
    np.cumprod(back, out=back)
    return _mixed((total[last - 1] - before) * back[first]), first


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles, 48 bits each, of each text of a chunk."""
    hashes, first = _word_hashes(data) if len(data) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    place = np.searchsorted(first, offsets)
    count = max(0, len(hashes) - words + 1)
    grams = np.zeros(count, dtype=np.uint64)
    for k in range(words):
        grams += hashes[k : k + count] * _STEP[k]
    grams = _mixed(grams) >> np.uint64(16)
    for start, end in zip(place[:-1], place[1:], strict=True):
        if end - start >= words:
            yield np.unique(grams[start : end - words + 1])
        elif end > start:
            # Fewer words than a shingle has: the text is its only shingle.
            short = (hashes[start:end] * _STEP[: end - start]).sum(dtype=np.uint64) + np.uint64(end - start)
            yield _mixed(np.array([short])) >> np.uint64(16)
        else:
            yield np.empty(0, np.uint64)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of some texts at a time, each text followed by a space; NULL is empty."""
    pieces: list[bytes] = []
    size = 0
    for value in column:
        text = value.as_buffer()
        pieces.append(b"" if text is None else text.to_pybytes())
        size += len(pieces[-1]) + 1
        if size >= CHUNK_BYTES:
            yield _joined(pieces)
            pieces, size = [], 0
    if pieces:
        yield _joined(pieces)


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(piece) + 1 for piece in pieces])])
    return np.frombuffer(b" ".join(pieces) + b" ", dtype=np.uint8), offsets


def shingle_sets(column: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    for data, offsets in _texts(column):
        yield from _sets(data, offsets, words)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the sketch's hash functions over a set."""
    low = (shingles ^ (shingles >> np.uint64(24))).astype(np.uint32)
    least = np.full(SKETCH, np.uint32(0xFFFFFFFF))
    for start in range(0, len(low), 4096):
        part = low[start : start + 4096, None] * _SCALE + _SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(blob, dtype=np.uint8).reshape(-1, SHINGLE_BYTES)
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, :SHINGLE_BYTES] = rows
    return wide.view("<u8").ravel()


def set_identity(shingles: np.ndarray) -> int | None:
    """64-bit identity of a set, NULL for the empty one."""
    if not len(shingles):
        return None
    order = np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value = _mixed(_mixed(shingles + order).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles)))
    return int(value.view(np.int64)[0])
