"""Vectorised hashes of words and word sequences.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a
polynomial over random byte values, taken from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EACH = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Text is hashed in pieces of about so many bytes, cut at white space.
PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        up, down = np.full(size, _P), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


def _piece(raw: np.ndarray, starts_doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``raw``; a word also ends where a document starts."""
    up, down = _tables(len(raw))
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = starts_doc[starts_doc < len(raw)]
    first[at] |= word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = at[at > 0] - 1
    last[before] |= word[before]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[end + 1] - sums[begin]) * down[begin]
    return mix(h + (end - begin).astype(np.uint64) * _COEF[63]), begin


def _text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array in one buffer, and n + 1 offsets; nulls are empty."""
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def exact_word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, with case kept."""
    return word_hashes(arr, _EACH)


def word_hashes(arr: pa.Array, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a string array, one after another, and n + 1 offsets into them."""
    raw, offsets = _text_bytes(arr)
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):
            back = np.flatnonzero(_SPACE[raw[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
                break
            end = min(len(raw), end + PIECE)
        lo, hi = np.searchsorted(offsets, [at, end])
        h, b = _piece(raw[at:end], offsets[lo:hi] - at, table)
        hashes.append(h)
        begins.append(b + at)
        at = end
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begin, offsets)


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; none if there are fewer."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = words[:size] * _COEF[0]
    for k in range(1, n):
        out += words[k : k + size] * _COEF[k]
    return mix(out + np.uint64(n))


def shingle_sets(arr: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``n`` words.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    words, offsets = word_hashes(arr)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        own = words[lo:hi]
        yield np.unique(sequences(own, min(n, len(own)))) if len(own) else own


def value_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a string array, case kept; a null counts as empty."""
    out = []
    for start in range(0, len(values), 1 << 16):
        raw, offsets = _text_bytes(values.slice(start, 1 << 16))
        up, down = _tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_EACH[raw] * up[: len(raw)], out=sums[1:])
        begin, end = offsets[:-1], offsets[1:]
        out.append(mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _COEF[63]))
    return np.concatenate([np.zeros(0, np.uint64), *out])
