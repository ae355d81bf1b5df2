"""Whole-batch word splitting and hashing over Arrow string columns, in numpy.

Words are found on the UTF-8 bytes of a batch at once: every separator used here is
ASCII, so bytes and code points give the same words. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
SLICE = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[0x20] = _SEP[0x09:0x0E] = True
#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = _SEP
_SEP = np.zeros(256, bool)
_SEP[0x00:0x30] = _SEP[0x3A:0x61] = _SEP[0x7B:0x80] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, applied after lower-casing A-Z.
NOT_ALNUM = _SEP
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
#: Powers beyond these many are made anew each time, so that one long text leaves no memory behind.
_HELD = 3 << 19


def powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 10), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if n <= _HELD:
            _POWERS[int(base)] = held
    return held[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more offset than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the index of each text's first word (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~separators[data]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = False, word[:-1]
    edge[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(word & ~edge)
    edge[-1], edge[:-1] = False, word[1:]
    edge[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~edge) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in an odd base, then mixed with the length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_P, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_P_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def slices(at: np.ndarray, limit: int = SLICE):
    """Ranges of texts of at most `limit` bytes together, or of one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def hash_words(column, separators: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the index of each text's first word (one more than texts)."""
    data, at = flat(column)
    hashes, firsts, n = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(at):
        part = data[at[i] : at[j]]
        if lower:
            part = LOWER[part]
        starts, ends, first = spans(part, at[i : j + 1] - at[i], separators)
        hashes.append(span_hash(part, starts, ends))
        firsts.append(first[1:] + n)
        n += len(starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(firsts)


_Q = np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(0xA0761D6478BD642F | 1)


def rolling(words: np.ndarray, width: int, base: np.uint64 = _Q) -> np.ndarray:
    """The Rabin-Karp hash of the `width` words from each position on, where so many follow."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse, n))


def windows(first: np.ndarray, width: int) -> np.ndarray:
    """Positions (in the words of all texts) at which a window of `width` words of one text begins."""
    n = int(first[-1])
    inside = np.zeros(n + 1, np.int8)
    lengths = np.diff(first)
    ok = lengths >= width
    np.add.at(inside, first[:-1][ok], 1)
    np.add.at(inside, first[1:][ok] - width + 1, -1)
    return np.flatnonzero(np.cumsum(inside[:n]))


def blocks(batches, column: str, limit: int):
    """The record batches again, cut so that a block's texts are at most `limit` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        lengths = np.asarray(pc.binary_length(texts).fill_null(0).cast(pa.int64()))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        for i, j in slices(at, limit):
            yield batch.slice(i, j - i)


def binaries(values: list[bytes] | None, data: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.Array:
    """A binary column from bytes, or from flat bytes and offsets."""
    if values is not None:
        return pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
