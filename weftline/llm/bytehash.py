"""Vectorised hashing of the words in an Arrow batch of texts.

Everything works on the UTF-8 bytes that Arrow already holds: no Python object
is made for a word.  Memory is bounded by ``PIECE`` bytes of text at a time plus
eight bytes for each word, however long one text or one word is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded to 64-bit values at once.
PIECE = 1 << 20
#: Longer words are hashed by blake2b, one by one.
LONG_WORD = 1 << 12

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(LONG_WORD + 1, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans_of(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross none of ``cuts``."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = cuts[(cuts > 0) & (cuts < n)]
    begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:n] = inside[:-1] & ~inside[1:]
    stop[n] = inside[-1]
    stop[at] |= inside[at - 1]
    return starts, np.flatnonzero(stop)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span; spans ascend and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    done = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        if lengths[i] > LONG_WORD:
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
            i += 1
            continue
        base = done[i] - lengths[i]
        j = max(i + 1, int(np.searchsorted(done, base + PIECE, side="right")))
        over = np.flatnonzero(lengths[i:j] > LONG_WORD)
        if len(over):
            j = i + int(over[0])
        size = lengths[i:j]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        values = _BYTE[data[np.repeat(starts[i:j], size) + within]]
        values *= _POWER[within]
        out[i:j] = mix(np.add.reduceat(values, first) ^ (size.astype(np.uint64) * _SHINGLE[-1]))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (one more at the end)."""
    starts, ends = spans_of(~_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[data]


def shingle_hashes(word: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of ``size`` successive words; of a shorter text that of the whole sequence."""
    n = len(word)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size if n >= size else 0):
        rolled += word[j : n - size + 1 + j] * _SHINGLE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found if keep.all() else found[keep])
        elif b > a:
            whole = (word[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ _SHINGLE[32 + b - a]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
