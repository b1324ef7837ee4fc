"""Texts cut into units that a tokenizer encodes alike alone and in place; each distinct unit of a batch is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from weftline.llm import bytehash as bh

#: Bytes of text (one row at least) that are encoded at once.
SLICE = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most SLICE bytes of text or one row."""
    for batch in batches:
        _, offsets = bh.text_buffer(batch.column(column))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def cut_at(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units that cover each text and begin at it and at the positions ``at``, and each text's first unit."""
    n = len(data)
    begin = np.zeros(n, dtype=bool)
    begin[at] = True
    begin[offsets[:-1][offsets[:-1] < n]] = n > 0
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)[: len(starts)]
    return starts, ends, np.searchsorted(starts, offsets)


class UnitCache:
    """Ids of units met before by their 64-bit keys, in arrays of about 30 bytes a unit; bounded in units and in ids of a unit."""

    def __init__(self, encode: Callable[[bytes], list[int]], entries: int = 1 << 20, longest: int = 32) -> None:
        self._encode, self._entries, self._longest = encode, entries, longest
        self._keys, self._begin = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self._size, self._flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def ids(self, keys: np.ndarray, unit: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and of each of the distinct ascending ``keys`` where its ids begin and how many they are; ``unit`` gives a unit's bytes."""
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        near = at < len(self._keys)
        known[near] = self._keys[at[near]] == keys[near]
        begin, size = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        begin[known], size[known] = self._begin[at[known]], self._size[at[known]]
        missing = np.flatnonzero(~known)
        made = [self._encode(unit(i)) for i in missing.tolist()]
        fresh = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        new = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(fresh.sum()))
        begin[missing], size[missing] = len(self._flat) + np.cumsum(fresh) - fresh, fresh
        flat = np.concatenate((self._flat, new))
        short = fresh <= self._longest
        if len(self._keys) + int(short.sum()) <= self._entries:
            kept, sizes = missing[short], fresh[short]
            self._keys = np.insert(self._keys, at[kept], keys[kept])
            self._begin = np.insert(self._begin, at[kept], len(self._flat) + np.cumsum(sizes) - sizes)
            self._size = np.insert(self._size, at[kept], sizes)
            self._flat = np.concatenate((self._flat, new[np.repeat(short, fresh)]))
        return flat, begin, size


def encoded(starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, raw: bytes, cache: UnitCache, prefixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All units' ids in order, and the number of ids before each unit (one more at the end).

    Units of equal ``keys`` are alike, and one of each kind is encoded; one that is ``prefixed`` with a space before it.
    """
    distinct, first, kind = np.unique(keys, return_index=True, return_inverse=True)

    def unit(k: int) -> bytes:
        i = first[k]
        text = raw[starts[i] : ends[i]]
        return b" " + text if prefixed is not None and prefixed[i] else text

    flat, begin, size = cache.ids(distinct, unit)
    sizes = size[kind]
    before = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(begin[kind] - before[:-1], sizes) + np.arange(int(before[-1]))], before


def lone_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of single spaces within a text that stand between characters which surely aren't white space.

    Byte-level BPE splits a text before such a space whatever surrounds it.
    Characters count as sure if they are printable ASCII or two bytes from U+00C0 on.
    """
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    plain = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data <= 0xDF)
    before = plain.copy()
    before[1:] |= lead[:-1]
    good = np.zeros(len(data), dtype=bool)
    good[1:-1] = (data[1:-1] == 0x20) & before[:-2] & (plain | lead)[2:]
    edge = np.concatenate((offsets[:-1], offsets[1:] - 1))
    good[edge[(edge >= 0) & (edge < len(data))]] = False
    return np.flatnonzero(good)
