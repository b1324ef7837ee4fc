"""Byte-level BPE ids of whole columns, from a vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import pickle
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from weftline.llm import bytehash as bh
from weftline.llm import units


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others in order as U+0100 and so on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Each token's bytes in order of their ids, compressed, the pattern that splits texts, and special tokens with their ids: what workers need of the file."""

    packed: bytes
    pattern: str
    special: tuple[tuple[str, int], ...] = ()


@lru_cache(maxsize=2)
def read(path: str) -> Vocabulary:
    """The vocabulary of a file on the driver.

    A special token with a space, or one that takes in what is around it, raises ValueError: units end at spaces.
    """
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = model.get("added_tokens", [])
    special = {x["content"] for x in added}
    if any(" " in x["content"] or x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added):
        raise ValueError("special tokens must be plain")
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return Vocabulary(zlib.compress(pickle.dumps(ranks)), public_tokenizers.PATTERN, tuple((x["content"], x["id"]) for x in added))


@lru_cache(maxsize=2)
def _encoding(vocabulary: Vocabulary):
    """Ids are ranks of merges in such vocabularies, so that tiktoken gives what ``tokenizers`` gives, in less time."""
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=vocabulary.pattern, mergeable_ranks=pickle.loads(zlib.decompress(vocabulary.packed)), special_tokens=dict(vocabulary.special))


@lru_cache(maxsize=2)
def _cache(vocabulary: Vocabulary) -> units.UnitCache:
    encoding = _encoding(vocabulary)
    return units.UnitCache(lambda unit: encoding.encode(unit.decode(), allowed_special="all"))


def batch_ids(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in order, and the number of ids before each text (one more at the end); null is empty.

    A special token's string in a text is that token, as ``tokenizers`` has it; none is added.
    """
    data, offsets = bh.text_buffer(texts)
    if not len(data):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
    starts, ends, first = units.cut_at(data, offsets, units.lone_spaces(data, offsets))
    ids, before = units.encoded(starts, ends, bh.hash_spans(data, starts, ends), data.tobytes(), _cache(vocabulary))
    return ids, before[first]
