"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search walks a lattice whose nodes are the boundaries between characters and
whose edges are pieces.  It retains back pointers for a window that the longest
piece bounds, and commits ids as soon as the paths of all boundaries from which a
piece may still start lead back to one boundary.

Edges of a unigram model weigh their score.  In a merge (BPE) model an edge is
allowed after another if merging the two pieces' characters gives just these two;
exactly one path to each boundary is made of allowed steps, and it is what the
merges give for the text up to there.  So both kinds of model give the ids of the
library that defines them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytehash as bh
from weftline.llm import units
from weftline.llm.shared import give_back, index_of, map_batches, picked, widened, without

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: What an unknown character costs below the least score of a piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The pieces of a SentencePiece model file, and the two lattices over them."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models that map characters aren't supported")
                self.dummy_prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"models of type {self.kind} aren't supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces aren't supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        #: Whether no piece goes on after a space that follows other characters: then every word is found alone.
        self.words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._steps: dict[tuple[str, str], bool] = {}
        self._fast: dict[int, bool] = {}
        #: Of each ending of a piece the piece's id, -1 if it is no piece itself: where a search backwards may stop.
        self._tails = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self._sizes = np.array([len(self.surface(i)) for i in range(len(self.pieces))], dtype=np.int64)
        self._bytes = np.frombuffer(b"".join(self.surface(i) for i in range(len(self.pieces))), dtype=np.uint8)
        self._begin = np.cumsum(self._sizes) - self._sizes

    def surface(self, i: int) -> bytes:
        """The bytes that an id stands for; none for control ids."""
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """What merges make of a short text: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def allowed(self, before: str, piece: str) -> bool:
        """Whether merges leave these two pieces as they are; ``before`` may be empty."""
        known = self._steps.get((before, piece))
        if known is None:
            known = self.merged(before + piece) == ([before, piece] if before else [piece])
            if len(self._steps) < 1 << 18:
                self._steps[before, piece] = known
        return known

    def stream(self, chunks: Iterable[str]) -> Iterator[tuple[list[int], int]]:
        """The best path's ids, of a text with SPACE for spaces that comes in chunks: whenever a boundary is settled its ids and characters since the last.

        Besides the window of twice the longest piece, only what no common boundary has settled yet is held.
        """
        merging, longest, ids, scores, tails, fast, start = self.kind == BPE, self.longest, self.ids, self.scores, self._tails, self._fast, len(self.pieces)
        window, i, checked = "", 0, 0  # characters from the last committed boundary on; boundaries reached and settled
        back, last, best = [0], [start], [0.0]  # of each boundary: start of its last piece, that piece (or ``start`` for none: an unknown character), the path's score
        unknown = False
        for chunk in chunks:
            window += chunk
            while i < len(window):
                i += 1
                if merging:
                    # of the pieces that end here just one is allowed, so the shortest are tried first
                    j = i - 1
                    while True:
                        k = tails.get(window[j:i])
                        if k is None:
                            k, j = start, i - 1
                            break
                        if k >= 0:
                            step = last[j] << 20 | k
                            fits = fast.get(step)
                            if fits is None:
                                fits = self.allowed(self.pieces[last[j]] if last[j] < start else "", self.pieces[k])
                                if len(fast) < 1 << 18:
                                    fast[step] = fits
                            if fits:
                                break
                        if not j:
                            k, j = start, i - 1
                            break
                        j -= 1
                else:
                    top, j, k = best[i - 1] + self.least - UNKNOWN_PENALTY, i - 1, start
                    for h in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                        found = tails.get(window[h:i])
                        if found is None:
                            break
                        if found >= 0 and best[h] + scores[found] > top:
                            top, j, k = best[h] + scores[found], h, found
                    best.append(top)
                back.append(j)
                last.append(k)
                if i - checked >= 2 * longest:
                    checked = i
                    alive = set(range(i + 1 - longest, i + 1))  # boundaries from which a piece may still start
                    while len(alive) > 1:
                        most = max(alive)
                        alive.remove(most)
                        alive.add(back[most])
                    settled = alive.pop()
                    if settled:
                        out, unknown = self._path(window, back, last, settled, unknown)
                        yield out, settled
                        window, i, checked = window[settled:], i - settled, checked - settled
                        back = [0, *(b - settled for b in back[settled + 1 :])]
                        last, best = last[settled:], best if merging else best[settled:]
        if i:
            yield self._path(window, back, last, i, unknown)[0], i

    def _path(self, window: str, back: list[int], last: list[int], end: int, unknown: bool) -> tuple[list[int], bool]:
        """Ids of the path to a boundary, and whether it ends in the unknown id, which a run of unknown characters has once; ``unknown``: so did what is before it."""
        start, steps = len(self.pieces), []
        while end:
            steps.append((last[end], back[end]))
            end = back[end]
        out: list[int] = []
        for k, j in reversed(steps):
            if k < start:
                out.append(k)
                unknown = False
            elif len(self.byte_ids) == 256:
                out.extend(self.byte_ids[b] for b in window[j].encode())
            elif not unknown:
                out.append(self.unknown)
                unknown = True
        return out, unknown

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(filter(None, text.split(" ")))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.stream([self.normal(text)]) for i in ids]

    def decode(self, ids: np.ndarray, before: np.ndarray) -> list[str]:
        """Texts of the id sequences between successive offsets ``before``; bytes that aren't UTF-8 become U+FFFD."""
        size = self._sizes[ids]
        ends = np.cumsum(size)
        out = self._bytes[np.repeat(self._begin[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cut = np.concatenate(([0], ends))[before]
        strip = len(SPACE.replace(SPACE, " ")) if self.dummy_prefix else 0
        raw = out.tobytes()
        texts = (raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        return [(t[strip:] if t[:1] == b" " and strip else t).decode(errors="replace") for t in texts]


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return Model(data)


@lru_cache(maxsize=2)
def _cache(data: bytes) -> units.UnitCache:
    model = _model(data)

    def encode(unit: bytes) -> list[int]:
        return [i for ids, _ in model.stream([unit.decode().replace(" ", SPACE)]) for i in ids]

    return units.UnitCache(encode)


def batch_ids(texts: pa.Array, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in order, and the number of ids before each text (one more at the end); null is empty."""
    model = _model(data)
    raw, offsets = bh.text_buffer(texts)
    if not len(raw):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
    if model.squeeze or not model.words:
        made = [model.encode(t or "") for t in texts.to_pylist()]
        return np.array([i for ids in made for i in ids], dtype=np.uint32), np.cumsum([0, *map(len, made)])
    # a word begins with the first space after another character: all paths meet there
    space = raw == 0x20
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    sign = np.zeros(len(at), dtype=bool)
    far = at >= 3
    sign[far] = (raw[at[far] - 3] == 0xE2) & (raw[at[far] - 2] == 0x96) & (raw[at[far] - 1] == 0x81)
    starts, ends, first = units.cut_at(raw, offsets, at[~sign])
    keys = bh.hash_spans(raw, starts, ends)
    prefixed = np.zeros(len(starts), dtype=bool)
    if model.dummy_prefix:
        prefixed[first[:-1][offsets[:-1] < offsets[1:]]] = True
        keys = np.where(prefixed, bh.mix(keys), keys)
    ids, before = units.encoded(starts, ends, keys, raw.tobytes(), _cache(data), prefixed)
    return ids, before[first]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _beside(docs: DataFrame, new: str, old: str) -> DataFrame:
    if new.lower() == old.lower():
        raise ValueError("the new column needs a name of its own")
    return without(docs, new)


def encode(docs: DataFrame, text_column: str = "text", ids_column: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids (array<int>) of its texts by the model file, which the driver reads and sends along.

    Null and empty texts have no ids.  A character of no piece becomes its bytes'
    pieces, or in a model without them the unknown id, once for each run.  All rows
    and columns stay; a column named like ``ids_column`` is replaced.
    """
    data = _read(model or default_path())
    docs = _beside(docs, ids_column, text_column)
    at = index_of(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in units.slices(batches, at):
            ids, before = batch_ids(batch.column(at), data)
            lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids_column])
        give_back()

    return map_batches(docs, run, widened(docs, **{ids_column: "array<int>"}))


def decode(docs: DataFrame, ids_column: str = "ids", text_column: str = "decoded", model: str | None = None) -> DataFrame:
    """``docs`` with the texts of its id arrays; null ids are an empty text, control ids none, unknown ones U+2047 between spaces.

    An id beyond the model raises.  All rows and columns stay; a column named like ``text_column`` is replaced.
    """
    data = _read(model or default_path())
    docs = _beside(docs, text_column, ids_column)
    at = index_of(docs, ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                lists = batch.column(at)
                size = np.fromiter((0 if n is None else n for n in lists.value_lengths().to_pylist()), dtype=np.int64, count=len(batch))
                texts = _model(data).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(size))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_column])
        give_back()

    return map_batches(docs, run, widened(docs, **{text_column: "string"}))


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None) -> DataFrame:
    """Of each row its id, how many ids its text has, their CRC-32 as little-endian 32-bit numbers, and whether decoding them gives the text again.

    doc_id, n_ids, ids_crc32, round_trip: encoding and decoding in one pass, by the same search as ``encode`` and ``decode``.
    """
    data = _read(model or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in units.slices(batches, 1):
            ids, before = batch_ids(batch.column(1), data)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            back = pa.array(_model(data).decode(ids.astype(np.int64), before), pa.string())
            same = pc.equal(pc.fill_null(batch.column(1), ""), back)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(before)), pa.array(crc, pa.int64()), same], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])
        give_back()

    rows = picked(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(rows, run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
