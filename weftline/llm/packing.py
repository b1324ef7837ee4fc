"""Token sequences packed under limits on tokens, segments and loss-bearing tokens: vector bin packing by dot products.

A sequence in the making takes, of the items that fit into all three limits, the
one whose demand has the largest dot product with what remains, both as fractions
of the limits.  Each input partition is packed as it streams by, with a bounded
pool of waiting items: there is no shuffle, and no row moves twice.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, units
from weftline.llm.shared import give_back, map_batches, picked

TOKENS = 1024
SEGMENTS = 128
LOSS_TOKENS = 1024
#: Id after each document.
END = 0
#: Items that wait at once in a task; twice as many are packed down to so many.
POOL = 2048

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(slots=True)
class Item:
    """A document's ids from ``start`` on, as yet in no sequence."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    loss: int


@dataclass
class Packer:
    """Packs items one by one; ``emit`` is called with (item, sequence, offset)."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss_tokens: int = LOSS_TOKENS
    #: Whether an item may be cut: then its first id, which nothing precedes, bears no loss, and all others do.
    cut: bool = True
    #: Added to the sequences' numbers.
    base: int = 0
    placed: list[tuple[Item, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._pool: dict[tuple[int, int], deque[Item]] = defaultdict(deque)
        self._waiting = 0
        self._next = self.base

    def add(self, item: Item) -> None:
        if self.cut and len(item.ids) >= self.tokens and self.loss_tokens >= self.tokens - 1:
            # whole sequences of one segment first
            for k in range(0, len(item.ids) - self.tokens + 1, self.tokens):
                self._close([Item(item.doc_id, item.start + k, item.ids[k : k + self.tokens], item.doc_tokens, self.tokens - 1)])
            k = len(item.ids) // self.tokens * self.tokens
            item = Item(item.doc_id, item.start + k, item.ids[k:], item.doc_tokens, max(0, len(item.ids) - k - 1))
            if not len(item.ids):
                return
        elif len(item.ids) > self.tokens or item.loss > self.loss_tokens:
            if not self.cut:
                raise ValueError(f"an item of {len(item.ids)} tokens, {item.loss} with loss, can't be packed uncut")
            size = min(self.tokens, self.loss_tokens + 1)
            for k in range(0, len(item.ids), size):
                part = item.ids[k : k + size]
                self._put(Item(item.doc_id, item.start + k, part, item.doc_tokens, len(part) - 1))
            return
        self._put(item)
        if self._waiting >= 2 * POOL:
            self._pack(POOL)

    def finish(self) -> None:
        self._pack(0)

    def _put(self, item: Item) -> None:
        self._pool[len(item.ids), item.loss].append(item)
        self._waiting += 1

    def _take(self, kind: tuple[int, int]) -> Item:
        own = self._pool[kind]
        item = own.popleft()
        if not own:
            del self._pool[kind]
        self._waiting -= 1
        return item

    def _best(self, left: np.ndarray, kinds: np.ndarray) -> int:
        """Of ``kinds`` (tokens, loss) that fit the remaining (tokens, segments, loss) the one of the largest dot product; -1 if none."""
        fits = (kinds[:, 0] <= left[0]) & (kinds[:, 1] <= left[2])
        if left[1] < 1 or not fits.any():
            return -1
        limit = np.array([self.tokens, self.segments, max(1, self.loss_tokens)], dtype=float)
        share = left / limit
        score = kinds[:, 0] / limit[0] * share[0] + share[1] / limit[1] + kinds[:, 1] / limit[2] * share[2]
        return int(np.argmax(np.where(fits, score, -1.0)))

    def _pack(self, rest: int) -> None:
        """Packs until at most ``rest`` items wait."""
        kinds = np.array(sorted(self._pool), dtype=float).reshape(-1, 2)
        while self._waiting > rest:
            left = np.array([self.tokens, self.segments, self.loss_tokens], dtype=float)
            chosen: list[Item] = []
            while self._waiting:
                k = self._best(left, kinds)
                if k < 0:
                    break
                kind = (int(kinds[k, 0]), int(kinds[k, 1]))
                chosen.append(self._take(kind))
                if kind not in self._pool:
                    kinds = np.delete(kinds, k, axis=0)
                left -= (kind[0], 1, kind[1])
            if self.cut and self._waiting and left[0] >= 1 and left[1] >= 1 and left[2] >= 0:
                # nothing fits whole: the longest item is cut, and what is left of it waits on
                longest = int(np.argmax(kinds[:, 0]))
                kind = (int(kinds[longest, 0]), int(kinds[longest, 1]))
                size = int(min(left[0], left[2] + 1))
                item = self._take(kind)
                if kind not in self._pool:
                    kinds = np.delete(kinds, longest, axis=0)
                chosen.append(Item(item.doc_id, item.start, item.ids[:size], item.doc_tokens, size - 1))
                if size < len(item.ids):
                    tail = Item(item.doc_id, item.start + size, item.ids[size:], item.doc_tokens, len(item.ids) - size - 1)
                    key = (len(tail.ids), tail.loss)
                    if key not in self._pool:
                        kinds = np.append(kinds, [key], axis=0)
                    self._put(tail)
            self._close(chosen)

    def _close(self, chosen: list[Item]) -> None:
        """Makes a sequence; if it isn't full and may be cut, one of each power of two in its length, which need no padding."""
        total = sum(len(x.ids) for x in chosen)
        if total == self.tokens or not self.cut:
            sizes = [total]
        else:
            sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        waiting, at = deque(chosen), 0
        for size in sizes:
            while at < size:
                item = waiting.popleft()
                if len(item.ids) > size - at:
                    k = size - at
                    waiting.appendleft(Item(item.doc_id, item.start + k, item.ids[k:], item.doc_tokens, len(item.ids) - k - 1))
                    item = Item(item.doc_id, item.start, item.ids[:k], item.doc_tokens, k - 1)
                self.placed.append((item, self._next, at))
                at += len(item.ids)
            self._next, at = self._next + 1, 0

    def pieces(self) -> pa.RecordBatch:
        """What has been placed since the last call."""
        placed, self.placed = self.placed, []
        cols = [
            pa.array([x.doc_id for x, _, _ in placed], pa.int64()),
            pa.array([x.start for x, _, _ in placed], pa.int64()),
            pa.array([x.ids.astype("<u4").tobytes() for x, _, _ in placed], pa.binary()),
            pa.array([x.doc_tokens for x, _, _ in placed], pa.int64()),
            pa.array([s for _, s, _ in placed], pa.int64()),
            pa.array([o for _, _, o in placed], pa.int64()),
            pa.array([x.loss for x, _, _ in placed], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"])


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    loss_column: str | None = None,
    tokenizer: str | None = None,
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss_tokens: int = LOSS_TOKENS,
) -> DataFrame:
    """The pieces of sequences of at most ``tokens`` ids, ``segments`` pieces and ``loss_tokens`` ids with loss.

    A document's ids are its text's by the byte-level vocabulary file ``tokenizer``,
    which the driver reads and sends along, and END; a null or empty text has END alone.  Without ``loss_column`` documents
    are cut where that fills a sequence, and a sequence that nothing more can fill
    is split into powers of two, so that none needs padding.  With it (the number
    of an example's ids that bear loss, null for 0) examples stay whole; one beyond
    a limit raises ValueError.  Rows of one id are packed one by one; a null id
    stays null.  Columns: doc_id, start (ids of its document before the piece), ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (ids before it
    in the sequence), loss_tokens.  No rows give no rows.
    """
    vocabulary = byte_bpe.read(tokenizer or byte_bpe.default_path())
    rows = picked(docs, doc_id=id_column, text=text_column, **({"loss": loss_column} if loss_column else {})).withColumn("doc_id", F.col("doc_id").cast("long"))
    if loss_column:
        rows = rows.withColumn("loss", F.coalesce(F.col("loss").cast("long"), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(tokens, segments, loss_tokens, loss_column is None, TaskContext.get().partitionId() << 33)
        for batch in units.slices(batches, 1):
            ids, before = byte_bpe.batch_ids(batch.column(1), vocabulary)
            names = batch.column(0).to_pylist()
            loss = batch.column(2).to_pylist() if loss_column else None
            for k, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                own = np.empty(b - a + 1, dtype=np.uint32)
                own[:-1] = ids[a:b]
                own[-1] = END
                packer.add(Item(names[k], 0, own, len(own), loss[k] if loss else len(own) - 1))
            yield packer.pieces()
            give_back()
        packer.finish()
        yield packer.pieces()
        give_back()

    return map_batches(rows, run, SCHEMA)
