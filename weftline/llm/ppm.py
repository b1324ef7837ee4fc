"""Language-model scores by partial matching: code lengths of texts in a byte-context trie.

The model is a trie of byte contexts up to ORDER bytes long, learned from the
training rows.  A byte's probability comes from the longest context that has been
seen; where the byte never followed it, the context's escape probability is paid and
the next shorter one is asked, without the bytes that the longer one already ruled
out (symbol exclusion).  Of a context with counts c of d different bytes, t in all,
byte x has (2 c(x) - 1) / 2t and the escape d / 2t; below the empty context all
symbols that are left are alike.  Each text ends with a symbol of its own, which is
coded too, so that probabilities of texts add up to one at most.

The trie is never in one place.  It is dealt into shards by the last three bytes of
the context, so that all longer contexts of a branch are in one shard (2^24 rows for
each three bytes at most); of shorter contexts there are 2^24 counts at most, which
all tasks get.  Texts are cut into blocks of rows; each block sends its distinct
contexts to the shards and gets back what they cost, and only then are the block's
texts read again and added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytehash as bh
from weftline.llm import units
from weftline.llm.shared import discard, give_back, map_batches, materialised, picked

#: Bytes of context; with its next byte a context fits into 48 bits.
ORDER = 5
#: Bytes of context that a shard's branches share.
STEM = 3
#: Before, and after, each text: a byte that UTF-8 doesn't use.
EDGE = 0xFF
#: Symbols that can follow a context.
SYMBOLS = 257
#: Bytes of text in a block, or one row.
BLOCK = 1 << 25
#: Grams that are made at once, and distinct keys that are held before they are added up.
PIECE = 1 << 20
#: Parts that the trie and the vocabulary are dealt into.
SHARDS = 512

#: Words stand in one value, with spaces between them.
_DEALT = "shard int, block long, grams array<long>, words binary, n array<long>"
_COSTS = "block long, grams array<long>, costs array<double>, words binary, n array<long>"


def low(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of context and the byte after them."""
    return grams & np.uint64((1 << 8 * (order + 1)) - 1)


def grams_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each byte of each text, and the end of each text, with ORDER bytes before it.

    In order and in pieces: the grams, the texts they are of, and where the grams of each of these begin.
    """
    sizes = np.diff(offsets)
    padded = np.full(len(data) + len(sizes) * (ORDER + 1), EDGE, dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * (ORDER + 1) + ORDER, sizes)] = data
    first = offsets + np.arange(len(offsets))  # grams before each text
    for a in range(0, int(first[-1]), PIECE):
        b = min(a + PIECE, int(first[-1]))
        texts = np.arange(np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, b, side="left"))
        bounds = np.clip(first[texts[0] : texts[-1] + 2], a, b)
        # text i's first gram starts at byte first[i] + i * ORDER
        at = np.arange(a, b) + np.repeat(texts * ORDER, np.diff(bounds))
        out = np.zeros(b - a, dtype=np.uint64)
        for j in range(ORDER + 1):
            out <<= np.uint64(8)
            out |= padded[at + j]
        yield out, texts, bounds[:-1] - a


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the index of each text's first word."""
    starts, ends, first = bh.words(data, offsets)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)]), first


@dataclass
class Level:
    """Contexts of one length: of each context and byte the count, and of each context its sum, bytes, and their sum in the context a byte shorter."""

    grams: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    shorter: np.ndarray

    def count(self, grams: np.ndarray) -> np.ndarray:
        at, known = found(self.grams, grams)
        return np.where(known, self.n[at], 0) if len(self.n) else np.zeros(len(grams), dtype=np.int64)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the ascending ``keys`` each wanted one is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the exact sum of each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], np.add.reduceat(n[order], begin)


def levels(grams: np.ndarray, n: np.ndarray, longest: int, shortest: int, below: Level | None = None) -> list[Level]:
    """The trie's levels from ``shortest`` to ``longest`` bytes of context, from counts of the longest; ``below`` is the level under the shortest."""
    counts = []
    for order in range(longest, shortest - 1, -1):
        grams, n = summed(low(grams, order), n)
        seen = n > 0
        counts.append((grams[seen], n[seen]))
    out: list[Level] = []
    for order, (grams, n) in zip(range(shortest, longest + 1), reversed(counts), strict=True):
        context = grams >> np.uint64(8)
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, dtype=np.int64)
        inner = out[-1] if out else below
        shorter = inner.count(low(grams, order - 1)) if inner is not None else np.zeros(len(grams), dtype=np.int64)
        total, under = (np.add.reduceat(x, begin) if len(begin) else np.zeros(0, dtype=np.int64) for x in (n, shorter))
        out.append(Level(grams, n, context[begin], total, np.diff(np.append(begin, len(context))), under))
    return out


def costs(grams: np.ndarray, trie: list[Level]) -> np.ndarray:
    """The log10 probability of each gram's last byte after its context; ``trie`` has a level for each length of context from none on."""
    out = np.zeros(len(grams))
    open_ = np.ones(len(grams), dtype=bool)
    ruled_out, ruled_out_n = np.zeros(len(grams), dtype=np.int64), np.zeros(len(grams), dtype=np.int64)
    for order in range(len(trie) - 1, -1, -1):
        level, own = trie[order], low(grams, order)
        at, known = found(level.contexts, own >> np.uint64(8))
        if not known.any():
            continue
        t = np.where(known, level.total[at] - ruled_out_n, 0)
        d = np.where(known, level.distinct[at] - ruled_out, 0)
        n = level.count(own)
        asked = open_ & (d > 0)
        hit, miss = asked & (n > 0), asked & (n == 0)
        out[hit] += np.log10((2 * n[hit] - 1) / (2 * t[hit]))
        out[miss] += np.log10(d[miss] / (2 * t[miss]))
        open_ &= ~hit
        ruled_out, ruled_out_n = np.where(known, level.distinct[at], ruled_out), np.where(known, level.shorter[at], ruled_out_n)
    out[open_] -= np.log10(SYMBOLS - ruled_out[open_])
    return out


def joined(words: pa.Array) -> bytes:
    """Words with spaces between them."""
    data, offsets = bh.text_buffer(words)
    out = np.full(len(data) + len(words), 0x20, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = data
    return out.tobytes()


def parted(words: bytes) -> pa.Array:
    return words_of(np.frombuffer(words, dtype=np.uint8), np.array([0, len(words)]))[0]


def merged_words(words: list[pa.Array], n: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the exact sum of each."""
    names = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    total = np.zeros(len(names.dictionary), dtype=np.int64)
    np.add.at(total, names.indices.to_numpy(), np.concatenate([*n, np.zeros(0, dtype=np.int64)]))
    return names.dictionary, total


class Sums:
    """Counts of keys that come in parts, added up each time the parts outgrow what they add up to."""

    def __init__(self, merge: Callable) -> None:
        self._merge, self._limit, self._held = merge, PIECE, 0
        self._keys: list = []
        self._n: list[np.ndarray] = []

    def add(self, keys: np.ndarray | pa.Array, n: np.ndarray) -> None:
        self._keys.append(keys)
        self._n.append(n)
        self._held += len(n)
        if self._held > self._limit:
            keys, n = self.total()
            self._keys, self._n, self._held, self._limit = [keys], [n], len(n), max(PIECE, 2 * len(n))

    def total(self) -> tuple[np.ndarray | pa.Array, np.ndarray]:
        return self._merge(self._keys, self._n)


def merged_grams(grams: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate(grams), np.concatenate(n))


def _counted(slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[pa.Array, np.ndarray]]:
    """Distinct grams and words of texts (bytes, offsets, whether to learn from each), and how often texts to learn from have them."""
    grams, words = Sums(merged_grams), Sums(merged_words)
    for data, offsets, learn in slices:
        for own, texts, begin in grams_of(data, offsets):
            kinds = pa.array(own).dictionary_encode()
            weight = np.repeat(learn[texts], np.diff(np.append(begin, len(own))))
            grams.add(kinds.dictionary.to_numpy(), np.bincount(kinds.indices.to_numpy()[weight], minlength=len(kinds.dictionary)))
        every, first = words_of(data, offsets)
        names = every.dictionary_encode()
        weight = np.repeat(learn, np.diff(first))
        words.add(names.dictionary, np.bincount(names.indices.to_numpy()[weight], minlength=len(names.dictionary)))
    return grams.total(), words.total()


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def gram_shards(grams: np.ndarray) -> np.ndarray:
    """Each gram's shard: by the last STEM bytes of its context."""
    return (bh.mix(low(grams, STEM) >> np.uint64(8)) % np.uint64(SHARDS)).astype(np.int32)


def word_shards(words: pa.Array) -> np.ndarray:
    data, offsets = bh.text_buffer(words)
    return (bh.hash_spans(data, offsets[:-1], offsets[1:]) % np.uint64(SHARDS)).astype(np.int32)


def _by_shard(shard: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in ``order`` the shards there are and where each begins (one more at the end)."""
    keys, bounds = np.unique(shard[order], return_index=True)
    return keys, np.append(bounds, len(order))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Of each block and shard a row with its grams and counts, one with its words and counts; and of each block one of shard -1 with the grams of order STEM - 1."""

    def rows(block: int, waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        (grams, n), (words, times) = _counted(waiting)
        stems, m = summed(low(grams, STEM - 1), n)
        shard = gram_shards(grams)
        order = np.lexsort((grams, shard))
        keys, bounds = _by_shard(shard, order)
        keys, ends = np.append(np.int32(-1), keys), np.append(0, len(m) + bounds)
        values = [_lists(np.append(stems, grams[order]).astype(np.int64), ends, pa.int64()), pa.nulls(len(keys), pa.binary()), _lists(np.append(m, n[order]), ends, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(np.full(len(keys), block)), *values], names=["shard", "block", "grams", "words", "n"])
        if len(words):
            shard = word_shards(words)
            order = np.argsort(shard, kind="stable")
            keys, ends = _by_shard(shard, order)
            values = [pa.nulls(len(keys), pa.list_(pa.int64())), pa.array([joined(words.take(pa.array(order[a:b]))) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()), _lists(times[order], ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(np.full(len(keys), block)), *values], names=["shard", "block", "grams", "words", "n"])
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        block = 0
        for batch in units.slices(batches, 0):
            data, offsets = bh.text_buffer(batch.column(0))
            data, own, learn = bh.lowered(data), batch.column(1).to_numpy(), ~batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if waiting and own[a] != block:
                    yield from rows(block, waiting)
                    waiting = []
                block = int(own[a])
                waiting.append((data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], learn[a:b]))
        if waiting:
            yield from rows(block, waiting)

    return map_batches(blocks.select("text", "block", "held_out"), run, _DEALT)


def _answered(dealt: DataFrame, stems: list[Level]) -> DataFrame:
    """What each block's grams cost, and the counts of its words that texts to learn from have; in block -1 the sum and the number of a shard's words.

    Each shard's rows come twice, in order: first all are added up, then each gets its answer.
    So memory holds a shard's distinct contexts, however many blocks there are.
    """
    again = F.explode(F.array(F.lit(0), F.lit(1))).alias("again")
    twice = dealt.where("shard >= 0").select("shard", F.col("words").isNotNull().alias("is_word"), again, F.when(F.col("again") == 1, F.col("block")).alias("block"), "grams", "words", F.when(F.col("again") == 0, F.col("n")).alias("n"))
    twice = twice.repartition("shard").sortWithinPartitions("shard", "is_word", "again")

    def one(block: int, grams: np.ndarray | None, cost: np.ndarray | None, words: bytes | None, n: np.ndarray | None) -> pa.RecordBatch:
        def cell(values: object, kind: pa.DataType) -> pa.Array:
            return pa.nulls(1, pa.list_(kind)) if values is None else _lists(values, np.array([0, len(values)]), kind)

        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), cell(grams, pa.int64()), cell(cost, pa.float64()), pa.array([words], pa.binary()), cell(n, pa.int64())], names=["block", "grams", "costs", "words", "n"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, False
        sums, price = Sums(merged_grams), np.zeros(0)
        for batch in batches:
            shards, is_word, again, blocks = (batch.column(k).to_pylist() for k in range(4))
            for i, kind in enumerate(zip(shards, is_word, strict=True)):
                if kind != now:
                    now, ready, sums = kind, False, Sums(merged_words if kind[1] else merged_grams)
                words = is_word[i]
                own = parted(batch.column(5)[i].as_py()) if words else batch.column(4)[i].values.to_numpy().astype(np.uint64)
                if again[i] == 0:
                    sums.add(own, batch.column(6)[i].values.to_numpy())
                    continue
                if not ready:
                    ready = True
                    names, total = sums.total()
                    if words:
                        seen = total > 0
                        names, total = names.filter(pa.array(seen)), total[seen]
                        yield one(-1, None, None, None, np.array([total.sum(), len(total)]))
                    else:
                        price = costs(names, [*stems, *levels(names, total, ORDER, STEM, stems[-1])])
                if words:
                    at = pc.index_in(own, value_set=names)
                    known = at.is_valid()
                    yield one(blocks[i], None, None, joined(own.filter(known)), total[at.drop_null().to_numpy()])
                else:
                    yield one(blocks[i], own.astype(np.int64), price[np.searchsorted(names, own)], None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for made in answers(batches):
            waiting.append(made)
            if len(waiting) == 256:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting = []
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
        give_back()

    return map_batches(twice, run, _COSTS)


def _summed_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Of each of a block's texts its words, those known, the sum of log10(count + 1) and its log10 probability."""
    cells = answers.combine_chunks()
    grams, price = (pc.list_flatten(cells.column(k)).combine_chunks().to_numpy() for k in ("grams", "costs"))
    order = np.argsort(grams, kind="stable")
    grams, price = grams[order].astype(np.uint64), price[order]
    with_words = cells.filter(pc.is_valid(cells.column("words")))
    names = parted(b"".join(with_words.column("words").to_pylist()))
    times = pc.list_flatten(with_words.column("n")).combine_chunks().to_numpy()
    out: list[pa.RecordBatch] = []
    for part in units.slices(iter(texts.combine_chunks().to_batches()), 1):
        data, offsets = bh.text_buffer(part.column(1))
        data = bh.lowered(data)
        score = np.zeros(len(part))
        for own, rows, begin in grams_of(data, offsets):
            kinds = pa.array(own).dictionary_encode()
            at, known = found(grams, kinds.dictionary.to_numpy())
            if not known.all():
                raise RuntimeError("a block's texts have changed since it was counted")
            score[rows] += np.add.reduceat(price[at][kinds.indices.to_numpy()], begin)
        every, first = words_of(data, offsets)
        kinds = every.dictionary_encode()
        at = pc.fill_null(pc.index_in(kinds.dictionary, value_set=names), -1).to_numpy()
        n = np.where(at >= 0, times[at], 0)[kinds.indices.to_numpy()] if len(times) else np.zeros(len(every), dtype=np.int64)
        known_before, log_before = np.append(0, np.cumsum(n > 0)), np.log10(n + 1.0)
        logs = np.array([log_before[a:b].sum() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
        out.append(pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(first)), pa.array(known_before[first[1:]] - known_before[first[:-1]]), pa.array(logs, pa.float64()), pa.array(score)], names=["doc_id", "held_out", "n_words", "n_known", "logs", "score"]))
    give_back()
    return pa.Table.from_batches(out)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out_column: str | None = None) -> DataFrame:
    """The log10 probability of each whole text, learned from the rows that aren't held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens long, base_score and score
    double.  A-Z count as lower case, for both scores.  ``score`` is that of the model of
    this module, over the text's UTF-8 bytes and its end.  ``base_score`` is of single
    words ``[^\\x20\\x09-\\x0D]+`` and an end of text, which is a token: the sum of
    log10((c + 1) / (N + V + 1)), c being the token's count, N the number of all tokens and
    V that of different ones to learn from.  n_known counts tokens with c > 0.

    A row is held out where ``held_out_column`` is true (null is not), or without it where
    crc32(id as text) modulo 7 is 2; a null id is not, and stays null.  A null text is empty,
    and an empty one is its end alone.  Rows of one id are texts of their own.  With nothing
    to learn from, N and V are 0 and all symbols alike.  No rows give no rows.  Other
    columns are ignored, whatever their names.
    """
    named = {"doc_id": id_column, "text": text_column} | ({"held_out": held_out_column} if held_out_column else {})
    rows = picked(docs, **named)
    held_out = F.col("held_out").cast("boolean") if held_out_column else F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    @F.pandas_udf("long")
    def block(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 32, 0
        for size in sizes:
            before = done + np.cumsum(size.to_numpy())
            done = int(before[-1]) if len(before) else done
            yield pd.Series(base + before // BLOCK)

    blocks = materialised(rows.withColumn("block", block(F.octet_length("text"))), "text-blocks")
    dealt = materialised(_dealt(blocks), "block-counts")
    # 2^24 rows at most: three bytes each
    few = dealt.where("shard = -1").select(F.explode(F.arrays_zip("grams", "n")).alias("x")).groupBy(F.col("x.grams").alias("gram")).agg(F.sum("x.n").alias("n")).where("n > 0").toArrow()
    stems = levels(few.column("gram").to_numpy().astype(np.uint64), few.column("n").to_numpy(), STEM - 1, 0)
    answers = materialised(_answered(dealt, stems), "block-costs")
    discard(dealt)
    known = answers.where("block = -1").agg(F.sum(F.col("n")[0]).alias("words"), F.sum(F.col("n")[1]).alias("kinds")).first()
    ends = blocks.where("not held_out").count()
    total, kinds = (known.words or 0) + ends, (known.kinds or 0) + (ends > 0)

    texts = blocks.select("doc_id", "text", "held_out", "block").groupBy("block")
    parts = texts.cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(_summed_up, "doc_id long, held_out boolean, n_words long, n_known long, logs double, score double")
    n_tokens = F.col("n_words") + 1
    base = F.col("logs") + float(np.log10(ends + 1.0)) - n_tokens * float(np.log10(total + kinds + 1.0))
    return parts.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
