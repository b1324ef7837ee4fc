"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

P(grade > k) = 1 / (1 + exp(cut_k - w.x)): one weight for each feature serves all
thresholds, which ascend.  Features are words and word beginnings of three to six
bytes; which of them serve is found in distributed counts over the sampled labelled
rows.  A feature's value is log(1 + 100 x its share of the text's words), so a text's
length alone changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytehash as bh
from weftline.llm import units
from weftline.llm.shared import give_back, index_of, map_batches, materialised, picked, widened, without

#: Labelled rows that the model is fitted on, the first by hash of their id; all are used if there are fewer.
TRAIN_ROWS = 8192
#: Features with a weight, and documents of the sample that must hold one.
FEATURES, LEAST_DOCS = 4096, 3
#: Bytes of a word's beginning that are features beside the word.
BEGINNINGS = (3, 4, 5, 6)
#: Grades: clean, toxic, and toxic more densely than half of the toxic sample.  Labels know toxic or not; the third grade is a construction,
#: by the share of a text that is made of features which the sample has in toxic texts alone.
GRADES = 3
#: Of the sampled rows one in so many, by hash of the id, is held out: on these the penalty and the probability of rejection are chosen.
HELD_OUT = 5
#: Penalties tried, and clean documents rejected that weigh as much as one toxic document missed, inverted.
PENALTIES, CLEAN_WEIGHT = (1e-4, 1e-3, 1e-2), 10.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and of each row the number of words: one (row, key) for each word's features, keys being 64-bit hashes.

    Words are runs of ASCII letters and digits, A-Z in lower case, and of all other characters beyond ASCII.
    """
    data, offsets = bh.text_buffer(texts)
    data = bh.lowered(data)
    starts, ends = bh.spans_of(_LETTER[data], offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    rows, keys = [row], [bh.hash_spans(data, starts, ends)]
    for k, size in enumerate(BEGINNINGS):
        long = np.flatnonzero(ends - starts >= size)
        rows.append(row[long])
        keys.append(bh.mix(bh.hash_spans(data, starts[long], starts[long] + size) + np.uint64(k + 1)))
    return np.concatenate(rows), np.concatenate(keys), np.bincount(row, minlength=len(texts))


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) with their counts."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return rows[at], keys[at], np.diff(np.append(at, len(rows)))


def _value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100.0 * count / np.maximum(1, words))


@dataclass(frozen=True)
class Model:
    """Sorted feature keys with their weights, the ascending cuts, and the probability of being toxic at all from which a document is rejected."""

    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    reject: float = 0.5

    def margins(self, texts: pa.Array) -> np.ndarray:
        """w.x of each text; a text without words has 0."""
        rows, keys, words = features(texts)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1) if len(self.keys) else np.zeros(len(keys), dtype=np.int64)
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        rows, at, count = _distinct(rows[known], at[known])
        return np.bincount(rows, self.weights[at] * _value(count, words[rows]), minlength=len(texts))

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text for each k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - margins[:, None], -500, 500)))


def fit_cumulative(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that maximise the penalised likelihood of the grades, by Adam; cuts are the first and positive gaps."""
    n, k = len(grades), n_grades - 1
    above = (grades[:, None] > np.arange(k)).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    params = np.concatenate((np.zeros(n_features), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, cuts = params[:n_features], np.cumsum(np.concatenate((params[n_features : n_features + 1], np.exp(params[n_features + 1 :]))))
        score = np.bincount(rows, weights[columns] * values, minlength=n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500)))
        edge = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)  # P(grade >= 0), ..., 0
        own = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-12)
        slope = edge * (1 - edge)
        d_low, d_high = slope[np.arange(n), grades] / own, slope[np.arange(n), grades + 1] / own
        grad_score = -(d_low - d_high) / n
        grad = np.empty_like(params)
        grad[:n_features] = np.bincount(columns, grad_score[rows] * values, minlength=n_features) + penalty * weights
        by_cut = np.zeros(k)
        np.add.at(by_cut, grades[grades > 0] - 1, d_low[grades > 0] / n)
        np.add.at(by_cut, grades[grades < k], -d_high[grades < k] / n)
        grad[n_features] = by_cut.sum()
        grad[n_features + 1 :] = [by_cut[j:].sum() * np.exp(params[n_features + j]) for j in range(1, k)]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return params[:n_features], np.cumsum(np.concatenate((params[n_features : n_features + 1], np.exp(params[n_features + 1 :]))))


def rejection(probability: np.ndarray, toxic: np.ndarray) -> float:
    """The probability from which rejecting errs least on held-out rows; of several the middle by log-odds, 0.5 without rows of both kinds."""
    if not toxic.any() or toxic.all():
        return 0.5
    odds = np.log(np.clip(probability, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(probability, 1e-12, 1 - 1e-12))
    order = np.argsort(odds, kind="stable")
    odds, toxic = odds[order], toxic[order]
    # rejecting from the k-th row on; a cut between equal rows can't be made
    missed = np.concatenate(([0], np.cumsum(toxic)))
    hurt = (~toxic).sum() - np.concatenate(([0], np.cumsum(~toxic)))
    cost = missed + CLEAN_WEIGHT * hurt
    able = np.concatenate(([True], odds[1:] > odds[:-1], [True]))
    best = np.flatnonzero(able & (cost == cost[able].min()))
    low = odds[best[0] - 1] if best[0] else odds[0] - 1
    high = odds[best[-1]] if best[-1] < len(odds) else odds[-1] + 1
    return float(1 / (1 + np.exp(-(low + high) / 2)))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents (label 0 or 1; others, nulls and ids without a text are left out).

    Penalty and probability of rejection are chosen on rows that are held out of the fitting; then the weights are fitted on all of
    them.  Without a toxic or a clean row the model has no features and calls nothing toxic (or, without clean rows, as likely as not).
    """
    known = picked(labels, doc_id=id_column, grade=label_column).select(F.col("doc_id").cast("long"), F.col("grade").cast("int")).where("doc_id is not null and grade in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = picked(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long")).where("text is not null")
    chosen = materialised(chosen, "labelled")
    # at most TRAIN_ROWS rows of two numbers
    sample = materialised(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in units.slices(batches, 2):
            found, keys, _ = features(batch.column(2))
            found, keys, _ = _distinct(found, keys)
            toxic = batch.column(1).to_numpy()[found]
            kinds, of = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(of, toxic).astype(np.int64)), pa.array(np.bincount(of))], names=["key", "toxic", "docs"])

    total = sample.agg(F.count("*"), F.coalesce(F.sum("grade"), F.lit(0))).first()
    n, n_toxic = int(total[0]), int(total[1])
    if not n_toxic or n_toxic == n:
        none = np.zeros(0)
        return Model(none.astype(np.uint64), none, np.array([30.0, 31.0]) if not n_toxic else np.array([0.0, 30.0]))
    counts = map_batches(sample.select("doc_id", "grade", "text"), count, "key long, toxic long, docs long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")).where(F.col("docs") >= min(LEAST_DOCS, n_toxic))
    expected = F.col("docs") * (n_toxic / n)
    strength = (F.col("toxic") - expected) * F.abs(F.col("toxic") - expected) / expected
    best = counts.withColumn("strength", strength).orderBy(F.abs("strength").desc(), "key").limit(FEATURES).select("key", "toxic", "docs").toPandas()
    order = np.argsort(best["key"].to_numpy().view(np.uint64))
    keys = best["key"].to_numpy().view(np.uint64)[order]
    # features of toxic texts alone: their density tells the second grade from the third
    marked = ((best["toxic"] == best["docs"]).to_numpy()[order]).astype(np.int64)

    def known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in units.slices(batches, 2):
            found, key, words = features(batch.column(2))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            found, at, times = _distinct(found[hit], at[hit])
            size = np.bincount(found, minlength=len(batch))
            bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            value = _value(times, words[found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.astype(np.float32)))],
                names=["doc_id", "grade", "columns", "values"],
            )

    fitted = map_batches(sample, known_features, "doc_id long, grade int, columns array<int>, values array<float>").toPandas().sort_values("doc_id")
    grades = fitted["grade"].to_numpy().astype(np.int64)
    size = fitted["columns"].map(len).to_numpy()
    row = np.repeat(np.arange(len(fitted)), size)
    column = np.concatenate([*fitted["columns"], np.zeros(0, dtype=np.int32)]).astype(np.int64)
    value = np.concatenate([*fitted["values"], np.zeros(0, dtype=np.float32)]).astype(np.float64)
    density = np.bincount(row, value * marked[column], minlength=len(fitted))
    grades[(grades == 1) & (density > np.median(density[grades == 1]))] = 2
    held = (bh.mix(fitted["doc_id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(HELD_OUT)) == 0
    toxic = grades > 0
    if not (toxic & held).any() or not (toxic & ~held).any():
        weights, cuts = fit_cumulative(row, column, value, grades, len(keys), GRADES, PENALTIES[1])
        return Model(keys, weights, cuts)
    taught, number, best = ~held[row], np.cumsum(~held) - 1, None
    for penalty in PENALTIES:
        weights, cuts = fit_cumulative(number[row[taught]], column[taught], value[taught], grades[~held], len(keys), GRADES, penalty)
        p = np.clip(Model(keys, weights, cuts).probabilities(np.bincount(row, weights[column] * value, minlength=len(fitted))[held])[:, 0], 1e-9, 1 - 1e-9)
        loss = -np.mean(np.where(toxic[held], np.log(p), np.log1p(-p)))
        if best is None or loss < best[0]:
            best = loss, penalty, rejection(p, toxic[held])
    weights, cuts = fit_cumulative(row, column, value, grades, len(keys), GRADES, best[1])
    return Model(keys, weights, cuts, best[2])


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (the expected grade, 0 to 2), ``toxic_probability`` (of grade 1 or 2) and ``severity_grade`` (the likeliest).

    Null and empty texts are scored as texts without features.  All rows and columns
    stay, but ones named like the new ones, in capitals or not, are replaced.
    """
    new = {"severity": "double", "toxic_probability": "double", "severity_grade": "int"}
    docs = without(docs, *new)
    at = index_of(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in units.slices(batches, at):
            above = model.probabilities(model.margins(batch.column(at)))
            edge = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
            grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade)], names=[*batch.schema.names, *new])

            del batch
            give_back()

    return map_batches(docs, run, widened(docs, **new))
