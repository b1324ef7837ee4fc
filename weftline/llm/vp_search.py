"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are dealt to shards of a bounded size, and queries to blocks; each pair of
a block and a shard is one task, which builds the shard's tree and walks it with
all queries of the block at once.  A subtree is left out if by the triangle
inequality it can't hold a vector within ``1/factor`` of the distance of the
k-th found so far: a factor of one gives exact results, larger ones prune more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import vectors
from weftline.llm.shared import give_back, map_batches, materialised, picked

K = 10
#: Relaxation of the pruning; one is exact.
FACTOR = 1.0
#: Vectors in a shard on average, and queries in a block.
SHARD, QUERIES = 8192, 8192
#: Vectors in a leaf, which are all compared.
LEAF = 128


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``; equal pairs of vectors have equal distances, to the last bit."""
    # differences, not products, and component by component: exact where vectors nearly agree, and summed in order
    far = np.zeros((len(a), len(b)))
    for q, x in zip(a.T, b.T, strict=True):
        gap = q[:, None] - x[None, :]
        far += gap * gap
    return np.sqrt(far, out=far)


class Tree:
    """A vantage-point tree over the rows of a matrix; each row is a vantage point or in a leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 5) -> None:
        self.x, self.leaf = x, leaf
        self._random = np.random.Generator(np.random.PCG64(seed))
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        # of a few candidates the one from which a sample's distances spread most
        sample = self.x[self._random.choice(rows, min(64, len(rows)), replace=False)]
        few = self._random.choice(rows, min(8, len(rows)), replace=False)
        point = few[int(np.argmax([np.var(np.linalg.norm(sample - self.x[c], axis=1)) for c in few]))]
        rest = rows[rows != point]
        far = distances(self.x[rest], self.x[[point]])[:, 0]
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        inner, outer = order[:half], order[half:]
        # least and greatest distance of either half; halves split equal distances too, so depth is logarithmic
        return (point, *((self._build(rest[o]), far[o[0]], far[o[-1]]) for o in (inner, outer)))


class Found:
    """The k nearest of each query so far: distances ascending, ties by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.far = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def put(self, which: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """Offers each query in ``which`` the candidates ``ids`` at distances ``far`` (one row for each query)."""
        k = self.far.shape[1]
        near = (far <= self.far[which, -1:]).any(axis=1)
        which, far = which[near], far[near]
        if not len(which):
            return
        all_far = np.concatenate((self.far[which], far), axis=1)
        all_ids = np.concatenate((self.ids[which], np.broadcast_to(ids, far.shape)), axis=1)
        best = np.lexsort((all_ids, all_far), axis=1)[:, :k]
        self.far[which] = np.take_along_axis(all_far, best, axis=1)
        self.ids[which] = np.take_along_axis(all_ids, best, axis=1)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> tuple[Found, int]:
    """The k nearest rows of ``tree`` to each query but its own, and the number of distances measured."""
    found, measured = Found(len(queries), k), 0
    # more than the relative error of a distance, a sum of so many squares
    error = 4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps

    def offer(which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        nonlocal measured
        measured += len(which) * len(rows)
        far = distances(queries[which], tree.x[rows])
        own = query_ids[which, None] == ids[None, rows]
        found.put(which, np.where(own, np.inf, far), ids[rows])
        return far

    def walk(node: tuple, which: np.ndarray) -> None:
        if not len(which):
            return
        if len(node) == 1:
            if len(node[0]):
                offer(which, node[0])
            return
        point, *children = node
        far = offer(which, np.array([point]))[:, 0]
        gap = [np.maximum(np.maximum(low - far, far - high), 0) for _, low, high in children]
        first = gap[0] <= gap[1]

        def visit(c: int, chosen: np.ndarray) -> None:
            # equal distances may still win by id, and rounding, which is relative to the distances that gap is the difference of, may not prune
            sure = gap[c][chosen] - error * (far[chosen] + children[c][2])
            near = sure * factor <= found.far[which[chosen], -1] * (1 + error)
            walk(children[c][0], which[chosen[near]])

        for c, chosen in ((0, np.flatnonzero(first)), (1, np.flatnonzero(~first)), (1, np.flatnonzero(first)), (0, np.flatnonzero(~first))):
            visit(c, chosen)

    walk(tree.root, np.arange(len(queries)))
    return found, measured


def _task(k: int, factor: float):
    import pandas as pd

    def run(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, asked = shard["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        tree = Tree(vectors.from_binary(shard["v"]))
        found, _ = search(tree, ids, vectors.from_binary(queries["v"]), asked, k, factor)
        real = np.isfinite(found.far)
        size = real.sum(axis=1)
        return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), size), "query_id": np.repeat(asked, size), "vec_id": found.ids[real], "score": found.far[real]})

    return run


def nearest(
    table: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    factor: float = FACTOR,
) -> DataFrame:
    """Of each row of ``queries`` the k nearest rows of ``table`` but those of its own id: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision; rank counts from 1,
    nearest first, ties to the smaller id.  With fewer candidates there are fewer
    rows.  Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part; rows that share an id are candidates one by
    one.  Of queries that share an id each is asked, and has rows of its own.  Vectors
    of different lengths raise ValueError.  Other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        df = picked(df, vec_id=id_column, v=vector_column).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
        return df.where("vec_id is not null").where(vectors.usable("v"))

    rows, asked = materialised(_packed(clean(table), "vec_id"), "vectors"), _packed(clean(queries).withColumnRenamed("vec_id", "query_id"), "query_id")
    asked = materialised(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    shards, blocks = max(1, math.ceil(rows.count() / SHARD)), max(1, math.ceil(asked.count() / QUERIES))
    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = asked.select("query", "query_id", "v", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    near = asking.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(_task(k, factor), "query long, query_id long, vec_id long, score double")
    # Spark keeps k rows of each query in a task before it shuffles them
    nth = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return near.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(df: DataFrame, key: str) -> DataFrame:
    """Vectors as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = vectors.matrix(batch.column(1)).astype("<f8")
            raw, size = x.tobytes(), x.shape[1] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i * size : (i + 1) * size] for i in range(len(x))], pa.binary())], names=[key, "v"])
            del batch
            give_back()

    return map_batches(df.select(key, "v"), run, f"{key} long, v binary")


#: The same by comparing every query with all rows.
ORACLE = f"""
WITH g AS (
    SELECT vec_id, row, e FROM (SELECT vec_id, row_number() OVER () AS row, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), d AS (
    SELECT q.row, q.vec_id AS query_id, g.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, g.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM g q JOIN g ON q.vec_id <> g.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score, vec_id) AS r FROM d) WHERE r <= {K}
"""
