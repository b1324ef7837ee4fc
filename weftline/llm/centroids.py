"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with their multiplicities, in integers.

Vectors that quantise alike always share a cluster, so each round reads one row for
each distinct vector and weighs it by how many there are.  Distances, sums and means
are exact integers whatever the order in which tasks add them up: any loss of an
executor, any number of partitions gives the same clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import discard, give_back, hot_join, map_batches, materialised, picked

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Quantised components are below this, so that 64-bit squared distances can't overflow.
LIMIT = 1 << 27

_MOVED = "cluster int, n decimal(38,0), sums array<decimal(38,0)>"
_PLACED = "key binary, n long, cluster int, distance long"


def quantised(vector: str, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null if the vector doesn't have ``size`` components, all finite."""
    fine = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    far = F.exists(whole, lambda x: (x >= LIMIT) | (x < -LIMIT))
    return F.when(fine, F.when(far, F.raise_error(F.lit(f"a quantised component is not within {LIMIT}"))).otherwise(whole))


def seeds(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``clusters`` vectors of least sha256 of ``seed:vec_id``, in that order; fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(digest.alias("digest"), "vector").orderBy(F.col("digest").asc_nulls_last(), "vector").limit(clusters)
    return np.array([r.vector for r in first.collect()], dtype=np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first of the nearest centroids and the squared distance to it."""
    far = np.stack([np.square(vectors - c).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(far)), at]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moved(distinct: DataFrame, centroids: np.ndarray) -> list[np.ndarray | None]:
    """The weighted means of the vectors nearest to each centroid, floored; None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            weight, x = batch.column("n").to_numpy(), _matrix(batch.column("vector"))
            at, _ = nearest(x, centroids)
            # in machine integers where the batch's sums surely fit them
            if int(weight.sum()) * int(np.abs(x).max()) >= 1 << 62:
                weight, x = weight.astype(object), x.astype(object)
            found = np.unique(at)
            sums = [[Decimal(int(v)) for v in (x[at == k] * weight[at == k, None]).sum(axis=0)] for k in found]
            total = [Decimal(int(weight[at == k].sum())) for k in found]
            number = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total, number), pa.array(sums, pa.list_(number))], names=["cluster", "n", "sums"])
        give_back()

    parts = map_batches(distinct.select("n", "vector"), run, _MOVED)
    each = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()  # one row for each centroid at most
    out: list[np.ndarray | None] = [None] * len(centroids)
    for r in rows:
        out[r.cluster] = np.array([int(r[f"s{j}"]) // int(r.n) for j in range(centroids.shape[1])], dtype=np.int64)
    return out


def _placed(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, far = nearest(_matrix(batch.column("vector")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(at, pa.int32()), pa.array(far, pa.int64())], names=["key", "n", "cluster", "distance"])
        give_back()

    return map_batches(distinct.select("key", "n", "vector"), run, _PLACED)


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The cluster of each vector of ``size`` finite components, quantised to floor(scale * x).

    Columns: vec_id, cluster int, distance long (squared, to the final centroid),
    cluster_inertia and inertia long (distances summed over the cluster and over all
    rows), centroid_sha256 (of the final centroid's components, comma-joined).

    Other vectors (null, of another length, with null or non-finite components) have no
    row; no vectors give no rows.  Rows of one id are vectors of their own, and a null
    id stays null; null ids seed no cluster while others are left, equal ids are taken in
    order of their vectors.  Equal vectors that seed two clusters fall to the one of the
    smaller number, and the other keeps its centroid while it is empty.  With fewer
    vectors than ``clusters`` there are as many clusters as vectors.  A quantised
    component beyond LIMIT raises an error.  Other columns are ignored, whatever
    their names.

    Hot vectors (a third of all rows may be one) meet as counts: they are summed before
    the shuffle, and joined to their cluster where they stand.
    """
    rows = picked(vectors, vec_id=id_column, vector=vector_column).select(F.col("vec_id").cast("long").alias("vec_id"), quantised("vector", size, scale).alias("vector")).where("vector is not null")
    key = F.unhex(F.sha2(F.array_join("vector", ",").cast("binary"), 256))
    distinct = materialised(rows.groupBy("vector").agg(F.count("*").alias("n")).withColumn("key", key), "distinct-vectors")
    centroids = seeds(rows, clusters, seed)
    if not len(centroids):
        centroids = np.zeros((1, size), dtype=np.int64)  # no vectors: nothing will be near it
    for _ in range(rounds):
        moved = [old if new is None else new for old, new in zip(centroids, _moved(distinct, centroids), strict=True)]
        same = np.array_equal(moved, centroids)
        centroids = np.array(moved)
        if same:  # and so would be all later rounds
            break
    placed = materialised(_placed(distinct, centroids), "placed-vectors")
    discard(distinct)
    # one row for each centroid
    totals = placed.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance")).alias("far")).collect()
    far = {r.cluster: int(r.far) for r in totals}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = F.broadcast(placed.sparkSession.createDataFrame([(k, far.get(k, 0), sum(far.values()), d) for k, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    found = hot_join(rows.select("vec_id", key.alias("key")), placed, "key", rows.count())
    return found.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    place = """SELECT n, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT x.n, x.v, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM kept x CROSS JOIN {c} c) GROUP BY n, v"""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (
        SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept) ORDER BY h, v LIMIT {CLUSTERS})""",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({place.format(c=f'c{r - 1}')})")
        parts.append(f"""s{r} AS MATERIALIZED (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m FROM (
        SELECT k, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{r}) GROUP BY k, j)""")
        parts.append(f"""c{r} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r - 1} c LEFT JOIN (
        SELECT k, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY j) AS v FROM s{r} GROUP BY k) m ON c.k = m.k)""")
    parts.append(f"a AS MATERIALIZED ({place.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(parts)}
    SELECT x.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
        (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM kept x JOIN a ON x.n = a.n JOIN c{rounds} c ON a.k = c.k"""


ORACLE = _oracle()
