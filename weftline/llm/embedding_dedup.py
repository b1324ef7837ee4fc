"""Near-duplicate vectors: sign hashes of random hyperplanes propose, cosines decide, components join.

Each of several tables deals the vectors out by the signs of their products with a
few random hyperplanes.  A bucket is compared block by block, in matrix products;
a pair that several tables propose counts in the first of them only, so no pairs
have to be gathered to be counted.  What leaves a block is a count for each vector
and a spanning forest of the block's links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import vectors
from weftline.llm.components import connected_components
from weftline.llm.shared import discard, give_back, hot_join, map_batches, materialised, picked, semi

COSINE = 0.9
#: Chance that a pair at the threshold meets in no table.
MISS = 1e-4
#: Vectors in a bucket, if all directions were alike.
BUCKET = 256
#: Vectors in a block; a bucket of more is dealt out as pairs of blocks.
BLOCK = 1024
MOST_BITS = 24
#: More than a cosine's error in a product of matrices of normalised doubles; nearer pairs are measured again.
ROUNDING = 1e-12


def tables_for(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a hash, from the number of vectors, and tables that leave a pair at the threshold unmet with chance ``miss``."""
    bits = min(MOST_BITS, max(4, round(math.log2(max(1, rows) / BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def _hashes(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        weigh = np.int64(1) << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for k in range(0, len(whole), 2048):
                batch = whole.slice(k, 2048)
                x = vectors.matrix(batch.column(1))
                if planes is None or planes.shape[0] != x.shape[1]:
                    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((x.shape[1], bits * tables))
                keys = (x @ planes > 0).reshape(len(x), tables, bits) @ weigh
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.astype(np.int32).ravel()))
                raw = x.astype("<f8").tobytes()
                size = x.shape[1] * 8
                yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array([raw[i * size : (i + 1) * size] for i in range(len(x))], pa.binary()), lists, batch.column(2)], names=["id", "v", "keys", "copies"])
            del whole
            give_back()

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between n nodes, by rounds of hanging each root on a smaller one."""
    root = np.arange(n)
    out_a, out_b = [], []
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        _, first = np.unique(high, return_index=True)
        out_a.append(a[first])
        out_b.append(b[first])
        root[high[first]] = low[first]
        while (jumped := root[root]).tolist() != root.tolist():
            root = jumped
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` with the same rows of ``b``, from sums of products in extended precision."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


def _blocks(cosine: float):
    """Of one pair of blocks of a bucket: (id, n, null, false) counts of new links, and (id, 0, other, true) links of a forest."""

    def run(rows: pa.Table) -> pa.Table:
        table, block = rows.column("table")[0].as_py(), rows.column("block").to_numpy()
        ids, weight = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        v = vectors.from_binary(rows.column("v").to_pylist())
        keys = rows.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        count, a, b = np.zeros(len(ids), dtype=np.int64), [], []
        for k in range(0, len(left), 256):
            part = left[k : k + 256]
            found = unit[part] @ unit[right].T
            x, y = np.nonzero(found >= cosine - ROUNDING)
            near = found[x, y] < cosine + ROUNDING
            x, y = part[x], right[y]
            # what a matrix product can't decide is measured again
            sure = ~near
            sure[near] = cosines(v[x[near]], v[y[near]]) >= cosine
            x, y = x[sure], y[sure]
            if i == j:
                x, y = x[x < y], y[x < y]
            new = np.ones(len(x), dtype=bool)
            for t in range(table):
                new &= keys[x, t] != keys[y, t]
            x, y = x[new], y[new]
            np.add.at(count, x, weight[y])
            np.add.at(count, y, weight[x])
            a.append(x)
            b.append(y)
        a, b = _forest(np.concatenate(a), np.concatenate(b), len(ids)) if a else (np.zeros(0, int), np.zeros(0, int))
        some = np.flatnonzero(count)
        return pa.table(
            {
                "id": np.concatenate((ids[some], ids[a])),
                "n": np.concatenate((count[some], np.zeros(len(a), dtype=np.int64))),
                "other": np.concatenate((np.zeros(len(some), dtype=np.int64), ids[b])),
                "link": np.concatenate((np.zeros(len(some), dtype=bool), np.ones(len(a), dtype=bool))),
            }
        )

    return run


def near_duplicate_vectors(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, miss: float = MISS, seed: int = 17
) -> DataFrame:
    """One row for each row of ``table``: vec_id, n_links, component_id, kept.

    Two vectors are linked if they meet in one of the tables and their cosine, in
    double precision, is at least ``cosine``; equal vectors always are.  n_links
    counts the other rows linked directly, of whatever id; component_id is the
    smallest id that links reach, and kept tells whether it is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing.  Rows that share an id are one node of the graph, whether their
    vectors agree or not.  A row without an id links with nothing: its component_id
    is null, and it is kept.  Vectors of different lengths raise ValueError.  No
    rows give no rows; other columns are ignored.
    """
    rows = picked(table, vec_id=id_column, v=vector_column).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    good = rows.where("vec_id is not null").where(vectors.usable("v"))
    # equal vectors, -0 being 0, are one class with their number, which is named by one of its rows
    tagged = good.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), F.monotonically_increasing_id().alias("row"))
    tagged = materialised(tagged.withColumn("print", F.sha2(F.to_binary(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.lit("utf-8")), 256)), "vectors")
    total = tagged.count()
    classes = materialised(tagged.groupBy("print").agg(F.min("row").alias("id"), F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    bits, tables = tables_for(classes.count(), cosine, miss)
    first = classes.select("id", "copies").join(tagged.select(F.col("row").alias("id"), "v"), "id")
    hashed = materialised(map_batches(first.select("id", "v", "copies"), _hashes(bits, tables, seed), "id long, v binary, keys array<int>, copies long"), "hashed")
    key = hashed.select("id", F.posexplode("keys").alias("table", "key"))
    size = key.groupBy("table", "key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    size = size.select(F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("key").cast("long")).alias("bucket"), "blocks", "n")
    member = hashed.select("id", "copies", "v", "keys", F.posexplode("keys").alias("table", "key"))
    member = member.withColumn("bucket", F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("key").cast("long")))
    dealt = (
        hot_join(member, size, "bucket", tables * total)
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("bucket", "table", "id", "copies", "v", "keys", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    )
    found = materialised(dealt.groupBy("bucket", "i", "j").applyInArrow(_blocks(cosine), "id long, n long, other long, link boolean"), "found")
    count = found.where("not link").groupBy("id").agg(F.sum("n").alias("n"))
    # classes that share an id are linked by it
    twice = materialised(tagged.groupBy("vec_id").agg(F.min(F.xxhash64("print")).alias("low"), F.max(F.xxhash64("print")).alias("high")).where("low <> high").select("vec_id"), "twice")
    named = hot_join(tagged.select("vec_id", "print"), classes.select("print", "id", F.col("copies").alias("n")), "print", total)
    shared = semi(named, twice, "vec_id").groupBy("vec_id", "id").agg(F.lit(1)).select("vec_id", "id")
    least = shared.groupBy("vec_id").agg(F.min("id").alias("a"))
    links = found.where("link").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(shared.join(least, "vec_id").where("a <> id").select("a", F.col("id").alias("b")))
    joined = connected_components(links).withColumnRenamed("node", "id")
    named = classes.join(count, "id", "left").join(joined, "id", "left")
    named = named.select("print", "copies", "node", (F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("root"))
    named = materialised(named, "named")
    root = named.groupBy("root").agg(F.min("node").alias("component_id"), F.count("*").alias("n"))
    classes = materialised(hot_join(named.select("print", "copies", "n_links", "root"), root, "root", total).select("print", F.col("copies").alias("n"), "n_links", "component_id"), "classes")
    discard(found, hashed, named)
    linked = hot_join(tagged.select("vec_id", "print"), classes, "print", total).select("vec_id", "n_links", "component_id")
    # an unusable vector may share its id with a usable one
    alone = rows.where(F.col("vec_id").isNull() | ~vectors.usable("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    useless = materialised(alone.where("vec_id is not null").select("vec_id").distinct(), "useless")
    elsewhere = semi(linked.select("vec_id", "component_id"), useless, "vec_id").groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(elsewhere, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same by comparing all pairs, for small tables.
ORACLE = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, row_number() OVER () AS row, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
    SELECT vec_id, row, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
    SELECT x.row, x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.row <> y.row AND (x.e = y.e OR list_cosine_similarity(x.e, y.e) >= {COSINE})
), e AS (
    SELECT DISTINCT a, b FROM l WHERE a <> b
), n AS (
    SELECT row, count(*) AS n_links FROM l GROUP BY row
), r AS (
    SELECT vec_id, vec_id AS m FROM v UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.vec_id WHERE r.m < e.b
), c AS (
    SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, true) AS kept
FROM v JOIN c ON c.vec_id IS NOT DISTINCT FROM v.vec_id LEFT JOIN n ON n.row = v.row
"""
