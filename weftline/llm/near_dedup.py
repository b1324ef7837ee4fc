"""Near-duplicate texts: MinHash bands propose pairs, odd sketches weigh them, full shingle sets decide.

1. One pass over the texts makes each document's set of word shingles and of it a
   fingerprint, MinHash values folded into bands, and an odd sketch: a bitmap in
   which each MinHash sample flips one bit, so that the XOR of two sketches has a
   population count from which a high similarity can be read precisely.  A second
   bitmap, in which each member of the set flips one bit, bounds the symmetric
   difference from below, and so rules out pairs with certainty.
2. Equal sets are one class, which is one node.  In each bucket every node is proposed to the smallest
   one only; what the sketches allow is verified on the full sets, and links are
   contracted to components.
3. Buckets that still hold several components are compared block by block, sketch
   against sketch; only pairs of different components that the sketches allow leave
   the kernel, and are verified likewise.  First each member's nearest alone, which
   connects most of a group of near copies; then all that is left.  So no pair of a
   bucket goes untested unless its ends are connected already, and no group is
   expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytehash as bh
from weftline.llm.components import connected_components
from weftline.llm.shared import BROADCAST_IDS, discard, give_back, hot_join, map_batches, materialised, picked, salted_join, semi

#: Similarity from which two documents are linked, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 75, 100
#: Words in a shingle.
WORDS = 5
#: Bands times rows; at a similarity of 0.75 a pair shares no band with a chance of 5e-6.
BANDS, ROWS = 32, 4
#: MinHash samples in a sketch, and its bits.
SAMPLES, BITS = 512, 1024
#: Pairs of a lower estimate aren't verified: with a chance of 4.4e-6 one of similarity 0.75, fewer than share no band.
FLOOR = 0.63
#: Members of a bucket compared in one kernel call; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
#: Members of smaller buckets that are compared together, on average.
TOGETHER = 2048

_RNG = np.random.Generator(np.random.PCG64(75))
_A = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SALT = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAFE_ROWS = 128


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a non-empty set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 256):
        part = _A[:, None] * x[None, i : i + 256]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples in each of BITS cells, as BITS/64 longs."""
    cell = bh.mix(_SALT ^ samples.astype(np.uint64)) & np.uint64(BITS - 1)
    odd = (np.bincount(cell.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity of the set's own members in each of BITS cells, as BITS/64 longs: two of them differ in no more cells than the sets in members."""
    odd = (np.bincount((bh.mix(shingles) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_odd(floor: float = FLOOR) -> int:
    """The largest XOR population count whose estimate 1 + BITS/(4 SAMPLES) ln(1 - 2 count/BITS) is at least ``floor``."""
    return int(BITS / 2 * (1 - np.exp((floor - 1) * 4 * SAMPLES / BITS)))


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return bh.mix((bh.mix(rows + _BAND) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    data, offsets = bh.text_buffer(texts)
    data = bh.lowered(data)
    starts, ends, first = bh.words(data, offsets)
    return bh.shingle_hashes(bh.hash_spans(data, starts, ends), first, words)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), _SAFE_ROWS):
                batch = whole.slice(i, _SAFE_ROWS)
                sizes, prints, sketches, parities, bands = [], [], [], [], []
                for found in shingle_sets(batch.column(1), words):
                    sizes.append(len(found))
                    prints.append(fingerprint(found) if len(found) else None)
                    samples = minhash(found) if len(found) else None
                    sketches.append(None if samples is None else odd_sketch(samples))
                    parities.append(None if samples is None else parity(found))
                    bands.append(None if samples is None else band_keys(samples))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (sketches, parities, bands)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), *lists], names=["doc_id", "n_shingles", "print", "sketch", "parity", "bands"])
            del whole
            give_back()

    return run


def _verify(words: int, numerator: int, denominator: int):
    """Of rows (a, b, print_a, text_a, print_b, text_b) those whose texts have these fingerprints and sets that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), _SAFE_ROWS):
                batch = whole.slice(i, _SAFE_ROWS)
                left, right = (shingle_sets(batch.column(k), words) for k in (3, 5))
                keep = []
                for a, b, print_a, print_b in zip(left, right, batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    near = common > 0 and denominator * common >= numerator * (len(a) + len(b) - common)
                    # an id may have several texts
                    keep.append(near and fingerprint(a) == print_a and fingerprint(b) == print_b)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            del whole
            give_back()

    return run


def _crossing(left: np.ndarray, right: np.ndarray, most: int, member: dict[str, np.ndarray], earlier: int, nearest: bool, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs between two blocks that differ in component, agree in no ``earlier`` band, and may be linked by sizes, parities and sketches.

    With ``nearest`` of each left row only the pair whose parities differ least for its sizes.
    """
    n, component = member["n"], member["component_id"]
    out_x, out_y = [], []
    for k in range(0, len(left), 64):
        part = left[k : k + 64]
        sizes = (denominator * n[part, None] >= numerator * n[None, right]) & (denominator * n[None, right] >= numerator * n[part, None])
        x, y = np.nonzero(sizes & (component[part, None] != component[None, right]))
        x, y = part[x], right[y]
        for bitmap, limit in (("parity", (denominator - numerator) * (n[x] + n[y]) // (denominator + numerator)), ("sketch", most)):
            far = np.zeros(len(x), dtype=np.int64)
            for c in range(member[bitmap].shape[1]):
                far += np.bitwise_count(member[bitmap][x, c] ^ member[bitmap][y, c])
            x, y = x[far <= limit], y[far <= limit]
        new = (member["bands"][x, :earlier] != member["bands"][y, :earlier]).all(axis=1)
        x, y = x[new], y[new]
        if nearest:
            far = np.bitwise_count(member["parity"][x] ^ member["parity"][y]).sum(axis=1, dtype=np.int64) / (n[x] + n[y])
            order = np.lexsort((y, far, x))
            x, y = x[order], y[order]
            first = np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]
            x, y = x[first], y[first]
        out_x.append(x)
        out_y.append(y)
    return np.concatenate(out_x), np.concatenate(out_y)


def _blocks(most: int, nearest: bool, numerator: int, denominator: int):
    """Pairs (a, b) that cross components in the buckets of a group: whole small buckets, or two blocks of a large one."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        member = {c: table.column(c).to_numpy()[order] for c in ("id", "component_id", "band", "key", "block", "n")}
        for c in ("sketch", "parity", "bands"):
            member[c] = table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(order), -1)[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key, id_ = member["key"], member["id"]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        a, b = [id_[:0]], [id_[:0]]
        for start, stop in zip(begin.tolist(), [*begin[1:].tolist(), len(id_)], strict=True):
            rows = np.arange(start, stop)
            left, right = rows[member["block"][rows] == i], rows[member["block"][rows] == j]
            if len(left) and len(right):
                # what agrees in an earlier band is found there
                x, y = _crossing(left, right, most, member, int(member["band"][start]), nearest, numerator, denominator)
                a.append(id_[x])
                b.append(id_[y])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def _crossing_pairs(held: DataFrame, total: int, nearest: bool, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of classes of one bucket and different components that may be linked; ``held`` (written) has id, component_id, n and signatures."""
    member = held.select("id", "component_id", F.posexplode("bands").alias("band", "key"))
    mixed = (
        member.groupBy("key")
        .agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("key", "n", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    )
    mixed = materialised(mixed, "mixed")
    few = mixed.agg(F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("n"))), F.lit(0))).first()[0]
    groups = max(1, few // TOGETHER)
    dealt = (
        hot_join(member, mixed, "key", BANDS * total)
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("group", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(groups))))
        .select("group", "band", "key", "id", "component_id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(held.select("id", "n", "sketch", "parity", "bands"), "id")
    )
    return dealt.groupBy("group", "i", "j").applyInArrow(_blocks(most_odd(), nearest, numerator, denominator), "a long, b long").distinct()


def _linked(pairs: DataFrame, own: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b) of classes whose full sets are similar enough; a text is a class's if it has its fingerprint."""
    total = pairs.count()
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(own.select("id", "node", "print"), "id")
    ends = materialised(ends, "candidates")
    wanted = ends if ends.count() > BROADCAST_IDS else F.broadcast(ends)
    few = texts.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")
    left = few.select(F.col("id").alias("a"), F.col("print").alias("print_a"), F.col("text").alias("text_a"))
    right = few.select(F.col("id").alias("b"), F.col("print").alias("print_b"), F.col("text").alias("text_b"))
    both = salted_join(pairs, left, "a", "b", total)
    both = salted_join(both, right, "b", "a", total).select("a", "b", "print_a", "text_a", "print_b", "text_b")
    return map_batches(both, _verify(words, numerator, denominator), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``words`` successive lower-cased
    words have ``denominator * intersection >= numerator * union``; a text of fewer
    words has the whole sequence as its only shingle, and one without words (null,
    empty, white space) links with nothing.  component_id is the smallest id that
    links reach, and kept tells whether it is the document's own.

    Rows of one id are one node of the graph, which has all their links, whether
    their texts agree or not.  A row without an id links with nothing: its
    component_id is null, and it is kept.  No rows give no rows.  Other columns of
    ``docs`` are ignored.
    """
    texts = picked(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = map_batches(texts, _signatures(words), "doc_id long, n_shingles long, print binary, sketch array<long>, parity array<long>, bands array<long>")
    made = materialised(made.withColumn("row", F.monotonically_increasing_id()), "signatures")
    total = made.count()
    nodes = made.where("doc_id is not null and print is not null")
    # a class of equal sets is named by one of its rows
    classes = nodes.groupBy("print").agg(F.min("row").alias("id"), F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = materialised(classes, "classes")
    signed = nodes.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "sketch", "parity", "bands")
    own = materialised(classes.select("id", "node", "print").join(signed, "id"), "own")

    # one proposal for each member of a bucket: its smallest class
    member = own.select("id", F.explode("bands").alias("key"))
    least = member.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    star = hot_join(member, least, "key", BANDS * total)
    star = materialised(star.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "proposals")
    bitmaps = own.select("id", "n", "sketch", "parity")
    alike = denominator * F.least("n_a", "n_b") >= numerator * F.greatest("n_a", "n_b")

    def odd(name: str) -> Column:
        return F.aggregate(F.zip_with(f"{name}_a", f"{name}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    near = ((denominator + numerator) * odd("parity") <= (denominator - numerator) * (F.col("n_a") + F.col("n_b"))) & (odd("sketch") <= most_odd())
    one = salted_join(star, bitmaps.toDF("a", "n_a", "sketch_a", "parity_a"), "a", "b", BANDS * total)
    two = one.join(bitmaps.toDF("b", "n_b", "sketch_b", "parity_b"), "b")
    pairs = materialised(two.where(alike & near).select("a", "b"), "pairs")
    discard(star)
    links = _linked(pairs, own, texts, words, numerator, denominator)

    # classes that share an id are linked by it
    twice = nodes.groupBy("doc_id").agg(F.min(F.xxhash64("print")).alias("low"), F.max(F.xxhash64("print")).alias("high")).where("low <> high").select("doc_id")
    named = hot_join(nodes.select("doc_id", "print"), classes.select("print", "id", F.col("copies").alias("n")), "print", total)
    shared = semi(named, materialised(twice, "twice"), "doc_id").groupBy("doc_id", "id").agg(F.lit(1)).select("doc_id", "id")
    first = shared.groupBy("doc_id").agg(F.min("id").alias("a"))
    links = links.unionByName(shared.join(first, "doc_id").where("a <> id").select("a", F.col("id").alias("b")))
    component = materialised(connected_components(links), "components")
    discard(pairs)

    # what is left of the buckets: members of several components, compared in blocks
    for nearest in (True, False):
        held = own.join(component, own["id"] == component["node"], "left").select("id", "n", "sketch", "parity", "bands", F.coalesce("component_id", "id").alias("component_id"))
        pairs = materialised(_crossing_pairs(materialised(held, "held"), total, nearest, numerator, denominator), "pairs")
        if pairs.isEmpty():
            break
        more = _linked(pairs, own, texts, words, numerator, denominator)
        component = materialised(connected_components(component.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(more)), "components")
        discard(pairs)

    # a component is named by its smallest document
    classes = classes.join(component, classes["id"] == component["node"], "left").select("print", "copies", classes["node"], F.coalesce("component_id", "id").alias("root"))
    root = classes.groupBy("root").agg(F.min("node").alias("component_id"), F.count("*").alias("n"))
    classes = materialised(hot_join(classes.select("print", "copies", "root"), root, "root", total).select("print", F.col("copies").alias("n"), "component_id"), "named")
    linked = hot_join(nodes.select("doc_id", "n_shingles", "print"), classes, "print", total).select("doc_id", "n_shingles", "component_id")
    # a document without words may share its id with one that has some
    alone = made.where("doc_id is null or print is null").select("doc_id", "n_shingles")
    wordless = materialised(alone.where("doc_id is not null").select("doc_id").distinct(), "wordless")
    elsewhere = semi(linked.select("doc_id", "component_id"), wordless, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(elsewhere, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without those that aren't the first of their component; of rows that repeat an id and a text one stays."""
    found = materialised(near_duplicates(docs, id_column, text_column), "near")
    gone = materialised(found.where("not kept").select(F.col("doc_id").alias(id_column)).distinct(), "gone")
    again = materialised(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(id_column)).agg(F.count("*").alias("n")).where("n > 1").select(id_column), "again")
    rest = semi(docs, gone, id_column, "left_anti")
    if again.isEmpty():
        return rest
    return semi(rest, again, id_column, "left_anti").unionByName(semi(rest, again, id_column).dropDuplicates([id_column, text_column]))


#: The same by comparing all documents that share a shingle, for small tables.
ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
    FROM w
), n AS (
    SELECT w.doc_id, count(s.doc_id) AS n_shingles FROM (SELECT DISTINCT doc_id FROM w) w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
    SELECT doc_id, doc_id AS m FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b
), c AS (
    SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id
)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id
"""

__all__ = ["BROADCAST_IDS", "ORACLE", "keep_first", "near_duplicates"]
