"""Tables that cut lineage in the folder that driver and executors share, joins that stand hot keys, columns by name, and memory of Python workers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A side of a join of so many longs at most (8 MB) may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1 << 20
#: Rows of a key from which it counts as hot, and the most keys that may: among more rows a hot key needs more of them.
HOT_ROWS, HOT_KEYS = 512, 1 << 18

#: Rows in an Arrow batch for Python workers, where the session doesn't set it: JVM and worker hold a whole batch each, in each task.
BATCH_ROWS, BATCH_SETTING = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; if unset, a temporary folder in local mode, and ValueError on a cluster: only the session knows what its machines share."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again: later stages survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialised`` wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        if path := getattr(table, "weftline_path", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow``, in batches of BATCH_ROWS rows unless the session says otherwise; the setting stays for the session."""
    spark = df.sparkSession
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df``'s rows with (left_anti: without) a key in the written table ``ids``; broadcast only if its count is within BROADCAST_IDS."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def hot_above(total: int) -> int:
    """Rows above which a key of a table of ``total`` rows is hot; fewer than HOT_KEYS keys can be."""
    return max(HOT_ROWS, total // HOT_KEYS)


def hot_join(rows: DataFrame, one: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` (``total`` of them at most) with ``one``, which has a row for each key and in ``count`` how many rows the key has.

    Rows of hot keys stay where they are: their keys, fewer than HOT_KEYS, are broadcast.  The rest is shuffled.
    """
    hot = F.broadcast(one.where(F.col(count) > hot_above(total)))
    rest = rows.join(F.broadcast(one.where(F.col(count) > hot_above(total)).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(one.where(F.col(count) <= hot_above(total)), key)).drop(count)


def salted_join(rows: DataFrame, one: DataFrame, key: str, spread_by: str, total: int) -> DataFrame:
    """Inner join of the written table ``rows`` (``total`` of them) with ``one``, whose rows may be wide.

    A hot key's rows are dealt out by the hash of ``spread_by``, and its rows of ``one`` go to each share.
    """
    limit = hot_above(total)
    hot = rows.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("int").alias("_shares")).where("_shares > 1")
    shares = F.coalesce("_shares", F.lit(1))
    # fewer than HOT_KEYS keys
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.pmod(F.xxhash64(spread_by), shares).cast("int")).drop("_shares")
    right = one.join(F.broadcast(hot), key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return left.join(right, [key, "_share"]).drop("_share")


def index_of(df: DataFrame, name: str) -> int:
    """Where the column is that is named so, or else the only one that is but for capitals."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Columns of ``df`` under new names (new=old), whatever other columns are called."""
    at = {new: index_of(df, old) for new, old in columns.items()}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"_{i}"].alias(new) for new, i in at.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, capitals or not."""
    gone = {n.lower() for n in names}
    at = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"_{i}"] for i in at]).toDF(*[df.columns[i] for i in at])


def widened(df: DataFrame, **new: str) -> StructType:
    """``df``'s schema and the new columns (name=type) after it."""
    made = df.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in new.items()]).schema
    return StructType([*df.schema.fields, *[StructField(f.name, f.dataType) for f in made.fields]])


def give_back() -> None:
    """Returns freed memory to the system: a reused worker otherwise keeps its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
