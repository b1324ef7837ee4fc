"""Logged conversations, collapsed to the maximal ones, and rendered.

A log often holds snapshots of a conversation after each turn.  Rolling hashes of
turn prefixes find the snapshots that prefix a longer conversation: a prefix hash is
the running sum of 128-bit hashes of the turns, each mixed with its position, and an
anti-join keeps the conversations whose whole hash is no proper prefix of another.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import picked

#: Characters of text in a rendered part, above which the next part begins; a part holds one turn at least.
PART = 1 << 20

#: What stands around a turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")]


def _rolling(turns: DataFrame) -> DataFrame:
    """Of each turn its position ``k``, the rolling hash up to it in four sums, and whether it is the last."""
    w = Window.partitionBy("conv_id").orderBy(*_order())
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.row_number().over(w).cast("long")
    step = turns.select("conv_id", k.alias("k"), F.lead(F.lit(True)).over(w).isNull().alias("last"), "turn", "role", "digest")
    seed = [F.xxhash64(F.lit(s), "k", F.col("role").isNull(), "role", F.col("digest").isNull(), "digest") for s in (1, 2)]
    halves = {f"h{2 * i + j}": (F.shiftrightunsigned(x, 32) if j else x.bitwiseAND(F.lit(0xFFFFFFFF))) for i, x in enumerate(seed) for j in (0, 1)}
    return step.withColumns(halves).select("conv_id", "k", "last", *[F.sum(h).over(up_to).alias(h) for h in halves])


def maximal_conversations(table: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """The conversations that prefix no longer one, of equal ones that of the smallest id: conv_id, n_turns.

    Turns are ordered by number, role and the text's MD5, nulls first; null and
    empty are different.  Rows without an id are one conversation, whose id is null.
    """
    turns = _turns(table, id_column, turn_column, role_column, text_column)
    rolling = _rolling(turns.select("conv_id", "turn", "role", "digest"))
    key = ["k", "h0", "h1", "h2", "h3"]
    whole = rolling.where("last").groupBy(key).agg(F.min("conv_id").alias("conv_id"))
    proper = rolling.where("not last").select(key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def _turns(table: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    return picked(table, conv_id=id_column, turn=turn_column, role=role_column, text=text_column).withColumn("digest", F.md5("text"))


def format_chats(
    table: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", part_chars: int = PART
) -> DataFrame:
    """The maximal conversations, rendered: conv_id, part, n_turns, rendered.

    A turn is rendered as OPEN, its role, AFTER_ROLE, its text and CLOSE; null roles
    and texts as empty ones.  A conversation whose turns come to more than
    ``part_chars`` characters is rendered in parts from 0 on, cut between turns, so
    that no conversation has to fit into one value; each repeated row is a turn.  No
    rows give no rows; other columns are ignored, whatever their names.
    """
    turns = _turns(table, id_column, turn_column, role_column, text_column)
    kept = maximal_conversations(table, id_column, turn_column, role_column, text_column).withColumnRenamed("conv_id", "kept_id")
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(AFTER_ROLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    mine = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "n_turns", "turn", "role", "digest", said.alias("said"))
    w = Window.partitionBy("conv_id").orderBy(*_order())
    before = F.coalesce(F.sum(F.length("said").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = mine.select("conv_id", "n_turns", "said", F.row_number().over(w).alias("k"), before.alias("before"))
    placed = placed.withColumn("part", F.floor(F.col("before") / part_chars).cast("int"))
    joined = placed.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("k", "said"))).alias("turns"))
    return joined.select("conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda x: x["said"]), "").alias("rendered"))


#: The same in SQL; prefixes are compared as whole strings.
ORACLE = f"""
WITH t AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS k
    FROM conversations
), p AS (
    SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
           string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-'), chr(2)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
    FROM t
), whole AS (
    SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns FROM p WHERE k = n GROUP BY prefix
), kept AS (
    SELECT conv_id, n_turns FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n)
), said AS (
    SELECT t.conv_id, n_turns, t.k, '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE.strip()}' || chr(10) AS said
    FROM t JOIN kept ON t.conv_id = kept.conv_id
), placed AS (
    SELECT *, CAST(coalesce(sum(length(said)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PART} AS INTEGER) AS part
    FROM said
)
SELECT conv_id, part, CAST(n_turns AS BIGINT) AS n_turns, string_agg(said, '' ORDER BY k) AS rendered
FROM placed GROUP BY conv_id, part, n_turns
"""
