"""Chat formatting (operator 6): collapse of cumulative snapshots, then rendering.

A service that logs a conversation after every turn leaves many conversations that are the beginning of a longer one. A
turn's hash covers its number, role and text; the rolling hash of a prefix combines the hashes of its turns, so it can be
summed up per block of turns first and no task sees a whole long conversation. A conversation whose last rolling hash
occurs inside a longer conversation is a snapshot of it: an anti-join keeps the others. Of equal conversations the one
with the smallest id stays. Kept ones are rendered in blocks of at most 256 turn numbers, in order.

Rows without a ``conv_id`` belong to no conversation and are left out. A NULL ``turn`` comes before all others, a NULL
role is ``unknown`` and a NULL text empty. Repeated rows are one turn; different rows with one turn number are both turns,
ordered by role, then text. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import columns, stored

BLOCK = 256
KEY = ["n", "h1", "h2"]


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with defaults, the block of turns that each belongs to, and two hashes."""
    rows = columns(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(
        "*", F.floor(F.col("turn") / BLOCK).alias("block"), F.xxhash64("turn", "role", "text").alias("h1"),
        F.xxhash64(F.lit("second"), "text", "role", "turn").alias("h2"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, n and rolling hash of each prefix, and the number of turns of its conversation; no texts."""
    rows = turns(conversations).select("conv_id", "block", "turn", "role", "h1", "h2").distinct()
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "h1", "h2").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rolling = rows.select("conv_id", "block", F.count("*").over(inside).alias("n"),
                          F.bit_xor("h1").over(inside).alias("h1"), F.bit_xor("h2").over(inside).alias("h2"))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("m"), F.bit_xor("h1").alias("x1"),
                                                  F.bit_xor("h2").alias("x2"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = blocks.select(
        "conv_id", "block", F.coalesce(F.sum("m").over(earlier), zero).alias("m"), F.sum("m").over(whole).alias("total"),
        F.coalesce(F.bit_xor("x1").over(earlier), zero).alias("x1"),
        F.coalesce(F.bit_xor("x2").over(earlier), zero).alias("x2"))
    return rolling.join(offsets, ["conv_id", "block"]).select(
        "conv_id", "block", (F.col("n") + F.col("m")).alias("n"), F.expr("h1 ^ x1").alias("h1"),
        F.expr("h2 ^ x2").alias("h2"), "total")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, block, n_turns and n_copies of the conversations that no longer one begins with."""
    every = stored(prefixes(conversations), "prefixes")
    shorter = every.where("n < total").select(*KEY).distinct()
    ends = every.where("n = total").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = ends.join(shorter, KEY, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")
    return every.select("conv_id", "block").distinct().join(kept, "conv_id")


def chats(conversations: DataFrame) -> DataFrame:
    """One row per block of each kept conversation: conv_id, block, n_turns (of all blocks), n_copies, chat."""
    rows = turns(conversations).select("conv_id", "block", "turn", "role", "text")
    wanted = rows.join(maximal(conversations), ["conv_id", "block"])
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return wanted.groupBy("conv_id", "block").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), ordered.alias("x")).select(
        "conv_id", "block", "n_turns", "n_copies", F.array_join(F.transform("x", lambda t: F.concat(
            F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "").alias("chat"))


#: The same in DuckDB: conversations as lists of rendered turns, compared with the beginnings of longer ones.
SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         list(turn || '/' || role || '/' || text) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
ends AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, any_value(total) AS n_turns, prefix
  FROM numbered WHERE n = total GROUP BY prefix),
kept AS (
  SELECT * FROM ends WHERE NOT EXISTS (SELECT 1 FROM numbered p WHERE p.n < p.total AND p.prefix = ends.prefix))
SELECT t.conv_id, floor(t.turn / {BLOCK})::BIGINT AS block, any_value(n_turns)::BIGINT AS n_turns,
       any_value(n_copies)::BIGINT AS n_copies,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS chat
FROM t JOIN kept USING (conv_id) GROUP BY ALL
"""
