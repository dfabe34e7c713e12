"""Chat formatting: collapse cumulative snapshots of conversations, then render, in DataFrame operations only.

Logs often hold a conversation again after each turn. Turns are numbered within their conversation, each
prefix of turns gets a rolling hash (the exclusive-or of the hashes of (position, role, text), two of 64
bits), and a conversation whose hash is that of a prefix of a longer one is dropped by an anti-join. Of equal
conversations the one with the smallest id stays. What stays is rendered.

Numbers and rolling hashes are made in two levels, within chunks of CHUNK turn numbers and over chunks, so a
conversation with very many turns is not one task's work. Nothing compares conversations in pairs.

Defined results: turns of one number are ordered by role and text, nulls first; repeated rows are turns of
their own; a null conv_id is a conversation; null roles and texts render as empty; empty table, empty result; very long texts
are rendered whole; only the four columns are read, so others may have any name. Turns of a conversation that share a number
(or have none) are ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

CHUNK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with chunk, position (from 1), n (turns of the conversation) and prefix hashes h1, h2."""
    t = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / CHUNK).alias("chunk"))
    by = Window.partitionBy("conv_id", "chunk")
    a = written(t.select("*", F.row_number().over(by.orderBy("turn", "role", "text")).alias("i")), "turns")
    conv = Window.partitionBy("conv_id").orderBy("chunk")
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col("conv_id").alias("k_conv"), F.col("chunk").alias("k_chunk")]
    same = F.col("conv_id").eqNullSafe(F.col("k_conv")) & F.col("chunk").eqNullSafe(F.col("k_chunk"))
    sizes = a.groupBy("conv_id", "chunk").agg(F.count("*").alias("c"))
    sizes = sizes.select(*keys, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("k_base"), F.sum("c").over(Window.partitionBy("conv_id")).alias("n"))
    b = a.join(sizes, same).select("conv_id", "turn", "role", "text", "chunk", (F.col("k_base") + F.col("i")).alias("position"), "n")
    said = ["position", "role", F.col("role").isNull(), "text", F.col("text").isNull()]
    b = b.select("*", F.xxhash64(*said).alias("x1"), F.xxhash64(F.lit(1), *said).alias("x2"))
    b = written(b, "hashed")
    sums = b.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"))
    zero = F.lit(0).cast("long")
    sums = sums.select(*keys, F.coalesce(F.bit_xor("c1").over(before), zero).alias("b1"), F.coalesce(F.bit_xor("c2").over(before), zero).alias("b2"))
    run = by.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    b = b.select("conv_id", "turn", "role", "text", "chunk", "position", "n", F.bit_xor("x1").over(run).alias("r1"), F.bit_xor("x2").over(run).alias("r2"))
    c = b.join(sums, same)
    return c.select("conv_id", "turn", "role", "text", "chunk", "position", "n", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """Of numbered turns: (conv_id, n, copies) of conversations that are no prefix of a longer one."""
    prefixes = turns.where("position < n").groupBy(F.col("position").alias("p_n"), F.col("h1").alias("p1"), F.col("h2").alias("p2")).agg(F.lit(1).alias("one"))
    whole = turns.where("position = n").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).getField("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(prefixes, (F.col("n") == F.col("p_n")) & (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")), "left_anti").select("conv_id", "n", "copies")


def rendered(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered): the kept conversations as one text each."""
    k = kept.select(F.col("conv_id").alias("k_conv"), "copies")
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    said = turns.join(k, F.col("conv_id").eqNullSafe(F.col("k_conv"))).select("conv_id", "copies", "n", "chunk", "position", piece.alias("piece"))
    joined = lambda at, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, what))), lambda x: x[what]), "")
    parts = said.groupBy("conv_id", "copies", "n", "chunk").agg(F.min("position").alias("first"), joined("position", "piece").alias("part"))
    return parts.groupBy("conv_id", "copies", F.col("n").alias("n_turns")).agg(joined("first", "part").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    turns = written(numbered(conversations), "prefixes")
    return rendered(turns, maximal(turns))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), F.length("rendered").cast("long").alias("n_chars"), F.sha2(F.encode("rendered", "UTF-8"), 256).alias("rendered_sha256"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece,
         md5(concat_ws('|', role IS NULL, length(role), role, text IS NULL, text)) AS h
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), p AS (
  SELECT *, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY position)) AS prefix FROM t
), whole AS (
  SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE position = n GROUP BY n, prefix
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position = w.n AND p.n > w.n AND p.prefix = w.prefix)
), r AS (
  SELECT k.conv_id, k.n, k.copies, string_agg(t.piece, '' ORDER BY t.position) AS rendered
  FROM kept k JOIN t ON t.conv_id = k.conv_id GROUP BY ALL
)
SELECT conv_id, n AS n_turns, copies, length(rendered) AS n_chars, sha256(rendered) AS rendered_sha256 FROM r
"""
