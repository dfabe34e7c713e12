"""Mixing sources to target weights, in DataFrame operations only.

1. Place: each document gets a start in its source's stream of words (two-level prefix sums: by bucket of
   the document's id, then within the bucket), and streams are packed into blocks of BLOCK words.
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a target
   stops at REPEATS times its source's size, the excess is reshared by weight (water filling in closed form).
3. Draw: each output shard of SHARD_SLOTS slots draws its source counts. A slot draws a source by inverse
   distribution function; the uniforms of all slots are the strata of [0, 1) in a pseudorandom order, so a
   shard's counts are multinomial, given that all shards together meet the targets to a block.
4. Map: a shard's slots of a source follow those of earlier shards; slot j takes block perm(j mod blocks) in
   pass j div blocks, where perm is a pseudorandom permutation of the source's block indexes. So no block is
   taken more than REPEATS times, nor a block twice before each was taken once.
5. Join blocks to slots by (source, block index).

The permutation is swap-or-not (Hoang, Morris, Rogaway 2012): a bijection of [0, n) for any n, in integer
arithmetic, that has an inverse.

The draw decides which shard has which words (``first_shard`` of a document's words comes from it); what is taken in total
is fixed by the targets.

Defined results: null or blank texts have size 0 and are never taken; a null source is a source; rows that
repeat are documents of their own; null ids come first in their bucket, which is by the text; an empty table gives an empty
mix; a very long text reaches into many blocks, each a row. Kept columns travel under names of this module, so any name of
theirs is fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_written, words, written

BLOCK = 32
SHARD_SLOTS = 16_384
REPEATS = 3
WEIGHTS = (5, 2, 1)
BUCKETS = 1024
CHUNK = 8192
PRIME = 2_147_483_647
ROUNDS = 10
#: Draws of so many shards of a source are summed in one task.
GROUP = 4096


def round_keys(seed: int) -> list[int]:
    """Positive 60-bit keys of the permutation's rounds."""
    out, x = [], seed
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x >> 4)
    return out


BLOCK_KEYS, STRATUM_KEYS = round_keys(11), round_keys(23)


def permuted(x: Column, n: Column, salt: Column, keys: list[int], inverse: bool = False) -> Column:
    """The place of the long ``x`` in a permutation of [0, n) that salt selects.

    One fold over the keys: as chained columns the rounds would be substituted into each other by the optimizer.
    """
    def turn(v: Column, c: Column) -> Column:
        k = c + salt * 15_485_863
        y = (k % n + n - v) % n
        r = ((F.greatest(v, y) % PRIME) * (k % PRIME) + k % 1_000_003) % PRIME
        return F.when(F.shiftright(r * r % PRIME, 12).bitwiseAND(F.lit(1).cast("long")) == 1, y).otherwise(v)

    return F.aggregate(F.array(*[F.lit(c).cast("long") for c in (reversed(keys) if inverse else keys)]), x.cast("long"), turn)


def placed(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Columns ``keep`` of ``docs`` as c0, c1, ... (no name of theirs can clash), with _source, _size (words)
    and _start (words of the source before it); and the written table that this reads."""
    t, n = F.col(f"`{text}`"), len(keep)
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    base = docs.select(*cols, F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(t).alias("_th"), F.col(f"`{source}`").alias("_source"), F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_size"))
    by_id = (F.pmod("_id", F.lit(PRIME)) * 48_271 + 11) % PRIME % BUCKETS
    base = base.withColumn("_bucket", F.when(F.col("_id").isNull(), F.pmod("_th", F.lit(BUCKETS))).otherwise(by_id))
    inner = Window.partitionBy("_source", "_bucket").orderBy("_id", "_th").rowsBetween(Window.unboundedPreceding, -1)
    local = written(base.withColumn("_local", F.coalesce(F.sum("_size").over(inner), F.lit(0))), "placed")
    outer = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy(F.col("_source").alias("s"), F.col("_bucket").alias("b")).agg(F.sum("_size").alias("n")).select("s", "b", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("_base"))
    out = local.join(offsets, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b")))
    return out.select(*[f"c{i}" for i in range(n)], "_source", "_size", (F.col("_base") + F.col("_local")).alias("_start")), local


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, source_size) -> also sid, blocks, target, slots and the first stratum of each source.

    Windows over the table of sources, which has a row per source.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("sid", F.row_number().over(rank).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", REPEATS * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    below, rest, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(all_).cast("double") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    s = s.withColumn("at", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("cap") / F.col("w"))).over(all_))
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("at"), F.col("cap"))))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("source", "source_size", "sid", "blocks", "target", "slots", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("first"), F.sum("slots").over(all_).alias("total"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Few small rows that many large ones are made of: dealt to a set number of tasks, which isn't lowered for the
    rows' size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def counted_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Draws of all shards: (shard, sid, blocks, n, before): n slots of a source, after ``before`` earlier ones."""
    chunks = sources.where("slots > 0").select("sid", "blocks", "first", "slots", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("c"))
    stratum = F.explode(F.sequence(F.col("first") + F.col("c") * CHUNK, F.col("first") + F.least((F.col("c") + 1) * CHUNK, F.col("slots")) - 1))
    slots = dealt(chunks, "sid", "c").select("sid", "blocks", "total", stratum.alias("g"))
    slots = slots.select("sid", "blocks", permuted(F.col("g"), F.col("total"), F.lit(0), STRATUM_KEYS).alias("g"))
    drawn = slots.groupBy(F.floor(F.col("g") / shard_slots).alias("shard"), "sid", "blocks").agg(F.count("*").alias("n"))
    drawn = drawn.withColumn("g", F.floor(F.col("shard") / GROUP))
    before = lambda by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = drawn.groupBy(F.col("sid").alias("h_sid"), F.col("g").alias("h")).agg(F.sum("n").alias("n")).select("h_sid", "h", before(["h_sid"], "h").alias("outer"))
    inner = drawn.withColumn("inner", before(["sid", "g"], "shard"))
    each = inner.join(groups, (F.col("sid") == F.col("h_sid")) & (F.col("g") == F.col("h")))
    return each.select("shard", "sid", "blocks", "n", (F.col("outer") + F.col("inner")).alias("before"))


def slots_of(drawn: DataFrame) -> DataFrame:
    """A row per slot: (shard, sid, pass, block)."""
    each = dealt(drawn, "sid", "shard").select("shard", "sid", "blocks", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("j"))
    each = each.select("shard", "sid", "blocks", F.floor(F.col("j") / F.col("blocks")).alias("pass"), (F.col("j") % F.col("blocks")).alias("block"))
    return each.select("shard", "sid", "pass", permuted(F.col("block"), F.col("blocks"), F.col("sid"), BLOCK_KEYS).alias("block"))


def plan_mix(docs: DataFrame, keep: list[str], block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed documents (written; with _sid, _source_size, _target), the sources, and the slots of all shards."""
    at, local = placed(docs, keep)
    sizes = at.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    sources = written(targets(sizes, block), "targets")
    at = at.join(sources, F.col("_source").eqNullSafe(F.col("source")))
    at = at.select(*[f"c{i}" for i in range(len(keep))], "_size", "_start", *[F.col(c).alias(f"_{c}") for c in ("sid", "source_size", "target")])
    at = written(at, "mix")
    drop_written(local)
    return at, sources, slots_of(counted_slots(sources, shard_slots))


def pieces(at: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and block that it reaches into: from _from up to _to, in words of the stream."""
    end = F.col("_start") + F.col("_size")
    each = at.where("_size > 0").select("_sid", "_start", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((end - 1) / block))).alias("_block"))
    return each.select("_sid", "_block", "_start", F.greatest("_start", F.col("_block") * block).alias("_from"), F.least("_end", (F.col("_block") + 1) * block).alias("_to"))


def taken(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), first_shard (the first that has words of it; -1: none)."""
    at, _, slots = plan_mix(docs, ["doc_id"], block, shard_slots)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    got = pieces(at, block).join(times.hint("merge"), (F.col("_sid") == F.col("sid")) & (F.col("_block") == F.col("block")))
    got = got.groupBy(F.col("_sid").alias("g_sid"), F.col("_start").alias("g_start")).agg(F.sum((F.col("_to") - F.col("_from")) * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    # slots are exploded from a small table of sources, by whose size joins would be planned without the hints
    out = at.join(got.hint("merge"), (F.col("_sid") == F.col("g_sid")) & (F.col("_start") == F.col("g_start")) & (F.col("_size") > 0), "left")
    return out.select(F.col("c0").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_shard", F.lit(-1)).cast("long").alias("first_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir))


def mixed_documents(docs: DataFrame, block: int = 256) -> DataFrame:
    """The mix as rows like those of ``docs``: for each document and pass, the words of its taken blocks.

    A document taken whole in a pass keeps its text as it is; of others the taken words are joined by
    spaces. A document comes up to REPEATS times, with its own id and other columns (n_chars is set anew).
    """
    keep = docs.columns
    at, _, slots = plan_mix(docs, keep, block)
    got = pieces(at, block).join(slots.hint("merge"), (F.col("_sid") == F.col("sid")) & (F.col("_block") == F.col("block")))
    part = F.struct((F.col("_from") - F.col("_start") + 1).cast("int").alias("a"), (F.col("_to") - F.col("_from")).cast("int").alias("n"))
    got = got.groupBy(F.col("_sid").alias("g_sid"), F.col("_start").alias("g_start"), "pass").agg(F.sum(F.col("_to") - F.col("_from")).alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))
    out = at.join(got.hint("merge"), (F.col("_sid") == F.col("g_sid")) & (F.col("_start") == F.col("g_start")) & (F.col("_size") > 0))
    text = F.col(f"c{keep.index('text')}")
    out = out.withColumn("_words", F.when(F.col("n") < F.col("_size"), words(text)))
    some = F.array_join(F.transform("parts", lambda p: F.array_join(F.slice("_words", p["a"], p["n"]), " ")), " ")
    out = out.withColumn("_text", F.when(F.col("n") < F.col("_size"), some).otherwise(text))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(keep)])


def _sql_permuted(x: str, n: str, salt: str, keys: list[int], table: str, rest: str) -> str:
    """The permutation as nested SELECTs over ``table`` (DuckDB)."""
    def one(inner: str, c: int) -> str:
        k = f"({c} + {salt} * 15485863)"
        y = f"(({k} % {n} + {n} - {x}) % {n})"
        r = f"(((greatest({x}, y) % {PRIME}) * ({k} % {PRIME}) + {k} % 1000003) % {PRIME})"
        return f"SELECT {rest}, CASE WHEN (({r} * {r} % {PRIME}) >> 12) & 1 = 1 THEN y ELSE {x} END AS {x} FROM (SELECT {rest}, {x}, {y} AS y FROM ({inner}))"
    return reduce(one, keys, f"SELECT {rest}, {x} FROM {table}")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (coalesce(doc_id, 0) % {PRIME} * 48271 + 11) % {PRIME} % {BUCKETS} AS bucket FROM documents
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM s0
), s2 AS (
  SELECT *, {REPEATS} * source_size::DOUBLE AS cap, CASE (sid - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s1
), s3 AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
), s4 AS (
  SELECT *, (SELECT level FROM s3 x WHERE x.cap / x.w > x.level ORDER BY x.cap / x.w, x.sid LIMIT 1) AS lambda_ FROM s3
), s5 AS (
  SELECT *, least(cap, coalesce(w * lambda_, cap)) AS target, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM s4
), s6 AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target * blocks / source_size) ELSE 0 END::BIGINT AS slots FROM s5
), s7 AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, (sum(slots) OVER ())::BIGINT AS total FROM s6
), strata AS (
  SELECT sid, blocks, total, unnest(range(first, first + slots)) AS g, 0 AS salt FROM s7 WHERE slots > 0
), j AS (
  SELECT sid, blocks, g // {SHARD_SLOTS} AS shard, (row_number() OVER (PARTITION BY sid ORDER BY g) - 1) % blocks AS block
  FROM ({_sql_permuted("g", "total", "salt", STRATUM_KEYS, "strata", "sid, blocks, total, salt")})
), taken_blocks AS (
  SELECT sid, block, count(*) AS times, min(shard) AS shard FROM ({_sql_permuted("block", "blocks", "sid", BLOCK_KEYS, "j", "sid, blocks, shard")}) GROUP BY sid, block
), pieces AS (
  SELECT p.doc_id, p.source, p.start, p.size, s6.sid, s6.source_size, s6.target,
         unnest(CASE WHEN p.size > 0 THEN range(p.start // {BLOCK}, (p.start + p.size - 1) // {BLOCK} + 1) ELSE [-1] END) AS block
  FROM p JOIN s6 ON p.source IS NOT DISTINCT FROM s6.source
)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN size > 0 THEN (least(start + size, (x.block + 1) * {BLOCK}) - greatest(start, x.block * {BLOCK})) * coalesce(times, 0) ELSE 0 END)::BIGINT AS taken,
       coalesce(min(t.shard), -1)::BIGINT AS first_shard
FROM pieces x LEFT JOIN taken_blocks t ON t.sid = x.sid AND t.block = x.block
GROUP BY doc_id, source, start, size, source_size, target
"""
