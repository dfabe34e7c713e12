"""Quality rules with thresholds that adapt to language and source.

Every document gets counts and ratios; a mergeable quantile sketch of each ratio is kept for each
language and source; upper fences read from the sketches replace fixed cutoffs, and are joined back.

The sketch is the relative-error bucket sketch of Masson, Rim and Lee (DDSketch, VLDB 2019): a value v
falls in bucket ceil(log_gamma v), small values in bucket ZERO, and two sketches merge by adding counts.
So one group-by builds the sketches of all groups, and coarser ones are sums of finer ones. Nothing
about it is random: a lost executor's work comes out the same again.

A fence is Q75 + FAR * max(Q75 - Q25, least spread). The fence of a language and source is blended with that of the
language, as if SHRINK more documents had it, and a language's with the corpus's: small groups lean on wider ones,
and no size makes a verdict jump.

Defined results: null or empty texts have no words and fail the base rules; null languages and sources
are groups of their own; repeated rows each get a row; an empty table gives an empty result; a very long text is counted
whole, in one row's arrays. Columns that this operator adds replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words, written

GAMMA = 1.05
ZERO = -1000
SMALLEST = 1e-6
SHRINK = 20
FAR = 3.0
#: Ratio -> (numerator, least spread of its fence).
RATIOS = {"r_symbols": ("n_symbols", 0.05), "r_repeat": ("n_repeat_words", 0.1), "r_dup": ("n_dup_lines", 0.05), "r_length": ("word_chars", 1.5), "r_stutter": ("n_stutter", 0.1)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter"]


def text_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) with the counts of each text, in JVM expressions on arrays.

    Repeated 8-word windows: hashes of 1, 2, 4, 8 words by doubling; only texts that have a repeated
    window sort them. Nothing is exploded or shuffled, so a long text costs as its length.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {*COUNTS, "_w", "_h", "_s", "_p", "_n"}]
    q = lambda c: f"`{c}`"
    cols = [F.col(q(c)) for c in keep]
    t = F.coalesce(F.col(q(text)), F.lit(""))
    has_word = lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0
    lines = F.filter(F.split(t, "\n"), has_word)
    df = df.select(
        *cols,
        words(F.col(q(text))).alias("_w"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_p"),
    )
    kept = [*cols, "word_chars", "n_symbols"]
    df = df.select(*kept, F.size("_w").cast("long").alias("n_words"), (F.size("_p") - F.size(F.array_distinct("_p"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    kept += ["n_words", "n_dup_lines"]
    df = df.select(*kept, "_h", F.size(F.filter("_h", lambda x, i: x == F.get("_h", i + 1))).cast("long").alias("n_stutter"))
    kept += ["n_stutter"]
    with_later = lambda step: lambda x, i: F.xxhash64(x, F.get("_h", i + step))
    for step in (1, 2, 4):
        df = df.select(*kept, F.transform("_h", with_later(step)).alias("_h"))
    df = df.select(*kept, F.slice("_h", 1, F.greatest(F.col("n_words") - 7, F.lit(0)).cast("int")).alias("_h"))
    df = df.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    twice = lambda x, j: (x["h"] == F.get("_s", j - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("_s", j + 1)["h"]).eqNullSafe(True)
    df = df.select(*kept, F.sort_array(F.transform(F.filter("_s", twice), lambda x: x["i"])).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda v, j: F.least(F.lit(8), F.coalesce(F.get("_p", j + 1) - v, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    return df.select(*cols, *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_stutter")


def with_ratios(df: DataFrame) -> DataFrame:
    out = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    for r, (count, _) in RATIOS.items():
        out = out.withColumn(r, F.when(F.col("n_words") > 0, F.col(count).cast("double") / F.col("n_words").cast("double")))
    return out


def sketches(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language, source, ratio and bucket with its count: the sketches, ready to merge."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in RATIOS]))
    bucket = F.when(F.col("e.v") > SMALLEST, F.ceil(F.log(F.col("e.v")) / F.lit(math.log(GAMMA)))).otherwise(F.lit(ZERO)).cast("int")
    return df.where("n_words > 0").select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("e")).select("lang", "source", "e.ratio", bucket.alias("bucket")).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """A row per language and source: one fence per ratio (null: no document there has words).

    Sketches merge upwards (language, corpus) before quantiles are read; windows run over buckets, of
    which a group has some hundreds however many documents it holds.
    """
    levels = sketch.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"), "lang", "source", "ratio", "bucket", "n")
    merged = levels.select("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), "ratio", "bucket", "n").groupBy("level", "lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    held = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    grouped = merged.groupBy("level", "lang", "source", "ratio").agg(held.alias("b"), F.sum("n").alias("docs"))
    value = lambda bucket: F.when(bucket == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), bucket.cast("double")) / (GAMMA + 1))

    def quantile(p: float):
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] > F.floor(p * (F.col("docs") - 1)), x["bucket"])).alias("at"))
        return value(F.aggregate("b", start, step, lambda a: a["at"]))

    least = F.create_map(*[F.lit(x) for r, (_, s) in RATIOS.items() for x in (r, s)])
    q = grouped.select("level", "lang", "source", "ratio", "docs", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    q = q.withColumn("fence", F.col("q3") + FAR * F.greatest(F.col("q3") - F.col("q1"), F.element_at(least, F.col("ratio"))))
    wide = q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("ratio") == r, F.col("fence"))).alias(f"f_{r}") for r in RATIOS])
    at = lambda k: wide.where(F.col("level") == k).alias(f"l{k}")
    names = [f"f_{r}" for r in RATIOS]
    own, lang, all_ = at(0), at(1), at(2)
    joined = own.join(lang, F.col("l0.lang").eqNullSafe(F.col("l1.lang"))).join(F.broadcast(all_.limit(1)), F.lit(True))
    blend = lambda k, n, wider: (F.col(f"l{k}.docs") * F.col(f"l{k}.{n}") + SHRINK * wider) / (F.col(f"l{k}.docs") + SHRINK)
    pick = lambda n: blend(0, n, blend(1, n, F.col(f"l2.{n}")))
    return joined.select(F.col("l0.lang").alias("_lang"), F.col("l0.source").alias("_source"), *[pick(n).alias(n) for n in names])


def quality_rules(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Columns ``keep`` of ``docs`` (all), the counts, base_failed and kept (what passes base rules and fences).

    Counts are written once (with ``keep``), so that texts are read once; the join on language and source
    moves only what is kept, and adaptive execution splits a hot source or broadcasts the fences by size.
    """
    keep = docs.columns if keep is None else keep
    need = [*keep, *[c for c in (lang, source) if c not in keep]]
    counted = written(text_counts(docs, text, need), "quality")
    rated = with_ratios(counted)
    limit = written(fences(sketches(rated, lang, source)), "fences")
    over = F.lit(False)
    for r in RATIOS:
        over = over | F.coalesce(F.col(r) > F.col(f"f_{r}"), F.lit(False))
    out = rated.join(limit, F.col(f"`{lang}`").eqNullSafe(F.col("_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("_source")), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep if c not in {*COUNTS, "base_failed", "kept"}], *COUNTS, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), ["doc_id"])


def _oracle() -> str:
    ratios = [*RATIOS.items()]
    each = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {c}::DOUBLE / n_words AS v FROM counts WHERE n_words > 0" for r, (c, _) in ratios)
    level = lambda a, b, k: f"SELECT {k} AS level, {a} AS lang, {b} AS source, ratio, bucket, count(*) AS n FROM buckets GROUP BY ALL"
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {s}" for r, (_, s) in ratios) + " END"
    pick = lambda r: f"(SELECT fence FROM blended f WHERE f.ratio = '{r}' AND f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source)"
    over = " OR ".join(f"coalesce(CASE WHEN n_words > 0 THEN {c}::DOUBLE / n_words END > {pick(r)}, false)" for r, (c, _) in ratios)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), pos AS (
  SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM w
), windows AS (
  SELECT k, i, array_to_string(w[i:i+7], ' ') AS g FROM pos WHERE i + 7 <= len(w)
), repeated AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT k, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM repeated) GROUP BY k
), stutter AS (
  SELECT k, count(*) AS n FROM pos WHERE i < len(w) AND w[i] = w[i + 1] GROUP BY k
), counts AS (
  SELECT w.k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n, 0)::BIGINT AS n_stutter
  FROM w LEFT JOIN covered c ON c.k = w.k LEFT JOIN stutter s ON s.k = w.k
), v AS ({each}), buckets AS (
  SELECT *, CASE WHEN v > {SMALLEST} THEN ceil(ln(v) / {math.log(GAMMA)!r}) ELSE {ZERO} END::INT AS bucket FROM v
), merged AS ({level('lang', 'source', 0)} UNION ALL {level('lang', 'NULL', 1)} UNION ALL {level('NULL', 'NULL', 2)}), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS docs FROM merged
), quartiles AS (
  SELECT level, lang, source, ratio, docs, min(bucket) FILTER (WHERE seen > floor(0.25 * (docs - 1))) AS b1, min(bucket) FILTER (WHERE seen > floor(0.75 * (docs - 1))) AS b3 FROM running GROUP BY ALL
), q AS (
  SELECT *, CASE WHEN b1 = {ZERO} THEN 0 ELSE 2 * pow({GAMMA}, b1) / {GAMMA + 1} END AS q1, CASE WHEN b3 = {ZERO} THEN 0 ELSE 2 * pow({GAMMA}, b3) / {GAMMA + 1} END AS q3 FROM quartiles
), fences AS (
  SELECT *, q3 + {FAR} * greatest(q3 - q1, {least}) AS fence FROM q
), of_language AS (
  SELECT a.lang, a.ratio, (a.docs * a.fence + {SHRINK} * b.fence) / (a.docs + {SHRINK}) AS fence FROM fences a JOIN fences b ON b.ratio = a.ratio AND b.level = 2 WHERE a.level = 1
), blended AS (
  SELECT a.lang, a.source, a.ratio, (a.docs * a.fence + {SHRINK} * b.fence) / (a.docs + {SHRINK}) AS fence FROM fences a JOIN of_language b ON b.ratio = a.ratio AND b.lang IS NOT DISTINCT FROM a.lang WHERE a.level = 0
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM failed c
"""


ORACLE = _oracle()
