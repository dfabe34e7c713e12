"""URL filters: rules by host and path, and for all other urls a logistic regression.

The classifier reads hashed character n-grams (3 to 5) of host and path, each with its own mark, and is trained
on the driver from a small labelled table of urls: those of ``labelled_urls.tsv`` (label, 1 to block, and url; made up from
topics of such sites, without any page of a table at hand), or the caller's. Of more than ``limit`` rows those with the least
CRC-32 are learnt from (a documented bound). The weights are a vector of fixed size that is broadcast; the pages are scored in
Arrow batches, with no shuffle at all. Pages that a rule decides aren't scored.

Defined results: a null url, or one without ``://``, has empty host and path, which no rule fits and which the
classifier judges; repeated rows get a row each; an empty table gives an empty result; a very long url is read whole; kept
columns travel under names of this module, so any name of theirs is fine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import ship_code

BITS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@cache
def labelled_urls() -> tuple[tuple[str, int], ...]:
    """(url, 1 to block) of the table that comes with this module."""
    rows = (x.split("\t") for x in Path(__file__).with_name("labelled_urls.tsv").read_text("utf-8").splitlines())
    return tuple((u, int(y)) for y, u in rows)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, rest = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams of all rows, each once a row."""
    found = []
    for mark, texts in enumerate((hosts, paths)):
        code = np.frombuffer("".join(f"^{t}$" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.array([len(t) + 2 for t in texts], np.int64)
        row, left = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size) - np.arange(len(code))
        for n in (3, 4, 5):
            h = np.full(max(len(code) - n + 1, 0), 2 * n + mark + 1, np.uint64)
            for k in range(n):
                h = (h ^ code[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = left[: len(h)] >= n
            found.append((row[: len(h)][inside].astype(np.int64) << BITS) + (h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & (1 << BITS) - 1


def scores(model: tuple[np.ndarray, float], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """The classifier's probabilities to block."""
    (w, b), n = model, len(hosts)
    row, col = features(hosts, paths)
    z = np.bincount(row, w[col], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + b
    return 1 / (1 + np.exp(-z))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the columns give them."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), tail[:stop]


def train(labelled: Sequence[tuple[str, int]], limit: int = 10_000, steps: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept, by gradient descent from zero (deterministic), from at most ``limit`` rows."""
    labelled = sorted(labelled, key=lambda x: (zlib.crc32(x[0].encode()), x))[:limit]
    y = np.array([float(v) for _, v in labelled])
    w, b = np.zeros(1 << BITS), 0.0
    if not len(y):
        return w, b
    row, col = features(*zip(*(split_url(u) for u, _ in labelled), strict=True))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    for _ in range(steps):
        z = np.bincount(row, w[col] * scale[row], len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= rate * (np.bincount(col, g[row] * scale[row], len(w)) + penalty * w)
        b -= rate * g.sum()
    return w, b


def judged(pages: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, limit: int = 10_000) -> DataFrame:
    """Columns ``keep``, then host, path, rule, verdict and block_score (the classifier's probability to block; null
    where a rule decides)."""
    spark = pages.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(train(labelled_urls() if labelled is None else labelled, limit))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p: list[float | None] = [None] * batch.num_rows
            host, path = batch.column(n), batch.column(n + 1)
            open_rows = np.flatnonzero(np.asarray(batch.column(n + 3).is_null().to_numpy(zero_copy_only=False)))
            for a in range(0, len(open_rows), 1024):
                some = open_rows[a : a + 1024]
                for i, s in zip(some.tolist(), scores(model.value, host.take(pa.array(some)).to_pylist(), path.take(pa.array(some)).to_pylist()).tolist(), strict=True):
                    p[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    base = pages.select(*cols, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select(*[f"c{i}" for i in range(n)], "host", "path", rule.alias("rule"), verdict.alias("said"))
    scored = base.mapInArrow(run, StructType([*base.schema.fields]).add("score", DoubleType()))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.col("score").alias("block_score"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
