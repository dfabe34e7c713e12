"""A corpus pipeline of five stages, each a corpus operator at work on what its predecessor kept.

quality rules -> line dedup -> SimHash near-dedup -> mixing to target weights -> BPE encoding and decoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of the
documents. Between stages the rows are written as Parquet in the shared folder and read again, so a lost executor
costs a stage's tasks at most, and no plan spans two stages. A stage's own tables are dropped when the next one begins.

1. Quality: documents that the base rules or the adaptive fences reject go.
2. Lines: lines that an earlier line is similar to go; documents that lose all their words go with them.
3. Near-dedup: of each linked group the document with the smallest id stays.
4. Mixing: a document comes once for each pass over its source that takes words of it, with these words.
5. BPE: per row of the mix the number of its ids and digests of ids and decoded bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm import bpe, lines, mixing, quality, simhash
from foldcast.llm.common import MADE, documents, drop_paths, drop_written, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    """A stage that first drops what the stage before it has written for its own use.

    By then that stage's result is a table (which is not dropped here), so nothing reads those any more.
    """
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _tables.pop(sf_dir, []))
        before = set(MADE)
        out = f(spark, docs, sf_dir)
        _tables[sf_dir] = [p for p in MADE if p not in before]
        return out
    return run_stage



@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(docs)
    return judged.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_lines(docs)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the fingerprints and the byte-level merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs, last = documents(spark, sf_dir), None
    for i, (_, f) in enumerate(STAGES):
        docs = written(f(spark, docs, sf_dir), f"stage{i}")
        if last is not None:
            drop_written(last)
        last = docs
    drop_paths(spark, _tables.pop(sf_dir, []))
    return docs
