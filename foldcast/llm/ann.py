"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its DEPTH nearest pivots in order (Chavez, Figueroa, Navarro 2008) and posted in the
inverted file of each of them, by id and rank (Amato, Savino 2008). A query looks only into the files of its own ASKED
nearest pivots, over which the footrule distance is taken: a posting there counts the two ranks' difference, a pivot that isn't
shared DEPTH. The RERANK * sqrt(n) vectors of least distance, and no others, are reranked by inner product in
double precision.

Pivots are a sample of vectors (those with the least hashes of their id), about the root of n, from LEAST_PIVOTS
to MOST_PIVOTS; every vector is indexed. The index is partitioned by vector: a part holds about PART vectors dealt
by hash and the files of these, and reranks its share of the candidates, so neither a hot file nor candidates are
ever moved. Queries come in blocks of about PART. Equal vectors are one entry, with the K + 1 smallest of their ids: ties go to smaller
ids, so no other id of theirs can be among a query's K nearest. Equal distances at the cut go to smaller ids.

The root makes the share of reranked vectors fall with the size; measured recall and shares are in the README.

Defined results: null, zero or non-finite vectors, and vectors of another length than the most usual one (of
equally usual ones, the longest), take no part; equal rows are one row; null ids take no part; an empty table gives an
empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship_code, written

LEAST_PIVOTS, MOST_PIVOTS = 512, 4096
DEPTH, ASKED = 128, 64
RERANK = 12
PART = 8192
K = 20
SALTS = 8


def valid(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as doubles that take part, of any length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(fine, v).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(cid, ids, v): distinct vectors with the k + 1 smallest of their ids; cid is the smallest."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("_r", first).where(F.col("_r") <= k + 1)
    ids = F.sort_array(F.collect_list("vec_id"))
    return few.groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("cid"), "ids", "v")


def orders(v: np.ndarray, pivots: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Numbers of each row's nearest pivots (by Euclidean distance), nearest first."""
    far = (pivots * pivots).sum(1) - 2 * v @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :depth].astype(np.uint16)


class Files:
    """The inverted files of a part's vectors: for each pivot, the rows that have it among their nearest, and its rank there."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.depth = order.shape
        flat = order.reshape(-1)
        by = np.argsort(flat, kind="stable")
        self.row = (by // self.depth).astype(np.int32)
        self.rank = (by % self.depth).astype(np.int16)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=pivots))])
        #: What a posting takes off the distance, by rank in the query and in the file.
        self.gain = self.depth - np.abs(np.arange(self.depth)[:, None] - np.arange(self.depth)[None]).astype(np.int32)

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """Of all rows: the footrule distance's complement, from the files of one query's pivots."""
        out = np.zeros(self.n, np.int32)
        for r, p in enumerate(order.tolist()):
            a, z = self.start[p], self.start[p + 1]
            out[self.row[a:z]] += self.gain[r][self.rank[a:z]]
        return out


def search_part(q: np.ndarray, qo: np.ndarray, v: np.ndarray, vo: np.ndarray, pivots: int, most: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one part: (query row, vector row, score) of each query's best k + 1 of the ``most`` by footrule; ties go to earlier rows."""
    files, found = Files(vo, pivots), []
    for i in range(len(q)):
        near = files.nearness(qo[i])
        if most < len(v):
            cut = np.partition(near, len(v) - most)[len(v) - most]
            above = np.flatnonzero(near > cut)
            some = np.concatenate([above, np.flatnonzero(near == cut)[: most - len(above)]])
        else:
            some = np.arange(len(v))
        score = (v[some] * q[i]).sum(axis=1)
        best = np.lexsort((some, -score))[: k + 1]
        found.append((np.full(len(best), i), some[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def searched(rows: DataFrame, pivots: int, share: float, k: int) -> DataFrame:
    """Rows (part, block, is_query, cid, v, files) -> (qid, cid, score) of each part and block."""

    def best(group: list[list]) -> pa.RecordBatch:
        kind, cid, v, o = (np.concatenate(x) for x in group)
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        order = np.argsort(cid, kind="stable")  # ties go to smaller ids
        kind, cid, v, o = kind[order], cid[order], v[order], o[order]
        if kind.any() and not kind.all():
            most = max(k + 1, math.ceil(share * int((~kind).sum())))
            i, j, s = search_part(v[kind], o[kind][:, :ASKED], v[~kind], o[~kind], pivots, most, k)
        return pa.RecordBatch.from_arrays([pa.array(cid[kind][i], pa.int64()), pa.array(cid[~kind][j], pa.int64()), pa.array(s, pa.float64())], names=["qid", "cid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, [[], [], [], []]
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([np.asarray(b.column(x)).astype(np.int64) for x in range(2)])
            kind, cid = np.asarray(b.column(2).cast(pa.int8())) == 1, np.asarray(b.column(3))
            v = np.asarray(b.column(4).flatten()).reshape(b.num_rows, -1)
            o = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).reshape(b.num_rows, -1)
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and now != key[:, a].tolist():
                    yield best(group)
                    group = [[], [], [], []]
                now = key[:, a].tolist()
                for x, y in zip(group, (kind, cid, v, o), strict=True):
                    x.append(y[a:z])
        if now is not None:
            yield best(group)

    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block")
    return rows.mapInArrow(run, "qid long, cid long, score double")


def nearest(table: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest found rows of ``table`` but itself."""
    spark = table.sparkSession
    ship_code(spark)
    rows = valid(table, vec_id, vector)
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of_dim = lambda x: x.where(F.size("v") == usual["d"])
    index = written(classes_of(of_dim(rows), k), "vectors")
    asked = of_dim(valid(queries, vec_id, vector)).distinct()
    by_vector = written(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "queries")
    n = index.count()
    size = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << math.ceil(math.log2(max(1.0, math.sqrt(n))))))
    pivots = np.array([r["v"] for r in index.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(size).collect()])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = orders(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in near], pa.binary())], names=[*b.schema.names, "files"])

    parts, blocks = math.ceil(n / PART), max(1, math.ceil(by_vector.count() / PART))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    v = index.select("cid", "v").mapInArrow(posted, "cid long, v array<double>, files binary")
    v = v.select(deal("cid", parts).alias("part"), each(blocks).alias("block"), F.lit(False).alias("is_query"), "cid", "v", "files")
    q = by_vector.select("qid", "v").mapInArrow(posted, "qid long, v array<double>, files binary")
    q = q.select(each(parts).alias("part"), deal("qid", blocks).alias("block"), F.lit(True).alias("is_query"), F.col("qid").alias("cid"), "v", "files")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    hits = searched(v.union(q), len(pivots), rerank / math.sqrt(n), k).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("qid", "cid", "score")
    found = hits.join(index.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = written(found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).select("qid", "score", "vec_id"), "found")
    # a query row's own id is the only one it may not have: k + 1 rows of its vector suffice. Rows of one very common
    # query vector meet its results in SALTS tasks
    salted = lambda x: x.withColumn("salt", each(SALTS))
    again = asked.withColumn("salt", F.pmod("vec_id", F.lit(SALTS)).cast("int")).join(salted(by_vector.select("qid", "v")), ["v", "salt"]).select(F.col("vec_id").alias("query_id"), "qid", "salt")
    out = again.join(salted(found), ["qid", "salt"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where("vec_id % 20 = 0"))
