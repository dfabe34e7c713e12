"""SimHash near-duplicates: fingerprints, covering locality-sensitive hashing, linked components.

Fingerprints: lower-cased words, 3-word shingles, XXH64, majority per bit (Python on Arrow batches: bytes in,
one long out). Equal fingerprints are one node from then on, however many documents share it.

Covering LSH (Pagh 2016): bit i gets a vector m(i) of RADIUS+1 bits; table v (nonzero, as long) keeps the
bits i with odd <m(i), v>. Up to RADIUS differing bits have vectors in a proper subspace, so some v is
orthogonal to all of them, and the pair agrees on all bits that table v keeps: it surely collides there.

Fingerprints that share a key are compared in blocks of at most twice LIMIT: larger groups are dealt out by
hash into parts, and each pair of parts is a block of its own, so that every pair meets and no task holds
more. A block gives a star or chain for each of its linked parts (searching breadth-first over those not yet
reached), not all pairs. Components: large-star, small-star rounds (Kiveris et al. 2014) over written tables.

Defined results: null texts and texts without words have fingerprint zero, linked like any other; repeated
rows get equal rows; ids may be null, then a component's id is its smallest other id (null if none); an empty table gives an
empty result; a very long text is hashed whole, its bits counted PART shingles at a time. Columns named like those of this
module (_fp, _root and so on) are fine in :func:`deduplicated`, which renames all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import documents, drop_written, fresh, ship_code, written

RADIUS = 3
BITS = 64
LIMIT = 4096
SHINGLE = 3
PART = 65_536
#: Documents of one fingerprint that one task joins.
PIECE = 65_536


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(w) - SHINGLE + 1, 1)
    a, b = starts[:last].tolist(), ends[-last:].tolist()
    h = np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, last)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, last, PART):
        ones += np.unpackbits(h[k : k + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and _fp, the fingerprint as a long."""
    ship_code(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    (t,) = fresh(docs, "_text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "_fp"])

    return given.mapInArrow(run, StructType([*given.schema.fields[:-1]]).add("_fp", LongType()))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The kept bits of each table, as signed longs."""
    all_ = 2 ** (radius + 1) - 1
    vector = [i % all_ + 1 for i in range(bits)]
    out = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, all_ + 1)]
    return [x - 2**64 if x >= 2**63 else x for x in out]


def links_of(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what chains of links connect among the distinct fingerprints of one block."""
    left = np.unique(fp)
    edges = []
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        x = todo.pop()
        near = np.bitwise_count(left ^ x) <= radius
        if near.any():
            found = left[near]
            edges += [(int(x), int(y)) for y in found]
            todo += list(found)
            left = left[~near]
    return edges


def block_links(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Sorted rows (table, key, i, j, fp) -> edges (a, b) of each (table, key, i, j)."""
    rest: list[np.ndarray] | None = None

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(cols[4]), bool)
        change[:1] = True
        for c in cols[:4]:
            change[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(change), len(change))
        size = np.diff(at)
        u = cols[4].astype(np.int64).view(np.uint64)
        two = at[:-1][size == 2]
        near = two[(np.bitwise_count(u[two] ^ u[two + 1]) <= radius) & (u[two] != u[two + 1])]
        a, b = list(u[near]), list(u[near + 1])
        for k in np.flatnonzero(size > 2):
            for x, y in links_of(u[at[k] : at[k + 1]], radius):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        differs = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            differs |= c != c[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield linked([c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield linked(rest)


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) within the radius that connect all linked ones."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks(radius))]))
    keyed = nodes.select("fp", tables.alias("x")).select("x.t", "x.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / limit).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = met.select("t", "key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    met = met.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return met.mapInArrow(lambda it: block_links(it, radius), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) of any longs -> (node, root): the smallest node that each can reach."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        then = written(small, "edges")
        drop_written(now)
        now = then
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows with _fp (a written table) -> the same with _root (one fingerprint of the linked group, which tells groups
    apart) and _component (the smallest linked id, which groups without ids or with repeated ones can share)."""
    nodes = written(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min(f"`{doc_id}`").alias("least"), F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")), "nodes")
    root = components(links(nodes.select("fp"), radius))
    rooted = written(nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", "pieces", F.coalesce("root", "fp").alias("root")), "rooted")
    best = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("_component"))
    by = rooted.join(best, F.col("root") == F.col("r")).select(F.col("fp").alias("k_fp"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("k_piece"), F.col("root").alias("_root"), "_component")
    # documents of a very common print meet it in pieces; the table of such prints is written, so that it is sent to all
    # tasks only where its files are small
    many = written(rooted.where("pieces > 1").select(F.col("fp").alias("l_fp"), "pieces"), "many")
    dealt = prints.join(many, F.col("_fp") == F.col("l_fp"), "left").withColumn("_piece", F.coalesce((F.monotonically_increasing_id() % F.col("pieces")).cast("int"), F.lit(0)))
    return dealt.join(by, (F.col("_fp") == F.col("k_fp")) & (F.col("_piece") == F.col("k_piece"))).select(*prints.columns, "_root", "_component")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(with_fingerprint(documents(spark, sf_dir)), "prints")
    out = near_duplicates(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each linked group: that with the smallest id (of linked rows that repeat it or have none, one)."""
    n = len(docs.columns)
    flat = docs.toDF(*[f"c{i}" for i in range(n)])  # no name of a column can clash
    text, doc_id = f"c{docs.columns.index('text')}", f"c{docs.columns.index('doc_id')}"
    prints = with_fingerprint(flat, text, flat.columns)
    prints = written(prints.select("*", F.coalesce(doc_id, F.lit(0)).alias("_id"), F.col(doc_id).isNull().alias("_none"), F.xxhash64(text).alias("_th")), "prints")
    found = near_duplicates(prints.select(F.col(doc_id).alias("doc_id"), "_fp", "_none", "_id", "_th"))
    keys = found.groupBy("_root").agg(F.min(F.struct("_none", "_id", "_fp", "_th")).alias("x")).select("x.*")
    # rows that repeat an id and text are one before their texts move, and move once
    kept = prints.dropDuplicates(["_none", "_id", "_fp", "_th"]).join(keys, ["_none", "_id", "_fp", "_th"], "left_semi")
    return kept.select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
