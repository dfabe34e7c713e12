"""Token-ID output: raw id payloads in ascending key order, with a minimal perfect hash index per shard.

Files of a shard, in one folder of the shared store:

- ``NNNNNN.bin``: ids of its documents one after another, little-endian, 2 bytes each (4 if the vocabulary
  needs it), in ascending order of (doc_id, text hash), nulls first.
- ``NNNNNN.idx``: a minimal perfect hash of its keys (levels of bit arrays, as in BBHash: Limasset et al.
  2017), and for each hash value a 32-bit fingerprint, an offset and a length in ids. No key is stored. A look-up
  hashes the key at each level until its bit is set, ranks the bit, and compares the fingerprint: constant time.

Shards come from a range partitioning of documents by (doc_id, text hash), so that a shard's ids and keys fit in
one task; a key that very many rows share is split by text, and equal rows by their place in the input. A file is written
under a name of its attempt, then renamed: a repeated or speculative attempt writes the same bytes, and what ended attempts
leave is removed.

Shards hold about SHARD_BYTES of text each; a longer text is a shard's alone, encoded whole. Encoding memoizes pre-tokens (texts
are split at the tokenizer's added tokens, then by its byte-level pattern, and its model encodes each
word that the worker doesn't hold), since the library's whole-text call costs several times that. Tests hold it
to the whole-text call.

Defined results: null texts have the end id only; rows that repeat a doc_id are documents of their own, keyed by
(doc_id, number among its equals in the shard); an empty table gives no shards; a special token's string in a text is that
token, as the library has it by default, or ordinary text with ``special_as_text``. Other columns aren't read, whatever
their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import held
from .common import documents, drop_written, shared_dir, ship_code, written

END = 2
SHARD_BYTES = 32_000_000
GROUP = 4096
CACHE = 400_000
GAMMA = 2.0
MAGIC = b"FCIX0001"


class Encoder(dict):
    """Pre-tokens and their ids as bytes; those it lacks are encoded by the tokenizer's model when asked for."""

    def __init__(self, spec: str, pattern: str, width: int, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_str(spec)
        added = [t for t in json.loads(spec).get("added_tokens") or [] if not (special_as_text and t["special"])]
        if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.added = {t["content"]: t["id"].to_bytes(width, "little") for t in added if t["content"]}
        longest = sorted(self.added, key=lambda t: (-len(t), t))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None
        self.model, self.find = tokenizer.model, regex.compile(pattern).findall
        self.raw = [i.to_bytes(width, "little") for i in range(max(tokenizer.get_vocab().values(), default=0) + 1)]
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in the alphabet
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(rest) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        raw = self.raw
        out = self[word] = b"".join([raw[t.id] for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])
        return out

    def encode(self, text: str) -> bytes:
        if self.cut and any(t in text for t in self.added):
            return b"".join(self.added[x] if k % 2 else b"".join(map(self.__getitem__, self.find(x))) for k, x in enumerate(self.cut(text)))
        return b"".join(map(self.__getitem__, self.find(text)))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of unsigned 64-bit values (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys_of(doc_id: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """One 64-bit key for (doc_id or null, number among equals)."""
    a = mixed(np.where(null, 0, doc_id).astype(np.int64).view(np.uint64), 101)
    return mixed(a ^ mixed(nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 102), 103)


def build_index(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys -> bit arrays of the levels, and each key's value in [0, n)."""
    levels, value, left, before = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        if len(levels) > 60:
            raise ValueError("keys repeat")
        size = max(64, int(GAMMA * len(left)) + 63 & ~63)
        at = (mixed(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        placed = alone[at]
        value[left[placed]] = before + rank[at[placed]]
        before += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, value


def index_bytes(keys: np.ndarray, start: np.ndarray, count: np.ndarray, width: int) -> bytes:
    levels, value = build_index(keys)
    order = np.argsort(value)
    head = struct.pack("<BII", width, len(keys), len(levels)) + np.array([len(x) for x in levels], "<u4").tobytes()
    bits = b"".join(np.packbits(x, bitorder="little").tobytes() for x in levels)
    body = (mixed(keys, 201)[order] >> np.uint64(32)).astype("<u4").tobytes() + start[order].astype("<u8").tobytes() + count[order].astype("<u4").tobytes()
    return MAGIC + head + bits + body


class Shard:
    """A shard's files, opened for look-ups by key."""

    def __init__(self, folder: str, shard: int):
        fs, path = filesystem(folder)
        data = fs.open_input_file(f"{path}/{shard:06d}.idx").read()
        if data[:8] != MAGIC:
            raise ValueError(f"not an index: {folder}/{shard:06d}.idx")
        self.width, self.n, deep = struct.unpack_from("<BII", data, 8)
        at = 17
        sizes = np.frombuffer(data, "<u4", deep, at).tolist()
        at += 4 * deep
        self.levels, before = [], 0
        for s in sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, s // 8, at), bitorder="little").astype(bool)
            self.levels.append((bits, before + np.cumsum(bits) - 1))
            before += int(bits.sum())
            at += s // 8
        self.prints = np.frombuffer(data, "<u4", self.n, at)
        self.start = np.frombuffer(data, "<u8", self.n, at + 4 * self.n).astype(np.int64)
        self.count = np.frombuffer(data, "<u4", self.n, at + 12 * self.n).astype(np.int64)
        self.ids = fs.open_input_file(f"{path}/{shard:06d}.bin")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's hash value, or -1 if its fingerprint isn't there."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, rank) in enumerate(self.levels):
            at = (mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            out[left[bits[at]]] = rank[at[bits[at]]]
            left = left[~bits[at]]
        known = out >= 0
        known[known] = self.prints[out[known]] == (mixed(keys[known], 201) >> np.uint64(32)).astype(np.uint32)
        return np.where(known, out, -1)

    def read(self, value: int) -> np.ndarray:
        raw = self.ids.read_at(int(self.count[value]) * self.width, int(self.start[value]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def numbered(doc_id: list) -> np.ndarray:
    """Of sorted ids: each one's number among its equals."""
    same = np.fromiter((i > 0 and doc_id[i] == doc_id[i - 1] for i in range(len(doc_id))), bool, len(doc_id))
    i = np.arange(len(doc_id))
    return i - np.maximum.accumulate(np.where(same, 0, i)) if len(i) else i


def write_shards(docs: DataFrame, folder: str, spec: str, pattern: str, end: int, width: int, shard_bytes: int, special_as_text: bool) -> DataFrame:
    """(doc_id, th, text, nth) -> files, and the catalogue of keys: (shard, doc_id, nth, n)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sent, name = docs.sparkSession.sparkContext.broadcast(spec), f"encoder-{zlib.crc32(spec.encode())}-{zlib.crc32(pattern.encode())}-{width}-{special_as_text}"
    stop = np.array([end], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(name, lambda: Encoder(sent.value, pattern, width, special_as_text)).encode
        shard = TaskContext.get().partitionId()
        fs, path = filesystem(folder)
        mine = uuid.uuid4().hex
        doc_id: list = []
        count: list[int] = []
        out = None
        for b in batches:
            if out is None and b.num_rows:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{mine}.bin.part")
            doc_id += b.column(0).to_pylist()
            for t in b.column(2):
                data = encode(t.as_py() or "") + stop
                count.append(len(data) // width)
                out.write(data)
        if out is None:
            return
        out.close()
        n = np.array(count, np.int64)
        nth = numbered(doc_id)
        null = np.array([x is None for x in doc_id])
        keys = keys_of(np.array([x or 0 for x in doc_id], np.int64), null, nth)
        with fs.open_output_stream(f"{path}/{mine}.idx.part") as f:
            f.write(index_bytes(keys, np.cumsum(n) - n, n, width))
        for kind in ("bin", "idx"):
            fs.move(f"{path}/{mine}.{kind}.part", f"{path}/{shard:06d}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int64()), pa.array(doc_id, pa.int64()), pa.array(nth, pa.int64()), pa.array(n)], names=["shard", "doc_id", "nth", "n"])

    ranged = docs.repartitionByRange(int(shards), "doc_id", "th", "nth").sortWithinPartitions("doc_id", "th")
    out = written(ranged.select("doc_id", "th", "text").mapInArrow(run, "shard long, doc_id long, nth long, n long"), "catalogue")
    drop_files(docs.sparkSession, folder, "*.part")
    return out


def drop_files(spark: SparkSession, folder: str, names: str | None = None) -> None:
    """Remove a folder, or the files of these names in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if names is None:
        fs.delete(at, True)
    elif fs.exists(at):
        for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, names)) or []:
            fs.delete(f.getPath(), False)


def read_back(keys: DataFrame, folder: str) -> DataFrame:
    """Keys (shard, doc_id, nth) -> (shard, doc_id, at, n_tokens, ids_crc32), looked up in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        for b in batches:
            shard = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if opened is None or opened[0] != shard[a]:
                    opened = (int(shard[a]), Shard(folder, int(shard[a])))
                files, part = opened[1], b.slice(a, z - a)
                null = np.asarray(part.column(1).is_null().to_numpy(zero_copy_only=False))
                value = files.find(keys_of(np.asarray(part.column(1).fill_null(0)), null, np.asarray(part.column(2))))
                if (value < 0).any():
                    raise KeyError(f"shard {shard[a]} lacks a key")
                crc = [zlib.crc32(files.read(v).tobytes()) for v in value.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(files.start[value]), pa.array(files.count[value]), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return keys.select("shard", "doc_id", "nth").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, folder: str, spec: str, pattern: str, text: str = "text", key: str = "doc_id", end: int = END, shard_bytes: int = SHARD_BYTES, special_as_text: bool = False) -> DataFrame:
    """Encode, write the shards to ``folder`` (a URI that all executors reach), return the catalogue of keys."""
    ship_code(docs.sparkSession)
    width = 2 if max(json.loads(spec)["model"]["vocab"].values(), default=0) < 65_536 and end < 65_536 else 4
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"), F.monotonically_increasing_id().alias("nth"))
    return write_shards(rows, folder, spec, pattern, end, width, shard_bytes, special_as_text)


def shard_starts(keys: DataFrame) -> DataFrame:
    """(s, base): ids before each shard, by prefix sums in two levels of GROUP shards."""
    each = keys.groupBy(F.col("shard").alias("s")).agg(F.sum("n").alias("n")).withColumn("g", F.floor(F.col("s") / GROUP))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = each.groupBy(F.col("g").alias("h")).agg(F.sum("n").alias("n")).select("h", before(Window.orderBy("h")).alias("first"))
    inner = each.withColumn("inner", before(Window.partitionBy("g").orderBy("s")))
    return inner.join(groups, F.col("g") == F.col("h")).select("s", (F.col("first") + F.col("inner")).alias("base"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = f.read()
    folder = f"{shared_dir(spark)}/foldcast/tokens-{uuid.uuid4().hex}"
    keys = write_tokens(documents(spark, sf_dir), folder, spec, public_tokenizers.PATTERN)
    back, base = written(read_back(keys, folder), "read_back"), written(shard_starts(keys), "starts")
    drop_files(spark, folder)
    drop_written(keys)
    return back.join(base, F.col("shard") == F.col("s")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
