"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Explode: texts are split into pre-tokens by the tokenizer's pattern, a block of documents (about BLOCK
   characters) at a time. A block gives its pre-tokens by position, as compressed codes into its own word
   list, and that list, dealt into buckets by hash.
2. Encode once: a bucket's word lists of all blocks meet in one task, which encodes each distinct word once.
3. Join back and reassemble: each block gets the ids of its words back and lays them out by position.
4. Decode: ids are joined to the token-byte table (fixed size: the vocabulary) and their bytes concatenated.

What moves is about half the input: one code per pre-token, and each block's distinct words. A word that is
very frequent is one entry of each block's list. A block's rows go to one task, and blocks are bounded (a
longer document is a block of its own). The vocabulary file is read on the driver; its ranks (fixed size) are
broadcast.

Defined results: null texts are empty texts, with no ids; repeated rows get a row each; an empty table gives
an empty result; special tokens in texts are ordinary text; only the key and the text are read, so other columns may have any
name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship_code, written

BLOCK = 24_000_000
HELD, LONG = 1_000_000, 256


def rank_lines(path: str) -> bytes:
    """The file of ranks (base64 token, rank; a line each), as it is."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def held(key: str, make):
    """A value that a worker process makes once."""
    store = sys.modules[__name__].__dict__.setdefault("_held", {})
    if key not in store:
        store[key] = make()
    return store[key]


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, compressed by planes of bytes."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


def joined(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(x)) + x for x in parts)


def split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def packed_lists(parts: list[np.ndarray] | list[bytes]) -> bytes:
    """Lengths, then contents: of byte strings as they are, of id lists by planes."""
    size = packed(np.fromiter(map(len, parts), np.uint32, len(parts)))
    if parts and isinstance(parts[0], bytes):
        return joined(size, zstandard.compress(b"".join(parts), 6))
    return joined(size, packed(np.concatenate(parts)))


def words_in(data: bytes) -> list[bytes]:
    size, rest = split(data)
    rest = zstandard.decompress(rest)
    ends = np.cumsum(unpacked(size)).tolist()
    return [rest[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def ids_in(data: bytes) -> list[list[int]]:
    size, rest = split(data)
    all_ = unpacked(rest).tolist()
    ends = np.cumsum(unpacked(size)).tolist()
    return [all_[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Block:
    """Documents of one block, as codes into its word list by order of appearance."""

    def __init__(self):
        self.ids: list = []
        self.codes: list[np.ndarray] = []
        self.first: dict[str, int] = {}
        self.size = 0

    def add(self, key, text: str, find) -> None:
        self.ids.append(key)
        put, first = self.first.setdefault, self.first
        self.codes.append(np.fromiter((put(w, len(first)) for w in find(text)), np.uint32))
        self.size += len(text)

    def rows(self, block: int, buckets: int) -> list[tuple[int, int, bytes, list | None]]:
        """Rows (block, bucket, data, ids): the stream (bucket -1) and each bucket's words in order.

        The stream codes words by falling count (then by bucket and word), so counts in order of bucket and
        word are all that is needed to find a code's word again.
        """
        raw = [w.encode() for w in self.first]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        order = np.array(sorted(range(len(raw)), key=lambda i: (bucket[i], raw[i])), np.int64)
        all_ = np.concatenate(self.codes).astype(np.int64)
        count = np.bincount(all_, minlength=len(raw))[order]
        code = np.empty(len(raw), np.int64)
        code[order[np.argsort(-count, kind="stable")]] = np.arange(len(raw))
        out = [(block, -1, joined(packed(np.array([len(x) for x in self.codes])), packed(count), packed(code[all_])), self.ids)]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        return out + [(block, int(bucket[order[a]]), packed_lists([raw[i] for i in order[a:b]]), None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def exploded(docs: DataFrame, text: str, key: str, pattern: str, buckets: int, block: int = BLOCK) -> DataFrame:
    """(block, bucket, data, ids) of all blocks; ids are the key column's values of the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, part, n, now = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0, Block()

        def out() -> pa.RecordBatch:
            rows = now.rows((part << 32) + n, buckets)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["block", "bucket", "data", "ids"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                if now.ids and now.size + len(t) > block:
                    yield out()
                    n, now = n + 1, Block()
                now.add(i, t, find)
        if now.ids:
            yield out()

    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, "block long, bucket int, data binary, ids array<long>")


def encoded_words(rows: DataFrame, ranks, name: str, pattern: str, buckets: int) -> DataFrame:
    """Word lists -> lists of their ids, each distinct word of a bucket encoded once (but for words beyond HELD, or over
    LONG bytes, which aren't held: a task's memory is bounded whatever the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = held(f"encoding-{name}", lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(ranks.value), special_tokens={}))
        done: dict[bytes, np.ndarray] = {}
        for b in batches:
            data = []
            for blob in b.column(2):
                words = words_in(blob.as_py())
                ids = []
                for w in words:
                    got = done.get(w)
                    if got is None:
                        got = np.array(enc.encode_ordinary(w.decode()), np.uint32)
                        if len(done) < HELD and len(w) <= LONG:
                            done[w] = got
                    ids.append(got)
                data.append(packed_lists(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary()), b.column(3)], names=["block", "bucket", "data", "ids"])

    return rows.repartition(buckets, "bucket").mapInArrow(run, rows.schema)


def reassembled(rows: DataFrame, ranks, name: str, make, schema: str) -> DataFrame:
    """Rows of encoded blocks -> a row per document.

    ``make(ids, text)`` gets the ids and bytes of each code of a block, and gives what turns a document's key and
    codes (in order of position) into its row.
    """

    def whole(block: list[tuple[int, bytes, list | None]]) -> Iterator[tuple]:
        tokens = held(f"bytes-{name}", lambda: {v: k for k, v in ranks_of(ranks.value).items()})
        (_, data, keys), *lists = sorted(block, key=lambda x: x[0])
        sizes, count, code = map(unpacked, split(data))
        ids = [x for _, part, _ in lists for x in ids_in(part)]
        ids = [ids[i] for i in np.argsort(-count, kind="stable").tolist()]
        text = [b"".join([tokens[i] for i in x]) for x in ids]
        row, end = make(ids, text), 0
        for key, c in zip(keys, sizes.tolist(), strict=True):
            start, end = end, end + c
            yield row(key, code[start:end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = batches_schema
        now, block = None, []

        def out(block: list) -> pa.RecordBatch:
            cols = list(zip(*whole(block), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

        for b in batches:
            for i in range(b.num_rows):
                k = b.column(0)[i].as_py()
                if block and k != now:
                    yield out(block)
                    block = []
                now = k
                block.append((b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()))
        if block:
            yield out(block)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    batches_schema = to_arrow_schema(_parse_datatype_string(schema))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def encode_decode(docs: DataFrame, make, schema: str, path: str, pattern: str, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    spark = docs.sparkSession
    ship_code(spark)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = rank_lines(path)
    ranks, name = spark.sparkContext.broadcast(lines), f"{zlib.crc32(lines)}-{zlib.crc32(pattern.encode())}"
    rows = written(exploded(docs, text, key, pattern, buckets, block), "pretokens")
    words = encoded_words(rows.where("bucket >= 0"), ranks, name, pattern, buckets)
    return reassembled(rows.where("bucket < 0").union(words), ranks, name, make, schema)


def digests(ids: list[list[int]], text: list[bytes]):
    """Rows doc_id, n_tokens, SHA-256 of the ids as decimals with commas, SHA-256 of the decoded bytes."""
    said = [",".join(map(str, x)) for x in ids]
    size = np.fromiter(map(len, ids), np.int64, len(ids))

    def row(key, code: np.ndarray) -> tuple:
        each = code.tolist()
        return key, int(size[code].sum()), hashlib.sha256(",".join([said[c] for c in each]).encode()).hexdigest(), hashlib.sha256(b"".join([text[c] for c in each])).hexdigest()

    return row


def token_ids(ids: list[list[int]], text: list[bytes]):
    """Rows doc_id, its ids, the decoded bytes."""
    return lambda key, code: (key, [i for c in code.tolist() for i in ids[c]], b"".join([text[c] for c in code.tolist()]))


DIGESTS, TOKENS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id long, ids array<int>, decoded binary"


def bpe_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_decode(docs, digests, DIGESTS, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def bpe_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded): the ids and the bytes they decode to."""
    return encode_decode(docs, token_ids, TOKENS, path, pattern, text, key)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))
