"""The corpus pipeline against a plain version of each of its stages."""

from __future__ import annotations

import base64
import hashlib

import duckdb
import public_tokenizers
from pyspark.sql import functions as F

from foldcast.llm import quality

from ..conftest import DATA
from .conftest import PROSE, docs
from .test_free import plain_components, plain_fingerprint
from .test_native import WORD, plain_mixed, plain_removed


def plain_quality(table, rows):
    """Rows that the SQL of the quality rules keeps (over a Parquet table that holds them)."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{table}')")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    return [r for r in rows if r[0] in kept]


def plain_lines(rows):
    gone = plain_removed([(i, t, None, s) for i, t, s in rows])
    out = []
    for i, t, s in rows:
        drop = set(gone[(i, t or "")])
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop) if drop else t
        if not drop or WORD.search(left):
            out.append((i, left, s))
    return out


def plain_dedup(rows):
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    root = plain_components(prints.values())
    first = {}
    for i, _, _ in sorted(rows):
        first.setdefault(root[prints[i]], i)
    return [r for r in rows if r[0] in set(first.values())]


def plain_encoded(rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(enc.decode_bytes(ids))))
    return out


def plain_stages(table, rows):
    """What each stage leaves: rows (id, text, source), the last (id, ids, digest, digest)."""
    a = plain_quality(table, rows)
    b = plain_lines(a)
    c = plain_dedup(b)
    d = plain_mixed(c, 256)[0]
    return [a, b, c, d, plain_encoded(d)]


def same(spark, sf_dir, table):
    import corpus_pipeline as cp

    d = cp.documents(spark, sf_dir)
    want = plain_stages(table, [(r.doc_id, r.text, r.source) for r in d.collect()])
    for (name, stage), rows in zip(cp.STAGES, want, strict=True):
        d = cp.written(stage(spark, d, sf_dir), "t")
        got = [tuple(r) for r in (d if name == cp.STAGES[-1][0] else d.select("doc_id", "text", "source")).collect()]
        assert sorted(got, key=str) == sorted(rows, key=str), name
    assert sorted((tuple(r) for r in cp.run(spark, sf_dir).collect()), key=str) == sorted(want[-1], key=str)
    return want


def test_pipeline_against_brute_force(spark):
    want = same(spark, DATA, f"{DATA}/documents.parquet")
    assert all(want) and len(want[2]) < len(want[0])


def test_pipeline_where_every_stage_acts(spark, tmp_path):
    word = lambda i, k: f"{'abcdefghij'[i % 10]}{i * 31 % 97}{'xyz'[k % 3]}{k}"
    rows = [(i, " ".join(word(i, k) for k in range(30 + i)), "en", "abc"[i % 3]) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(5)] + [(200, "too short", "en", "a"), (201, "w " * 60, "en", "a"), (202, "", "en", "a"), (203, None, "en", None)]
    rows += [(300 + i, f"{PROSE}\n" + " ".join(word(300 + i, k) for k in range(40)), "en", None) for i in range(6)]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    a, b, c, d, e = same(spark, str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")
    assert len(a) < len(rows) and sum(len(t or "") for _, t, _ in b) < sum(len(t or "") for _, t, _ in a) and len(d) > len(c)
