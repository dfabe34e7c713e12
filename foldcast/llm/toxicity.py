"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens are labelled first: a word, or a prefix of 4 to 6 characters, that labelled
toxic documents hold much more often than clean ones (by a likelihood ratio against chance, corrected for the
number of candidates) marks its tokens as toxic in toxic documents; all tokens of clean documents are clean.

The field has two states (clean, toxic). A token's toxic potential is the sum of hashed weights of its word,
prefixes and suffix; four transition weights tie neighbours. A document is one chain, however long. The field is trained on
the driver by gradient ascent of the penalized likelihood, from a bounded sample: at most ``limit`` toxic and twice as many
clean documents (those with the least hashes of their id), each of at most ``most_chars`` characters and of one row; of their
runs of RUN tokens all that hold a toxic one, and one in ``clean_runs`` of the others. Near copies among these documents count
once. Nothing but text is an input of a score.

Forward-backward gives each token's toxic marginal (scaled, for all documents of a batch at once: pieces of CHAIN tokens are
run side by side, and their transfer matrices carry the messages from piece to piece, so nothing is cut). Documents are
scored by a logistic regression on aggregates of the marginals: the expected number of toxic tokens, the two
largest marginals, and the expected share. Offending offsets are those of tokens with a marginal of at least SPAN.

Defined results: null and empty texts score as texts without tokens; repeated rows get a row each; without labels
of both kinds every score is the share of toxic labels (0 if there are none); null ids are never held out nor learnt
from; an empty table gives an empty result; very long texts are scored whole; only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import held
from .common import documents, ship_code

BITS = 18
CHAIN, RUN = 64, 64
MAX_TRAIN = 1500
MOST_CHARS = 50_000
THRESHOLD = 0.3
SPAN = 0.5
CACHE = 200_000
MOST, LEAST_DOCS = 4, 3
HASHES = 8
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…–—“”‘’"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts_of(token: str) -> list[str]:
    """A token's features: its word, prefixes, suffix."""
    w = token.lower().strip(EDGES)
    return [f"w{w}", *(f"{k}{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), f"s{w[-3:]}"] if w else ["-"]


def hashed(token: str) -> list[int]:
    return [zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in parts_of(token)]


def marking(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Words and prefixes (as features) that tell toxic documents apart.

    A document counts with its distinct words that have the feature (at most MOST): many different words with one
    rare beginning are evidence that a single word is not.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    count, docs = {True: Counter(), False: Counter()}, Counter()
    for t, y in zip(texts, toxic.tolist(), strict=True):
        own = Counter(x for w in {w.lower().strip(EDGES) for w in t.split()} for x in parts_of(w) if x[0] in "w456")
        count[y].update({x: min(n, MOST) for x, n in own.items()})
        if y:
            docs.update(own.keys())
    base, need = n1 / (n1 + n0), math.log(max(len(count[True]), 1)) + 2
    out = set()
    for x, c1 in count[True].items():
        c0 = count[False][x]
        p = c1 / (c1 + c0)
        if p > base and p >= 0.95 and docs[x] >= LEAST_DOCS:
            gain = c1 * math.log(p / base) + (c0 * math.log((1 - p) / (1 - base)) if c0 else 0)
            if gain > need:
                out.add(x)
    return out


def first_of_copies(texts: list[str]) -> list[int]:
    """Places of the texts that are no near copy of an earlier one: copies are not independent evidence.

    A copy shares at least half of HASHES minimum hashes of its word set with a text before it.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            h = np.array([zlib.crc32(w.encode()) for w in set(t.split())] or [0], np.uint64)
            least = [(k, int((h * np.uint64(2 * (k * 2_654_435_761 + 97) + 1) & np.uint64(0xFFFFFFFFFFFF)).min())) for k in range(HASHES)]
            met = Counter(j for key in least for j in seen.get(key, ()))
            if not met or max(met.values()) < HASHES // 2:
                out.append(i)
                for key in least:
                    seen.setdefault(key, []).append(i)
    return out


def pieces(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' tokens, in pieces of CHAIN: (piece length, its number in its document, row of each token, its place)."""
    start = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(start, sizes)
    place = inside % CHAIN
    row = np.cumsum(place == 0) - 1
    return np.bincount(row), inside[place == 0] // CHAIN, row, place


def marginals(score: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Toxic marginals of all tokens, summed pair marginals (2 by 2), log partition of all chains."""
    if not len(score):
        return np.zeros(0), np.zeros((2, 2)), 0.0
    length, nth, row, place = pieces(sizes)
    order = np.argsort(-length, kind="stable")  # longest first: at each place the pieces that reach it come first
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    row, length = back[row], length[order]
    deep, n = int(length[0]), len(length)
    e = np.zeros((deep, n))
    e[place, row] = score
    live = [int(np.searchsorted(-length, -k, side="left")) for k in range(deep)]  # pieces longer than k
    m = np.exp(trans)
    x = np.exp(e - np.maximum(e, 0))  # scaled by the larger potential
    c = np.exp(-np.maximum(e, 0))
    into, after, before = carried(c, x, m, live, nth, back)
    alpha, beta = np.zeros((deep, 2, n)), np.ones((deep, 2, n))
    beta[length - 1, :, np.arange(n)] = after.T
    log_z = 0.0
    a0, a1 = into[0] * c[0], into[1] * x[0]
    for k in range(deep):
        r = live[k]
        if k:
            p0, p1 = alpha[k - 1, 0, :r], alpha[k - 1, 1, :r]
            a0, a1 = (p0 * m[0, 0] + p1 * m[1, 0]) * c[k, :r], (p0 * m[0, 1] + p1 * m[1, 1]) * x[k, :r]
        z = a0 + a1
        alpha[k, 0, :r], alpha[k, 1, :r] = a0 / z, a1 / z
        log_z += float(np.log(z).sum() + np.maximum(e[k, :r], 0).sum())
    pair = np.zeros((2, 2))

    def met(p0, p1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
        y0, y1 = m[0, 0] * b0 + m[0, 1] * b1, m[1, 0] * b0 + m[1, 1] * b1
        total = p0 * y0 + p1 * y1
        pair[0] += float((p0 * m[0, 0] * b0 / total).sum()), float((p0 * m[0, 1] * b1 / total).sum())
        pair[1] += float((p1 * m[1, 0] * b0 / total).sum()), float((p1 * m[1, 1] * b1 / total).sum())
        return y0, y1

    for k in range(deep - 1, 0, -1):
        r = live[k]
        y0, y1 = met(alpha[k - 1, 0, :r], alpha[k - 1, 1, :r], beta[k, 0, :r] * c[k, :r], beta[k, 1, :r] * x[k, :r])
        z = y0 + y1
        beta[k - 1, 0, :r], beta[k - 1, 1, :r] = y0 / z, y1 / z
    if nth.any():  # neighbours on two sides of a seam
        s = back[np.flatnonzero(nth)]
        met(before[0, s], before[1, s], beta[0, 0, s] * c[0, s], beta[0, 1, s] * x[0, s])
    u0, u1 = alpha[:, 0] * beta[:, 0], alpha[:, 1] * beta[:, 1]
    p = u1 / np.maximum(u0 + u1, 1e-300)
    return p[place, row], pair, log_z


def carried(c: np.ndarray, x: np.ndarray, m: np.ndarray, live: list[int], nth: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The messages over the seams of pieces: into each piece's first token, back to its last one, and the state
    distribution (forward only) of the token before it."""
    n = c.shape[1]
    into, after, before = np.ones((2, n)), np.ones((2, n)), np.zeros((2, n))
    if not nth.any():
        return into, after, before
    t = np.zeros((2, 2, n))  # from the first token's state to the last one's, up to a factor
    t[0, 0], t[1, 1] = c[0], x[0]
    for k in range(1, len(live)):
        r = live[k]
        n0, n1 = (t[:, 0, :r] * m[0, 0] + t[:, 1, :r] * m[1, 0]) * c[k, :r], (t[:, 0, :r] * m[0, 1] + t[:, 1, :r] * m[1, 1]) * x[k, :r]
        z = n0.sum(0) + n1.sum(0)
        t[:, 0, :r], t[:, 1, :r] = n0 / z, n1 / z
    by = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by], np.arange(1, nth.max() + 2))
    steps = [by[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]  # the second pieces of documents, the third, ...
    for own in steps:
        q, p = back[own], back[own - 1]
        a = (into[:, None, p] * t[:, :, p]).sum(0)
        before[:, q] = a / a.sum(0)
        into[:, q] = m.T @ before[:, q]
    for own in reversed(steps):
        q, p = back[own], back[own - 1]
        g = m @ (t[:, :, q] * after[None, :, q]).sum(1)
        after[:, p] = g / g.sum(0)
    return into, after, before


def aggregates(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: 1, log(1 + expected toxic tokens), largest and second largest marginal, root of the share."""
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1
    start = np.cumsum(sizes) - sizes
    for i, (a, n) in enumerate(zip(start.tolist(), sizes.tolist(), strict=True)):
        if n:
            own = p[a : a + n]
            s = own.sum()
            top = np.partition(own, n - 2)[n - 2 :] if n > 1 else np.array([0.0, own[0]])
            out[i, 1:] = math.log1p(s), top[1], top[0], math.sqrt(s / n)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Penalized logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[int], clean_runs: int = 4, steps: int = 40, rate: float = 0.3, penalty: float = 1e-6) -> dict:
    """Token labels, the field by Adam on the log-likelihood, then the document scores; deterministic.

    The field learns from all runs of RUN tokens that hold a toxic one, and from one in ``clean_runs`` of the others.
    """
    some = first_of_copies(texts)
    texts, y_doc = [texts[i] for i in some], np.array([toxic[i] for i in some], bool)
    size = 1 << BITS
    model = {"w": np.zeros(size), "trans": np.zeros((2, 2)), "doc": np.array([-30.0 if not y_doc.any() else 30.0, 0, 0, 0, 0])}
    if not len(y_doc) or y_doc.all() or not y_doc.any():
        return model
    marks = marking(texts, y_doc)
    memo: dict[str, tuple[list[int], bool]] = {}
    feats, label, sizes = [], [], []
    for t, bad in zip(texts, y_doc.tolist(), strict=True):
        words = t.split()
        for a in range(0, len(words), RUN):
            run = words[a : a + RUN]
            for w in run:
                if w not in memo:
                    memo[w] = (hashed(w), any(x in marks for x in parts_of(w)))
            tags = [bad and memo[w][1] for w in run]
            if any(tags) or zlib.crc32(" ".join(run[:4]).encode()) % clean_runs == 0:
                feats += [memo[w][0] for w in run]
                label += tags
                sizes.append(len(run))
    size_arr = np.array(sizes)
    lab = np.array(label, bool)
    tok = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    col = np.array([c for f in feats for c in f], np.int64)
    used, col = np.unique(col, return_inverse=True)
    first = np.zeros(len(lab), bool)
    first[np.cumsum(size_arr) - size_arr] = True
    nxt = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (lab[nxt - 1].astype(int), lab[nxt].astype(int)), 1)
    theta = np.zeros(len(used) + 5)
    theta[len(used)] = -3.0  # intercept
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w, b, tr = theta[: len(used)], theta[len(used)], theta[len(used) + 1 :].reshape(2, 2)
        score = np.bincount(tok, w[col], len(lab)) + b
        p, pair, _ = marginals(score, size_arr, tr)
        miss = lab - p
        g = np.concatenate([np.bincount(col, miss[tok], len(used)), [miss.sum()], (seen - pair).reshape(-1)]) / len(lab) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
    model["w"][used] = theta[: len(used)]
    model["b"] = float(theta[len(used)])
    model["trans"] = theta[len(used) + 1 :].reshape(2, 2)
    tagger = Tagger(model)
    x = []
    for a in range(0, len(texts), 64):
        p, n = tagger.tokens(texts[a : a + 64])[:2]
        x.append(aggregates(p, n))
    model["doc"] = fit_logistic(np.concatenate(x), y_doc.astype(float))
    return model


class Tagger:
    """Applies a model to texts; holds the potentials of words it has met (at most CACHE)."""

    def __init__(self, model: dict):
        self.w, self.b, self.trans, self.doc = model["w"], model.get("b", 0.0), model["trans"], model["doc"]
        self.held: dict[str, float] = {}

    def potential(self, token: str) -> float:
        if len(self.held) >= CACHE:
            self.held.clear()
        out = self.held[token] = float(self.w[hashed(token)].sum() + self.b)
        return out

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, number of tokens per text."""
        words = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        get, new = self.held.get, self.potential
        score = np.fromiter((v if (v := get(x)) is not None else new(x) for w in words for x in w), float, int(sizes.sum()))
        return marginals(score, sizes, self.trans)[0], sizes

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Document scores, and offending offsets as start-end pairs in characters."""
        p, sizes = self.tokens(texts)
        z = aggregates(p, sizes) @ self.doc
        spans, start = [], np.cumsum(sizes) - sizes
        for t, a, n in zip(texts, start.tolist(), sizes.tolist(), strict=True):
            bad = np.flatnonzero(p[a : a + n] >= SPAN)
            at = [m.span() for m in re.finditer(r"\S+", t or "")] if len(bad) else []
            spans.append(",".join(f"{at[i][0]}-{at[i][1]}" for i in bad.tolist() if i < len(at)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, most_chars: int = MOST_CHARS) -> list[tuple[str, int]]:
    """At most ``limit`` toxic texts and twice as many clean ones, none held out nor longer than ``most_chars``, in order of id.

    Of rows that repeat an id one is taken (that with the least hash of its text), before anything is collected: the
    driver gets at most 3 * limit * most_chars characters.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [ids.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit * (2 - y)) for y in (0, 1)]
    few = F.broadcast(pick[0].union(pick[1]))  # at most three times the limit
    text = F.coalesce("text", F.lit(""))
    own = docs.join(few, "doc_id").select("doc_id", text.alias("text"), "toxic").where(F.length("text") <= most_chars)
    rows = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("x")).select("doc_id", "x.text", "x.toxic").collect()
    return [(t, y) for _, t, y in sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)]


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(model)
    name = f"tagger-{zlib.crc32(model['w'].tobytes() + model['doc'].tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held(name, lambda: Tagger(sent.value))
        for b in batches:
            score, spans = [], []
            for a in range(0, b.num_rows, 64):
                s, at = tagger.score(b.column(1).slice(a, 64).to_pylist())
                score += s.tolist()
                spans += at
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, spans string")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = training_rows(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, train([t for t, _ in rows], [y for _, y in rows]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
