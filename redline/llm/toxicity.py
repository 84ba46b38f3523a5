"""Toxicity by a linear-chain conditional random field over tokens.

Token labels come from document labels: a token of a toxic training document
is labelled toxic when one of its features (the word, its first and last
characters) occurs nearly only in toxic training documents, more often than
chance allows among so many features.  The field has two states; a token's
score is the sum of its features' weights, neighbours are tied by transition
weights.  Training maximises the likelihood of labelled windows of tokens.

Scoring runs forward and backward over whole texts.  The message of two states
is one ratio, and a token maps it by a 2 x 2 matrix; the matrices of blocks of
``BLOCK`` tokens are multiplied for all blocks of many documents at once, the
blocks of a document are then chained.  A document's score is a logistic
function of the expected number of offending tokens and of the largest
marginal, fitted on the training documents with the classes' true weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, slices, text_of

TRAIN_ROWS = 1000  # labelled documents of each class, at most
TRAIN_CHARS = 8_000  # of a longer document, EXCERPTS stretches spread over it are used for training (all are scored whole)
EXCERPTS = 8
REJECT = 0.7
BLOCK = 64
STEPS = 50
WINDOW = 32
NEGATIVE_WINDOWS = 2  # of a training document
MARK_WINDOWS = 8  # of a toxic training document, spread over its marks
MEMO_WORDS = 400_000
_WORD = re.compile(r"\w+")
CLIP = 15.0


def features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) > n), *(f"{w[-n:]}$" for n in (4, 6) if len(w) > n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    transitions: tuple[float, float, float]  # clean to toxic, toxic to clean, toxic to toxic
    logistic: tuple[float, float, float]
    version: int = 0

    def __post_init__(self):
        # the weights by kind of feature: whole word, starts by length, ends by length
        self.words = {f[1:]: x for f, x in self.weights.items() if f[0] == "="}
        self.starts = [{f[1:]: x for f, x in self.weights.items() if f[0] == "^" and len(f) == n + 1} for n in (4, 5, 6)]
        self.ends = [{f[:-1]: x for f, x in self.weights.items() if f[0] not in "=^" and f[-1] == "$" and len(f) == n + 1} for n in (4, 6)]

    def token(self, word: str) -> float:
        w = word.lower()
        n = len(w)
        x = self.bias + self.words.get(w, 0.0)
        if n > 4:
            x += self.starts[0].get(w[:4], 0.0) + self.ends[0].get(w[-4:], 0.0)
            if n > 5:
                x += self.starts[1].get(w[:5], 0.0)
                if n > 6:
                    x += self.starts[2].get(w[:6], 0.0) + self.ends[1].get(w[-6:], 0.0)
        return -CLIP if x < -CLIP else CLIP if x > CLIP else x

    def score(self, hits: np.ndarray, top: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(hits) + c * top, -30, 30)))


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: tuple[float, float, float], block: int = BLOCK) -> np.ndarray:
    """P(token is toxic) of the tokens of many documents, one after the other."""
    a, c, b = np.exp(transitions)
    lengths = np.asarray(lengths)
    e = np.exp(scores)
    # pad each document to whole blocks; padding changes nothing
    n_blocks = -(-lengths // block)
    first_block = np.cumsum(n_blocks) - n_blocks
    at = np.arange(len(e)) + np.repeat(first_block * block - (np.cumsum(lengths) - lengths), lengths)
    x = np.zeros(int(n_blocks.sum()) * block)
    x[at] = e
    x = np.ascontiguousarray(x.reshape(-1, block).T)  # step by step over all blocks
    real = x > 0
    total = x.shape[1]

    def chained(m00, m01, m10, m11, order):
        """The ratio that enters each block, chained along each document."""
        ratio = np.zeros(total)
        enter = np.zeros(total) if order > 0 else np.ones(total)
        live = np.nonzero(n_blocks)[0]
        now = enter[:1].repeat(len(lengths)) if total else np.zeros(len(lengths))
        for k in range(int(n_blocks.max()) if len(n_blocks) else 0):
            live = live[n_blocks[live] > k]
            i = first_block[live] + (k if order > 0 else n_blocks[live] - 1 - k)
            ratio[i] = now[live]
            now[live] = (m10[i] + m11[i] * now[live]) / (m00[i] + m01[i] * now[live])
        return ratio

    def product(steps, forward):
        m00, m01, m10, m11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
        for n, t in enumerate(steps):
            e = x[t]
            if forward:  # (1, c; a e, b e) M
                m00, m01, m10, m11 = m00 + c * m10, m01 + c * m11, e * (a * m00 + b * m10), e * (a * m01 + b * m11)
            else:  # (1, a e; c, b e) M
                p, q, on = e * m10, e * m11, real[t]
                m10, m11 = np.where(on, c * m00 + b * p, m10), np.where(on, c * m01 + b * q, m11)
                m00, m01 = m00 + a * p, m01 + a * q
            if n % 8 == 7:
                s = m00 + m01 + m10 + m11
                m00, m01, m10, m11 = m00 / s, m01 / s, m10 / s, m11 / s
        return m00, m01, m10, m11

    if not total:
        return np.empty(0)
    # the state before a document counts as clean
    r = chained(*product(range(block), True), 1)
    f = np.empty_like(x)
    for t in range(block):
        r = x[t] * (a + b * r) / (1 + c * r)
        f[t] = r
    q = chained(*product(range(block - 1, -1, -1), False), -1)
    for t in range(block - 1, -1, -1):
        odds = f[t] * q
        q = np.where(real[t], (c + b * x[t] * q) / (1 + a * x[t] * q), q)
        f[t] = odds / (1 + odds)
    return f.T.reshape(-1)[at]


def _gradient(e, y, real, transitions):
    """Marginals and expected transitions of equal-length windows, minus what
    was labelled."""
    n, length = e.shape
    a, c, b = np.exp(transitions)
    x = np.where(real, np.exp(e), 0.0)
    f, g = np.empty((length, n)), np.empty((length, n))
    r = np.zeros(n)
    for t in range(length):
        r = x[:, t] * (a + b * r) / (1 + c * r)
        f[t] = r
    q = np.ones(n)
    for t in range(length - 1, -1, -1):
        g[t] = q
        q = np.where(real[:, t], (c + b * x[:, t] * q) / (1 + a * x[:, t] * q), q)
    p = f * g / (1 + f * g)
    d = np.where(real, p.T - y, 0.0)
    pairs = np.zeros(3)
    z = np.zeros(n, int)
    for t in range(length):
        if t:
            # joint of (t - 1, t): forward ratio, transition, token, backward ratio
            w01, w10, w11 = a * x[:, t] * g[t], f[t - 1] * c, f[t - 1] * b * x[:, t] * g[t]
            s = 1 + w01 + w10 + w11
            on = real[:, t]
            pairs += [(w / s)[on].sum() for w in (w01, w10, w11)]
            pairs -= [((u == 1) & on).sum() for u in ((1 - z) * y[:, t], z * (1 - y[:, t]), z * y[:, t])]
        else:
            pairs[0] += p[0][real[:, 0]].sum() - y[real[:, 0], 0].sum()
        z = y[:, t].astype(int)
    return d, pairs


def train(texts: list[str], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0), steps: int = STEPS, seed: int = 5) -> Model:
    """Fit a model.  ``weights``: how many labelled documents one training
    document of class 0 and of class 1 stands for."""
    y = np.array(toxic, int)
    docs = [_WORD.findall(t) for t in texts]
    cache: dict[str, tuple[str, ...]] = {}
    names: dict[str, str] = {}  # one copy of each feature
    for d in docs:
        for w in d:
            if w not in cache:
                cache[w] = tuple(names.setdefault(f, f) for f in features(w))
    del names
    df = [Counter(), Counter()]
    for d, t in zip(docs, y):
        df[t].update({f for w in set(d) for f in cache[w]})
    n_toxic = int(y.sum())
    if not 0 < n_toxic < len(y):  # one class only: nothing to tell by, so a constant that rejects nothing
        base = min((n_toxic + 0.5) / (len(y) + 1), 0.5)
        return Model({}, -CLIP, (0.0, 0.0, 0.0), (math.log(base / (1 - base)), 0.0, 0.0))
    share = n_toxic / len(y)
    seen = {f: (n, df[0][f]) for f, n in df[1].items() if n + df[0][f] >= 3}
    bar = math.log(max(2, len(seen))) + 2

    def telling(n1, n0):
        p = n1 / (n1 + n0)
        if p < 0.9 or p <= share:
            return False
        kl = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
        return (n1 + n0) * kl >= bar

    marks = {f for f, (n1, n0) in seen.items() if telling(n1, n0)}
    marked = {w: any(f in marks for f in fs) for w, fs in cache.items()}
    del df, seen

    # windows of tokens: around every mark of a toxic document, and spread over all documents
    rng = np.random.default_rng(seed)
    wins, tags = [], []
    for d, t in zip(docs, y):
        label = [int(t and marked[w]) for w in d]
        starts = {max(0, i - int(rng.integers(WINDOW))) for i, z in enumerate(label) if z}
        starts = sorted(starts)
        starts = {starts[i] for i in np.linspace(0, len(starts) - 1, min(MARK_WINDOWS, len(starts))).astype(int)} | {int(s) for s in rng.integers(0, max(1, len(d) - WINDOW + 1), NEGATIVE_WINDOWS)}
        for s in starts:
            if d[s : s + WINDOW]:
                wins.append(d[s : s + WINDOW])
                tags.append(label[s : s + WINDOW])
    ids: dict[str, int] = {}
    count = Counter(f for win in wins for w in win for f in cache[w])
    word_ids = {w: [ids.setdefault(f, len(ids)) for f in cache[w] if count[f] >= 3] for w in {w for win in wins for w in win}}
    words = {w: i for i, w in enumerate(word_ids)}
    flat = np.array([f for fs in word_ids.values() for f in fs], int)
    owner = np.repeat(np.arange(len(words)), [len(fs) for fs in word_ids.values()])
    n = len(wins)
    at, real, z = np.zeros((n, WINDOW), int), np.zeros((n, WINDOW), bool), np.zeros((n, WINDOW))
    for i, (win, tag) in enumerate(zip(wins, tags)):
        at[i, : len(win)] = [words[w] for w in win]
        real[i, : len(win)] = True
        z[i, : len(win)] = tag
    theta, bias, trans = np.zeros(len(ids)), np.array([-4.0]), np.zeros(3)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (theta, bias, trans)]
    for step in range(1, steps + 1):
        per_word = np.bincount(owner, theta[flat], len(words)) if len(flat) else np.zeros(len(words))
        e = np.clip(per_word[at] + bias[0], -CLIP, CLIP)
        d, pairs = _gradient(e, z, real, trans)
        by_word = np.bincount(at.ravel(), d.ravel(), len(words))
        grads = (np.bincount(flat, by_word[owner], len(ids)) + 0.05 * theta if len(ids) else theta, np.array([d.sum()]) + 0.05 * bias, pairs + 0.05 * trans)
        for v, g, m in zip((theta, bias, trans), grads, moments):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            v -= 0.3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    names = list(ids)
    kept = {names[i]: float(theta[i]) for i in np.nonzero(np.abs(theta) > 1e-3)[0]}
    model = Model(kept, float(bias[0]), tuple(trans.tolist()), (0.0, 0.0, 0.0), version=hash((len(kept), float(bias[0]), n)))
    hits, top = aggregate(model, docs, {})[:2]
    w = np.where(y == 1, weights[1], weights[0])
    x = np.stack([np.ones(len(y)), np.log1p(hits), top], 1)
    coef = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        coef += np.linalg.solve(h, x.T @ (w * (y - p)) - 0.1 * coef)
    model.logistic = tuple(coef.tolist())
    return model


def aggregate(model: Model, docs: list[list[str]], memo: dict[str, float]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per document: the expected number of offending tokens (those with a
    marginal of at least a half), the largest marginal, and their places."""
    words = [w for d in docs for w in d]
    scores = list(map(memo.get, words))
    if None in scores:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        memo.update((w, model.token(w)) for w in {w for w, s in zip(words, scores) if s is None})
        scores = [memo[w] if s is None else s for w, s in zip(words, scores)]
    lengths = np.array([len(d) for d in docs], int)
    p = marginals(np.array(scores, float), lengths, model.transitions)
    ends = np.cumsum(lengths)
    hit = np.nonzero(p >= 0.5)[0]
    doc = np.searchsorted(ends, hit, "right")
    hits = np.bincount(doc, p[hit], len(docs))
    top = np.zeros(len(docs))
    some = lengths > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, (ends - lengths)[some])
    places = [hit[i:j] - s for i, j, s in zip(np.searchsorted(doc, np.arange(len(docs))), np.searchsorted(doc, np.arange(len(docs)), "right"), ends - lengths)]
    return hits, top, places


def spans(text: str, places: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (code points) of runs of offending tokens."""
    out: list[tuple[int, int]] = []
    want, last = set(places.tolist()), -2
    if not want:
        return out
    for i, m in enumerate(_WORD.finditer(text)):
        if i in want:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            last = i
    return out


_memos: dict[int, dict[str, float]] = {}


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.version not in _memos:
            _memos.clear()
        memo = _memos.setdefault(model.version, {})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches):
            texts = [t or "" for t in pc.struct_field(b.column(0), "text").to_pylist()]
            hits, top, places = aggregate(model, [_WORD.findall(t) for t in texts], memo)
            found = [[{"start": s, "end": e} for s, e in spans(t, p)] for t, p in zip(texts, places)]
            score = model.score(hits, top)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array([len(p) for p in places], pa.int32()), pa.array(found, kind)],
                ["row", "score", "n_hits", "spans"],
            )

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def excerpt(text: F.Column, chars: int) -> F.Column:
    """The text, or of a longer one ``EXCERPTS`` stretches spread evenly over it."""
    size, n = chars // EXCERPTS, F.char_length(text)
    parts = [F.substring(text, F.floor((n - size) * (i / (EXCERPTS - 1))).cast("int") + 1, F.lit(size)) for i in range(EXCERPTS)]
    return F.when(n <= chars, text).otherwise(F.concat_ws(" ", *parts))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """Train on at most ``train_rows`` labelled documents of each class, those
    of the smallest id hashes.  Of one longer than ``train_chars`` characters,
    ``EXCERPTS`` stretches spread over it are used, of as many characters in all.
    Only rows are used whose crc32 of the id (as text) modulo 3 is not 1;
    null ids and null labels are left out, of several labels the largest
    counts."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), excerpt(text_of(), train_chars).alias("text"))
    # 2 * train_rows ids at most
    rows = text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return train([], [])
    count = Counter(r["toxic"] for r in rows)
    weights = tuple(totals.get(k, 0) / max(1, count[k]) for k in (0, 1))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, reject: float = REJECT, out: str = "toxicity_score") -> DataFrame:
    """``docs`` with a struct named ``out``: ``score`` (0 to 1), ``predicted``
    (score >= ``reject``), ``n_hits`` and ``spans`` (places of offending runs
    in the text, in code points).

    Null and empty texts have no token and get the score of a document
    without any.  Other columns pass through untouched; repeated rows each get
    their score; an empty table gives no rows.  Without usable labels, or with
    one class only, every score is the share of toxic labels (smoothed), at
    most a half: what was not learned rejects nothing.
    """
    ship_package(docs.sparkSession)
    model = model or fit(docs, labels)
    rows = docs.select(F.struct("*").alias("row"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    more = [T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.IntegerType()), T.StructField("spans", T.ArrayType(span))]
    scored = rows.mapInArrow(_scored(model), T.StructType([rows.schema["row"], *more]))
    return scored.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.struct("score", (F.col("score") >= reject).cast("int").alias("predicted"), "n_hits", "spans").alias(out),
    )
