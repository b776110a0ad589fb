"""Toxic spans and document scores by a linear-chain conditional random field.

Two states (clean, toxic) over the words of a text.  A word's features are its
letters as a whole, its beginnings and its endings; a transition weight joins
neighbouring words.  The corpus marks documents only, so the labelled tokens
are made first: in documents marked toxic, a word is labelled toxic if one of
its features occurs in far more toxic than clean documents of the sample.  The
CRF is then trained on these tokens by exact gradients from forward-backward.

Scoring runs forward-backward over every word of a text, in windows of
``WINDOW`` words; the words whose marginal is at least one half give the
offending spans, and a logistic link over the marginals, fitted on documents
that the CRF was not trained on, gives the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import id_fold, map_batches

#: Bounds of the labelled sample: documents of either label, characters of each.
SAMPLE, SAMPLE_CHARS = 1500, 100_000
WINDOW = 64
BUCKETS = 1 << 18
#: A feature marks toxic tokens from this many toxic documents and this log odds ratio on.
LEAST_DOCS, LEAST_ODDS = 5, 2.5
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    """The word, its beginnings and its endings; shorter words have fewer."""
    return [f"={word}", *(f"^{word[:k]}" for k in _EDGES if len(word) >= k), *(f"{word[-k:]}$" for k in _EDGES[:3] if len(word) >= k)]


def buckets(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % BUCKETS for f in features(word)]


def _step(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log((e^t01 + e^(t11+r)) / (e^t00 + e^(t10+r))): a state's log ratio carried over a transition."""
    return np.logaddexp(t[0, 1], t[1, 1] + r) - np.logaddexp(t[0, 0], t[1, 0] + r)


def forward_backward(e: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios (toxic over clean) of the forward and backward messages.

    ``e``: emission log ratios (windows, WINDOW), padded; ``lengths``: words of
    each window.  The marginal log ratio is forward + backward.
    """
    n, w = e.shape
    f, b = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for i in range(1, w):
        f[:, i] = e[:, i] + _step(f[:, i - 1], t)
    for i in range(w - 2, -1, -1):
        b[:, i] = np.where(i + 1 < lengths, _step(e[:, i + 1] + b[:, i + 1], t.T), 0.0)
    return f, b


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``counts`` words each: row and column of every word, and words per row."""
    rows_per = -(-counts // WINDOW)
    total = int(counts.sum())
    pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(np.cumsum(rows_per) - rows_per, counts) + pos // WINDOW
    col = pos % WINDOW
    return row, col, np.bincount(row, minlength=int(rows_per.sum()))


def marginals(emission: np.ndarray, counts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Marginal log ratio of every word, texts one after the other."""
    row, col, lengths = windows(counts)
    e = np.zeros((len(lengths), WINDOW))
    e[row, col] = emission
    f, b = forward_backward(e, lengths, t)
    return (f + b)[row, col]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Crf:
    def __init__(self, weights: np.ndarray, bias: float, t: np.ndarray, link: np.ndarray):
        self.weights, self.bias, self.t, self.link = weights, bias, t, link

    def emission(self, word: str) -> float:
        return self.bias + float(self.weights[buckets(word)].sum())

    def summary(self, m: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text: 1, largest marginal log ratio, log of the expected toxic words, their density, log length."""
        p = _sigmoid(m)
        out = np.zeros((len(counts), 5))
        out[:, 0] = 1
        out[:, 1] = -1.0
        some = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[some]
        if len(some):
            strong = np.add.reduceat(p * (p >= 0.05), first)
            out[some, 1] = np.maximum.reduceat(np.clip(m, -8, 8), first) / 8
            out[some, 2] = np.log1p(strong)
            out[some, 3] = np.minimum(20 * strong / counts[some], 4)
            out[some, 4] = np.log1p(counts[some]) / 8
        return out

    def score(self, m: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.summary(m, counts) @ self.link)


def _marked(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that mark toxic tokens, from document frequencies under the two labels."""
    seen, n = (Counter(), Counter()), [0, 0]
    known: dict[str, list[str]] = {}
    for words, label in docs:
        n[label] += 1
        seen[label].update({f for w in set(words) for f in known.get(w) or known.setdefault(w, features(w))})
    odds = lambda f: math.log((seen[1][f] + 0.5) / (n[1] + 1)) - math.log((seen[0][f] + 0.5) / (n[0] + 1))
    return {f for f, c in seen[1].items() if c >= LEAST_DOCS and odds(f) >= LEAST_ODDS}


def fit_crf(docs: list[tuple[list[str], int]], rounds: int = 40, decay: float = 1e-5) -> Crf:
    """Train on (words, label) documents: token labels, then likelihood ascent (Adam, full batches)."""
    marked = _marked(docs)
    vocab: dict[str, int] = {}
    ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int64, len(words)) for words, _ in docs]
    feats = [buckets(w) for w in vocab]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.fromiter((x for f in feats for x in f), np.int64, len(owner))
    is_marked = np.array([any(f in marked for f in features(w)) for w in vocab], bool)
    word = np.concatenate([*ids, np.zeros(0, np.int64)])
    counts = np.array([len(i) for i in ids], np.int64)
    y = (is_marked[word] & np.repeat(np.array([label for _, label in docs], bool), counts)).astype(float) if len(word) else np.zeros(0)
    weights, bias, t = np.zeros(BUCKETS), -3.0, np.zeros((2, 2))
    crf = Crf(weights, bias, t, np.zeros(5))
    if not len(word) or not y.any():
        return crf
    row, col, lengths = windows(counts)
    e, truth = np.zeros((len(lengths), WINDOW)), np.zeros((len(lengths), WINDOW))
    truth[row, col] = y
    inner = np.arange(1, WINDOW)[None, :] < lengths[:, None]
    moments = {}

    def move(name, value, grad, k, rate):
        m, v = moments.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        moments[name] = (m, v)
        return value + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    for k in range(1, rounds + 1):
        em = np.bincount(owner, crf.weights[flat], minlength=len(feats)) + crf.bias
        e[row, col] = em[word]
        f, b = forward_backward(e, lengths, crf.t)
        p = _sigmoid((f + b)[row, col])
        miss = np.bincount(word, y - p, minlength=len(feats))
        # Pairwise marginals: forward at i-1, transition, emission and backward at i.
        joint = np.empty((2, 2, len(lengths), WINDOW - 1))
        for s in (0, 1):
            for u in (0, 1):
                joint[s, u] = s * f[:, :-1] + crf.t[s, u] + u * (e[:, 1:] + b[:, 1:])
        joint = np.exp(joint - joint.max(axis=(0, 1)))
        joint /= joint.sum(axis=(0, 1))
        grad_t = np.empty((2, 2))
        for s in (0, 1):
            for u in (0, 1):
                seen = (truth[:, :-1] == s) & (truth[:, 1:] == u)
                grad_t[s, u] = ((seen - joint[s, u]) * inner).sum()
        crf.weights = move("w", crf.weights, np.bincount(flat, miss[owner], minlength=BUCKETS) - decay * len(word) * crf.weights, k, 0.3)
        crf.bias = float(move("b", crf.bias, miss.sum(), k, 0.1))
        crf.t = move("t", crf.t, grad_t, k, 0.05)
    return crf


def fit_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * b)
    return b


def tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Crf:
    """Fit on at most SAMPLE documents of either label, chosen by the hash of their ids.

    ``labels``: doc_id, label (0/1; others are ignored); ``usable``: condition on
    doc_id.  Without labelled documents the model gives every text the same score.
    """
    named = labels.where(usable & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    picked = [named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    few = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS)).join(ids, "doc_id")
    # An id that repeats brings several rows; the bound holds for rows.
    rows = few.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * SAMPLE).toArrow()
    sample = [(tokens(text), int(label)) for text, label in zip(rows["text"].to_pylist(), rows["label"].to_pylist())]
    crf = fit_crf(sample[::2] + sample[1::4])
    rest = sample[3::4] or sample
    if not rest:
        return crf
    counts = np.array([len(w) for w, _ in rest], np.int64)
    e = np.array([crf.emission(w) for words, _ in rest for w in words])
    x = crf.summary(marginals(e, counts, crf.t), counts)
    y = np.array([k for _, k in rest], float)
    # The sample is balanced, the corpus is not.
    total = sum(share.values())
    prior = np.array([share.get(k, 0) / total for k in (0, 1)])
    had = np.bincount(y.astype(int), minlength=2) / len(y)
    crf.link = fit_link(x, y, np.where(y == 1, prior[1] / max(had[1], 1e-9), prior[0] / max(had[0], 1e-9)))
    return crf


def spans(text: str, toxic: np.ndarray) -> str:
    """start:end (code points) of the words flagged, neighbours joined, comma-separated."""
    out: list[list[int]] = []
    last = -2
    # Lower-casing can change lengths, so the words are found in the text itself.
    for i, m in enumerate(_LETTERS.finditer(text)):
        if i < len(toxic) and toxic[i]:
            if i == last + 1 and out:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in out)


class _Emissions(dict):
    LIMIT = 200_000

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        e = self[word] = self.crf.emission(word.lower())
        return e


def detect(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, score (0 to 1), n_toxic (flagged words), spans, for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words: they get the score of a text without
    words, no spans.  Long texts are scored whole.  Repeated rows are scored each
    for itself, and a null doc_id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(cols, known):
        model = known.crf
        texts = [t or "" for t in cols["text"].to_pylist()]
        words = [_LETTERS.findall(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        e = np.fromiter((known[w] for ws in words for w in ws), float, int(counts.sum()))
        m = marginals(e, counts, model.t) if len(e) else np.zeros(0)
        hit = m >= 0
        ends = np.cumsum(counts)
        found, n_toxic = [], []
        for t, a, b in zip(texts, ends - counts, ends):
            n = int(hit[a:b].sum())
            n_toxic.append(n)
            found.append(spans(t, hit[a:b]) if n else "")
        return {"doc_id": cols["doc_id"], "score": pa.array(model.score(m, counts)), "n_toxic": n_toxic, "spans": found}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(src, run, "doc_id long, score double, n_toxic long, spans string", lambda: _Emissions(shared.value), rows=400)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`detect` by a model learnt from ``labels.toxic`` of the ids outside fold 2 of 4.

    Returns doc_id, held_out, score, predicted (score >= 0.3), n_toxic, spans.
    """
    held_out = id_fold(F.col("doc_id"), 4) == 2
    crf = train(docs, labels.select("doc_id", F.col("toxic").alias("label")), ~held_out)
    out = detect(docs, crf)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_toxic", "spans")
