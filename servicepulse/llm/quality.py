"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; its contribution to the log odds is a
lookup table over the bins.  The tables are learnt by cyclic boosting: round
after round, each feature in turn gets a shallow tree over its bins, fitted to
the gradient left by all others, added at a small rate.  Then the pairs of
features whose grid explains most of what is left get tables of their own in
the same way.  Scoring bins the features and adds up table entries.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import id_fold, map_batches, text_bytes

#: Bounds of the labelled sample: documents of either label.
SAMPLE = 6000
BINS, GRID, PAIRS = 32, 8, 10
RATE, ROUNDS, PAIR_ROUNDS, LEAVES, RIDGE = 0.1, 120, 40, 4, 5.0

FEATURES = (
    "log_words", "word_length", "upper", "lower", "digit", "symbol", "pipe", "bang", "stop", "comma", "space", "lines", "high",
    "distinct", "top_share", "repeats", "line_repeats", "title", "longest", "second_share",
)
_SYMBOLS = np.frombuffer(b"#$%&*<>=@^_~{}[]\\+/", np.uint8)


def features(raw: bytes) -> list[float]:
    """The feature values of a text's UTF-8 bytes; all 0 for a text without words."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(h[65:91].sum() + h[97:123].sum()))
    counts = Counter(words)
    top = counts.most_common(2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), (size - int(h[[32, 9, 10, 11, 12, 13]].sum())) / n, h[65:91].sum() / letters, h[97:123].sum() / size, h[48:58].sum() / size,
        h[_SYMBOLS].sum() / size, h[124] / n, h[33] / n, h[46] / n, h[44] / n, h[32] / size, len(lines) / n, h[128:].sum() / size,
        len(counts) / n**0.8, top[0][1] / n, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines),
        sum(w[:1].isupper() for w in counts) / len(counts), float(np.log1p(max(map(len, counts)))), (top[1][1] if len(top) > 1 else 0) / n,
    ]


def feature_table(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and x (array of feature values) per row of ``docs``."""

    def run(cols, _):
        x = [features(b) for b in cols["raw"].to_pylist()]
        return {k: cols[k] for k in keep} | {"x": x}

    schema = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep) + ", x array<double>"
    return map_batches(docs.select(*keep, text_bytes(F.col("text")).alias("raw")), run, schema)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Best-first tree over ordered bins: the leaf value of each bin, from the bins' gradient and curvature sums."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, a + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best cut of a grid along one axis with a further cut of each side along the other: leaf values, gain."""
    best, out = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(gg)):
            value, gain = np.zeros_like(gg), -whole
            for side in (slice(0, cut), slice(cut, None)):
                leaf = shallow_tree(gg[side].sum(axis=0), hh[side].sum(axis=0), 2)
                value[side] = leaf
                for v in np.unique(leaf):
                    m = leaf == v
                    gain += _gain(gg[side][:, m].sum(), hh[side][:, m].sum())
            if gain > best:
                best, out = gain, value if axis == 0 else value.T
    return out, best


class Gam:
    """Cuts and lookup tables; ``score`` only adds table entries."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base = cuts, base
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * GRID // (len(self.cuts[j]) + 1)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[self.coarse(bins, i), self.coarse(bins, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(self.bins(x)))


def fit_gam(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gam:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    base = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    gam = Gam(cuts, float(np.log(base / (1 - base))))
    bins = gam.bins(x)
    f = gam.log_odds(bins)
    for _ in range(ROUNDS):
        for j, table in enumerate(gam.tables):
            p = _sigmoid(f)
            g = np.bincount(bins[:, j], weight * (y - p), minlength=len(table))
            h = np.bincount(bins[:, j], weight * p * (1 - p), minlength=len(table))
            step = RATE * shallow_tree(g, h)
            table += step
            f += step[bins[:, j]]

    def grid(i, j):
        at = gam.coarse(bins, i) * GRID + gam.coarse(bins, j)
        p = _sigmoid(f)
        return at, np.bincount(at, weight * (y - p), minlength=GRID * GRID).reshape(GRID, GRID), np.bincount(at, weight * p * (1 - p), minlength=GRID * GRID).reshape(GRID, GRID)

    gains = {(i, j): pair_tree(*grid(i, j)[1:])[1] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])}
    gam.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    gam.pair_tables = [np.zeros((GRID, GRID)) for _ in gam.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(gam.pairs, gam.pair_tables):
            at, g, h = grid(i, j)
            step = RATE * pair_tree(g, h)[0]
            table += step
            f += step.ravel()[at]
    return gam


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Gam | None:
    """Fit on at most SAMPLE documents of either label, chosen by the hash of their ids.

    ``labels``: doc_id, label (0/1; others are ignored); ``usable``: condition on
    doc_id.  Documents without words are left out.  None without such documents.
    """
    named = labels.where(usable & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    picked = [named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    few = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    # An id that repeats brings several rows; the bound holds for rows.
    rows = feature_table(few, "doc_id", "label").where("x[0] > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * SAMPLE).toArrow()
    if not rows.num_rows:
        return None
    x, y = np.array(rows["x"].to_pylist()), rows["label"].to_numpy().astype(float)
    total = sum(share.values())
    had = [max((y == k).mean(), 1e-9) for k in (0, 1)]
    return fit_gam(x, y, np.where(y == 1, share.get(1, 0) / total / had[1], share.get(0, 0) / total / had[0]))


def score(docs: DataFrame, gam: Gam | None, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` columns and ``name`` (0 to 1, higher: good) for every row of ``docs`` (text).

    A null, empty or blank text scores 0, any other text 1 if there is no model.
    Long texts are scored whole, repeated rows each for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gam)

    def run(cols, _):
        x = np.array([features(b) for b in cols["__bytes"].to_pylist()])
        s = shared.value.score(x) if shared.value else np.ones(len(x))
        return {k: cols[k] for k in keep} | {"__score": pa.array(np.where(x[:, 0] > 0, s, 0.0))}

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", __score double"
    return map_batches(docs.select(*keep, text_bytes(F.col("text")).alias("__bytes")), run, schema).withColumnRenamed("__score", name)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores by a model learnt from ``labels.quality`` of the ids outside fold 0 of 5.

    Returns doc_id, held_out, score, predicted (score >= 0.3).
    """
    held_out = id_fold(F.col("doc_id"), 5) == 0
    gam = train(docs, labels.select("doc_id", F.col("quality").alias("label")), ~held_out)
    out = score(docs, gam, "doc_id")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
