"""Log-bilinear language model trained with noise-contrastive estimation.

Words are counted over all training documents.  Each word seen ``LEAST`` times
or more (up to the bound ``HEAD``) has a context vector ``r`` and a target
vector ``t`` of its own; all others share one of either.  A token's prediction
is ``q = r[w-1] C1 + r[w-2] C2``, and its probability a two-level softmax:
``P(class | q) P(word | class, q)``, with about as many classes as words in
each.  Log-probabilities are normalised exactly by batched matrix products.
Within the class of all other words a word has the share
``(c + 0.5) / (sum over them of (c + 0.5) + 0.5)``, the last half for all
words that training never saw.

Training goes over all training tokens in ``ROUNDS`` rounds, each on a slice of
the documents by hash.  A round deals its slice by hash into shards of about
``SHARD`` tokens, in hash order; each shard takes noise-contrastive steps from the
common start, and every row of parameters becomes the mean of the shards' rows,
weighted by how often they touched it.  Shards depend on the data alone, so
the model does not depend on how the input was partitioned.  The first round
knows no classes and contrasts words with words; halving the target vectors
along their main directions then gives classes of like contexts.

Counts are keyed by 64-bit word hashes.  Words frequent enough to fit the
bounded ``HEAD`` are broadcast with their counts; the rest of a document's
words meets the count table in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import id_fold, map_arrow, text_bytes
from servicepulse.session import materialize

#: Words that may be broadcast with their counts (16 bytes each) and have vectors, and counts these need at least.
HEAD, LEAST = 200_000, 4
DIM, NOISE, INNER_NOISE, STEP, RATE = 16, 64, 8, 2048, 0.1
#: Eighths of the documents by hash where the rounds end, and tokens of a shard.
ROUNDS, SHARD = (1, 4, 8), 2_000_000
#: Rows of parameters that travel together, tokens whose class sums and whose predictions are held together, classes
#: whose factors are held together, tokens of a class in a tile.
BLOCK, SPAN, CHUNK, WIDTH, TILE = 512, 1 << 20, 1 << 18, 64, 8
END = b""
_END_HASH = xxhash.xxh3_64_intdigest(END)
_LIMIT = 400_000
#: Texts of a training batch, and bytes of texts counted or scored together (a longer text alone).
_ROWS, _BYTES = 400, 5 << 20


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def encode(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts (binary), ends included, as places in an array of hashes; the tokens per text; and that array.

    Words are those of ``common.words_of``, cut and numbered by Arrow, so that only the distinct ones are hashed.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(raw.view(pa.string())))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    # White space at either end of a text leaves an empty piece, which is no word; the last place is the end's.
    words.append(END)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
    pieces = coded.indices.to_numpy()
    kept = hashes[pieces] != hashes[-1] if END in words[:-1] else np.ones(len(pieces), bool)
    before = np.append(0, np.cumsum(kept))
    offsets = lists.offsets.to_numpy()
    upto = before[offsets - offsets[0]]
    ids = np.full(upto[-1] + len(raw), len(words) - 1, np.int32)
    place = np.ones(len(ids), bool)
    place[upto[1:] + np.arange(len(raw))] = False
    ids[place] = pieces[kept]
    return ids, np.diff(upto) + 1, hashes


class Head:
    """What is known of the frequent words: their hashes (rising), counts, and numbers by falling count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, numbers: np.ndarray):
        self.hashes, self.counts, self.numbers = hashes, counts, numbers

    def find(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not in the head) and numbers of words; those beyond ``size`` are one, with the number ``size``."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.full(len(hashes), size)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return np.where(there, self.counts[at], -1), np.where(there, self.numbers[at].clip(max=size), size)


def contexts(w: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Words one and two tokens back, ``start`` before the first token."""
    first = np.cumsum(lengths) - lengths
    p1 = np.roll(w, 1)
    p1[first] = start
    p2 = np.roll(p1, 1)
    p2[first] = start
    return p1, p2


class Classes:
    """Classes of the words 0..size-1; the word ``size`` (all others) is the last class, alone."""

    def __init__(self, of: np.ndarray, unigram: np.ndarray):
        self.of, self.n = np.append(of, of.max(initial=-1) + 1).astype(np.int64), int(of.max(initial=-1)) + 2
        self.members = np.argsort(self.of, kind="stable")
        self.starts = np.searchsorted(self.of[self.members], np.arange(self.n + 1))
        self.mass = np.bincount(self.of, unigram, minlength=self.n)
        self.inside = np.log(unigram / self.mass[self.of])
        self.cum = np.append(0.0, np.cumsum(unigram[self.members]))

    @classmethod
    def of_vectors(cls, t: np.ndarray, unigram: np.ndarray) -> Classes:
        """Halves the words along the main direction of their vectors until about sqrt(words) classes are left.

        Halves are equal in the sum of the roots of their counts: frequent words, which most tokens are, get small classes.
        """
        weight = np.sqrt(unigram)
        parts = [np.arange(len(t))]
        for _ in range(round(np.log2(len(t)) / 2) if len(t) else 0):
            halves = []
            for p in parts:
                x = t[p] - t[p].mean(axis=0)
                side = np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")
                upto = np.cumsum(weight[p[side]])
                cut = int(np.searchsorted(upto, upto[-1] / 2, side="right"))
                halves += [p[np.sort(side[:cut])], p[np.sort(side[cut:])]]
            parts = [p for p in halves if len(p)]
        of = np.zeros(len(t), np.int64)
        for i, p in enumerate(parts):
            of[p] = i
        return cls(of, unigram)

    def noise(self, kinds: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """INNER_NOISE words of each class, by their shares."""
        low, high = self.starts[kinds][:, None], self.starts[kinds + 1][:, None] - 1
        # Sorted, as a search for rising values stays in the cache.
        x = self.cum[low] + np.sort(rng.random((len(kinds), INNER_NOISE)), axis=1) * self.mass[kinds][:, None]
        return self.members[np.clip(np.searchsorted(self.cum, x, side="right") - 1, low, high)]


class Params:
    """All parameters as rows of one matrix: context vectors, target vectors with bias, class vectors with bias, C1 and C2.

    Each row has its sum of squared gradients (AdaGrad by rows).
    """

    def __init__(self, size: int, classes: int, rows: np.ndarray | None = None, squares: np.ndarray | None = None):
        self.size, self.n_classes = size, classes
        self.T = size + 2
        self.U = self.T + size + 1
        self.C = self.U + classes
        n = self.C + 2 * DIM
        self.rows = np.zeros((n, DIM + 1), np.float32) if rows is None else rows
        self.squares = np.full(n, 1e-6, np.float32) if squares is None else squares

    r = property(lambda self: self.rows[: self.T, :DIM])
    t = property(lambda self: self.rows[self.T : self.U])
    u = property(lambda self: self.rows[self.U : self.C])
    c1 = property(lambda self: self.rows[self.C : self.C + DIM, :DIM])
    c2 = property(lambda self: self.rows[self.C + DIM :, :DIM])

    def copy(self) -> Params:
        return Params(self.size, self.n_classes, self.rows.copy(), self.squares.copy())

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int) -> Params:
        """Before the first round: no classes, targets that give the unigram."""
        m = cls(len(unigram) - 1, 0)
        m.r[:] = np.random.default_rng(seed).normal(0, 0.3, m.r.shape)
        m.c1[:], m.c2[:] = np.eye(DIM), np.eye(DIM) * 0.7
        m.t[:, DIM] = np.log(unigram)
        return m

    def with_classes(self, classes: Classes, unigram: np.ndarray) -> Params:
        """Class vectors are the means of their words' vectors, which become differences from them."""
        m = Params(self.size, classes.n)
        m.r[:], m.c1[:], m.c2[:] = self.r, self.c1, self.c2
        m.squares[: m.U] = self.squares[: self.U]
        m.squares[m.C :] = self.squares[self.C :]
        vectors = np.zeros((classes.n, DIM))
        np.add.at(vectors, classes.of, unigram[:, None] * self.t[:, :DIM])
        m.u[:, :DIM] = vectors / classes.mass[:, None]
        m.u[:, DIM] = np.log(classes.mass)
        m.t[:, :DIM] = self.t[:, :DIM] - m.u[classes.of, :DIM]
        m.t[:, DIM] = classes.inside
        return m


def _sigmoid(x: np.ndarray, times: int = 1) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(np.float32(times), x, out=x)


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts equal values together (stable), the values in it, and where each begins."""
    # Sorting values with their places packed into one integer is several times faster than argsort.
    n = len(x)
    key = np.sort(x.astype(np.int64) * n + np.arange(n))
    own = key // n
    return key - own * n, own, np.flatnonzero(np.r_[True, own[1:] != own[:-1]])


def _sums(x: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``x[order]`` from each of ``starts`` to the next."""
    n = np.diff(np.append(starts, len(order)))
    out = x.take(order[starts], axis=0)
    many = n > 1
    if many.any():
        # Rows that stand alone, mostly the larger part, need no sum.
        upto = np.cumsum(n[many])
        out[many] = np.add.reduceat(x.take(order[np.repeat(many, n)], axis=0), upto - n[many], axis=0)
    return out


class Trainer:
    """Noise-contrastive steps; without ``classes`` words are told from words.

    Each row of parameters lies together with its sum of squares and its number of touches, so that one access
    reads or writes them all.  Predictions are as wide, with 1 for the bias and 0 for the rest.
    """

    SQUARES, TOUCHED, WIDE = DIM + 1, DIM + 2, DIM + 4

    def __init__(self, start: Params, classes: Classes | None, unigram: np.ndarray, seed: int):
        self.all = np.zeros((len(start.rows), self.WIDE), np.float32)
        self.all[:, : DIM + 1], self.all[:, self.SQUARES] = start.rows, start.squares
        self.m = Params(start.size, start.n_classes, self.all[:, : DIM + 1], self.all[:, self.SQUARES])
        self.touched = self.all[:, self.TOUCHED]
        self.classes, self.rng = classes, np.random.default_rng(seed)
        p = unigram if classes is None else classes.mass
        self.cum, self.log_noise = np.cumsum(p), np.log(NOISE * p).astype(np.float32)
        if classes is not None:
            self.log_inside = (classes.inside + np.log(INNER_NOISE)).astype(np.float32)

    def _add(self, at: int, rows: np.ndarray, grad: np.ndarray, width: int) -> None:
        """A step along ``grad`` (of ``width`` columns, the rest 0), summed by rows."""
        order, own, starts = _grouped(rows)
        self._move(own[starts] + at, _sums(grad, order, starts), np.diff(np.append(starts, len(own))), width, RATE)

    def _move(self, rows: np.ndarray, grad: np.ndarray, times, width: int, rate: float) -> None:
        old, more = self.all.take(rows, axis=0), np.einsum("ij,ij->i", grad, grad) / width
        grad *= (rate / np.sqrt(old[:, self.SQUARES] + more))[:, None]
        grad[:, self.SQUARES], grad[:, self.TOUCHED] = more, times
        old += grad
        self.all[rows] = old

    def _outer(self, at: int, q1: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One step of the targets from row ``at`` on, noise shared by all tokens; returns the gradient of q."""
        noise = np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]).clip(max=len(self.cum) - 1)
        t, tn = self.all.take(at + w, axis=0), self.all.take(at + noise, axis=0)
        g = 1 - _sigmoid(np.einsum("ij,ij->i", q1, t) - self.log_noise[w])
        tn[:, DIM] -= self.log_noise[noise]
        gn = _sigmoid(q1 @ tn.T, -1)
        t *= g[:, None]
        t += gn @ tn
        self._add(at, np.concatenate([w, noise]), np.concatenate([g[:, None] * q1, gn.T @ q1]), DIM + 1)
        return t[:, :DIM]

    def _inner(self, q1: np.ndarray, w: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One step of the words ``w`` within their classes ``of``, in which they are sorted, each from ``first`` on.

        Noise is shared by the tokens of a class.  Returns the gradient of q.
        """
        n = np.diff(np.append(first, len(of)))
        noise = self.classes.noise(of[first], self.rng)
        # The tokens of a class fill tiles of TILE rows, the last one with zeros, so that products are taken tile by tile.
        tiles = -(-n // TILE)
        begin = np.cumsum(tiles) - tiles
        place = np.arange(len(of)) + np.repeat(begin * TILE - first, n)
        t, tn = self.all.take(self.m.T + w, axis=0), self.all.take(self.m.T + noise, axis=0)
        tn[:, :, DIM] -= self.log_inside[noise]
        tn = tn.take(np.repeat(np.arange(len(first)), tiles), axis=0)
        q = np.zeros((len(tn), TILE, self.WIDE), np.float32)
        q.reshape(-1, self.WIDE)[place] = q1
        g = 1 - _sigmoid(np.einsum("ij,ij->i", q1, t) - self.log_inside[w])
        gn = _sigmoid(q @ tn.transpose(0, 2, 1), -1)
        t *= g[:, None]
        t += (gn @ tn).reshape(-1, self.WIDE).take(place, axis=0)
        of_noise = _sums((gn.transpose(0, 2, 1) @ q).reshape(len(tn), -1), np.arange(len(tn)), begin)
        self._add(self.m.T, np.concatenate([w, noise.ravel()]), np.concatenate([g[:, None] * q1, of_noise.reshape(-1, self.WIDE)]), DIM + 1)
        return t[:, :DIM]

    def step(self, p1: np.ndarray, p2: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        r1, r2 = self.all.take(p1, axis=0)[:, :DIM], self.all.take(p2, axis=0)[:, :DIM]
        q1 = np.zeros((len(w), self.WIDE), np.float32)
        q1[:, :DIM] = r1 @ m.c1 + r2 @ m.c2
        q1[:, DIM] = 1
        if self.classes is None:
            gq = self._outer(m.T, q1, w)
        else:
            order, of, first = _grouped(self.classes.of[w])
            q1 = q1.take(order, axis=0)
            by_class = self._outer(m.U, q1, of)
            # The last class, alone, has one word.
            n = int(np.searchsorted(of, self.classes.n - 1))
            if n:
                by_class[:n] += self._inner(q1[:n], w[order[:n]], of[:n], first[first < n])
            gq = np.empty((len(w), DIM), np.float32)
            gq[order] = by_class
        maps = np.zeros((2 * DIM, self.WIDE), np.float32)
        maps[:DIM, :DIM], maps[DIM:, :DIM] = r1.T @ gq, r2.T @ gq
        # A word is context of the two tokens after it: its two gradients are added up before they are sorted by word.
        b1, b2 = gq @ m.c1.T, gq @ m.c2.T
        off1, off2 = p1 > m.size, p2 > m.size
        back = np.zeros((len(w) + 2, self.WIDE), np.float32)
        back[-1, :DIM] = b1[off1].sum(axis=0) + b2[off2].sum(axis=0)
        b1[off1], b2[off2] = 0, 0
        back[1:-1, :DIM] = b1
        back[:-2, :DIM] += b2
        self._add(0, np.concatenate([p2[:1], p1, [m.size + 1]]), back, DIM)
        self._move(np.arange(m.C, m.C + 2 * DIM), maps, 1, DIM, RATE / 5)

    def feed(self, p1: np.ndarray, p2: np.ndarray, w: np.ndarray) -> None:
        for i in range(0, len(w), STEP):
            self.step(p1[i : i + STEP], p2[i : i + STEP], w[i : i + STEP])


class Scorer:
    """Normalised natural log-probabilities of tokens."""

    def __init__(self, m: Params, classes: Classes):
        # As wide as the targets, so that a prediction is the sum of two rows: 0 and 1 for the bias.
        self.a1, self.a2 = (np.column_stack([m.r @ c, np.full(len(m.r), one, np.float32)]) for one, c in enumerate((m.c1, m.c2)))
        self.u, self.classes = m.u, classes
        self.t = m.t[classes.members]
        self.place = np.empty(len(classes.of), np.int64)
        self.place[classes.members] = np.arange(len(classes.of))
        self.longest = float(np.sqrt(max((x * x).sum(axis=1).max() for x in (self.u, self.t))))
        # Bounds of a context word's part of the class scores; the biases go with the second word back.
        steep, bias = float(np.linalg.norm(self.u[:, :DIM], axis=1).max()), float(abs(self.u[:, DIM]).max())
        self.bound1, self.bound2 = (np.linalg.norm(a[:, :DIM], axis=1) * steep + bias * a[:, DIM] for a in (self.a1, self.a2))

    def __call__(self, p1: np.ndarray, p2: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(w))
        for i in range(0, len(w), CHUNK):
            at = slice(i, i + CHUNK)
            out[at] = self._chunk(p1[at], p2[at], w[at])
        for i in range(0, len(w), SPAN):
            at = slice(i, i + SPAN)
            out[at] -= self._class_sums(p1[at], p2[at])
        return out

    @staticmethod
    def _log_sums(q1: np.ndarray, t: np.ndarray, small: bool) -> np.ndarray:
        """log of the sum of exp(score) over the rows of ``t``; ``small``: no score can overflow."""
        out = np.empty(len(q1))
        # Blocks that stay in the cache.
        rows = max(16, (1 << 17) // len(t))
        for i in range(0, len(q1), rows):
            s = q1[i : i + rows] @ t.T
            top = 0 if small else s.max(axis=1)
            if not small:
                s -= top[:, None]
            np.exp(s, out=s)
            out[i : i + rows] = np.log(s @ np.ones(len(t), np.float32)) + top
        return out

    def _class_sums(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """log of the sum of exp(score) over the classes, for each context.

        exp((a1 + a2) u) = exp(a1 u) exp(a2 u): exponentials are taken once for each distinct word of either place, and
        a pair of words is the product of their rows.  Pairs whose factors might leave the range of floats go the plain way.
        """
        order, own, first = _grouped(p1 * len(self.a1) + p2)
        one, two = np.divmod(own[first], len(self.a1))
        out = np.empty(len(first))
        safe = self.bound1[one] + self.bound2[two] < 80
        far, near = np.flatnonzero(~safe), np.flatnonzero(safe)
        for i in range(0, len(far), STEP):
            x, y = one[far[i : i + STEP]], two[far[i : i + STEP]]
            out[far[i : i + STEP]] = self._log_sums(self.a1[x] + self.a2[y], self.u, False)
        (words1, at1), (words2, at2) = (self._distinct(x[near]) for x in (one, two))
        a1, a2 = self.a1[words1], self.a2[words2]
        sums, rooms = np.zeros(len(near), np.float32), [np.empty(len(a) * WIDTH, np.float32) for a in (a1, a2)]
        for k in range(0, len(self.u), WIDTH):
            e1, e2 = (self._exps(a, self.u[k : k + WIDTH], room) for a, room in zip((a1, a2), rooms))
            for i in range(0, len(near), STEP):
                at = slice(i, i + STEP)
                sums[at] += np.einsum("ij,ij->i", e1.take(at1[at], axis=0), e2.take(at2[at], axis=0))
        out[near] = np.log(sums)
        each = np.empty(len(p1))
        each[order] = np.repeat(out, np.diff(np.append(first, len(own))))
        return each

    @staticmethod
    def _exps(a: np.ndarray, u: np.ndarray, room: np.ndarray) -> np.ndarray:
        """exp(a u') written to ``room``, in blocks that stay in the cache."""
        out, u = room[: len(a) * len(u)].reshape(len(a), len(u)), np.ascontiguousarray(u.T)
        for i in range(0, len(a), 1024):
            part = np.matmul(a[i : i + 1024], u, out=out[i : i + 1024])
            np.exp(part, out=part)
        return out

    def _distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of ``x``, and where each of ``x`` is among them."""
        there = np.zeros(len(self.a1), bool)
        there[x] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[x]

    def _chunk(self, p1, p2, w) -> np.ndarray:
        """The scores of the tokens' classes, not normalised, and their logs of probability within the classes."""
        order, own, first = _grouped(self.classes.of[w])
        # From here on in the order of the classes.
        q1 = self.a1.take(p1[order], axis=0)
        q1 += self.a2.take(p2[order], axis=0)
        # Bound of every score: |q| |t| by Cauchy and Schwarz.
        small = bool(np.sqrt(np.einsum("ij,ij->i", q1, q1).max()) * self.longest < 80)
        inside = np.einsum("ij,ij->i", q1, self.t.take(self.place[w[order]], axis=0)).astype(float)
        for k, a, b in zip(own[first], first, np.append(first[1:], len(own))):
            low, high = self.classes.starts[k], self.classes.starts[k + 1]
            inside[a:b] -= self._log_sums(q1[a:b], self.t[low:high], small) if high - low > 1 else inside[a:b]
        out = np.empty(len(w))
        out[order] = np.einsum("ij,ij->i", q1, self.u.take(own, axis=0)) + inside
        return out


def _portions(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Rows whose texts begin within the same _BYTES bytes."""
    upto = np.cumsum(pc.binary_length(batch.column(text)).to_numpy())
    cuts = np.flatnonzero(np.diff(np.append(0, upto[:-1]) // _BYTES)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if j > i:
            yield batch.slice(i, j - i)


def count_words(train: DataFrame) -> DataFrame:
    """hash, c: how often each word (and the end) occurs in the texts of ``train`` (raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []

        def merge():
            x, c = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(x)
            x = x[order]
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            hashes[:], counts[:] = [x[starts]], [np.add.reduceat(c[order], starts)]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(hashes[0]), pa.array(counts[0])], names=["hash", "c"])
            hashes.clear(), counts.clear()
            return out

        for whole in batches:
            for part in _portions(whole, "raw"):
                ids, _, h = encode(part.column("raw"))
                n = np.bincount(ids, minlength=len(h))
                hashes.append(h[n > 0]), counts.append(n[n > 0])
                if sum(map(len, hashes)) > 2 * _LIMIT:
                    merge()
                    if len(hashes[0]) > _LIMIT:
                        yield flush()
        if hashes:
            merge()
            yield flush()

    return map_arrow(train.select("raw"), run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame) -> tuple[Head, np.ndarray]:
    """The words above the smallest power of two that leaves at most HEAD words, and their counts, falling."""
    powers = [1 << k for k in range(62)]
    above = counts.agg(*[F.count_if(F.col("c") >= t).alias(str(t)) for t in powers]).first()
    least = next(t for t in powers if above[str(t)] <= HEAD)
    rows = counts.where(F.col("c") >= least).select("hash", "c").toArrow()
    h, c = rows["hash"].to_numpy(), rows["c"].to_numpy()
    order = np.lexsort((h, -c))
    rising = np.argsort(h[order])
    return Head(h[order][rising], c[order][rising], rising), c[order]


def _round(rows: DataFrame, shards: int, head, start: Params, classes: Classes | None, unigram: np.ndarray, seed: int) -> Params:
    """One round: a pass over ``rows`` (h, raw) in ``shards`` tasks from a common start, averaged by rows of parameters."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((start, classes, unigram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, kinds, p = shared.value
        trainer = None
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                trainer = trainer or Trainer(begin, kinds, p, seed)
                ids, lengths, hashes = encode(whole.column(0).slice(i, _ROWS))
                w = head.value.find(hashes, begin.size)[1][ids]
                trainer.feed(*contexts(w, lengths, begin.size + 1), w)
        for i in range(0, len(begin.rows) if trainer else 0, BLOCK):
            at = slice(i, i + BLOCK)
            if trainer.touched[at].any():
                moved = (trainer.m.rows[at] - begin.rows[at]).astype(np.float16)
                more = trainer.m.squares[at] - begin.squares[at]
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([moved.tobytes()]), pa.array([np.stack([trainer.touched[at], more]).tobytes()])], names=["block", "moved", "weights"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sum per block, whatever the number of shards.
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, moved, weights in zip(*(c.to_pylist() for c in batch.columns)):
                n, more = np.frombuffer(weights, np.float32).reshape(2, -1).astype(float)
                d = np.frombuffer(moved, np.float16).reshape(len(n), DIM + 1)
                part = np.column_stack([d * n[:, None], more * n, n])
                sums[block] = sums[block] + part if block in sums else part
        for block, x in sums.items():
            mean = x[:, :-1] / np.maximum(x[:, -1:], 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.astype(np.float32).tobytes()])], names=["block", "mean"])

    each = map_arrow(rows.repartition(shards, "h").sortWithinPartitions("h").select("raw"), run, "block int, moved binary, weights binary")
    mean = map_arrow(each.repartition("block"), combine, "block int, mean binary").toArrow()
    out = start.copy()
    for block, data in zip(mean["block"].to_pylist(), mean["mean"].to_pylist()):
        x = np.frombuffer(data, np.float32).reshape(-1, DIM + 2)
        at = slice(block * BLOCK, block * BLOCK + len(x))
        out.rows[at] += x[:, :-1]
        out.squares[at] += x[:, -1]
    shared.unpersist()
    return out


def _train(train: DataFrame, n: int, head, unigram: np.ndarray, seed: int) -> tuple[Params, Classes]:
    """Parameters and classes after all rounds over ``train`` (doc_id, raw) of ``n`` tokens."""
    rows = train.select(F.xxhash64("doc_id", "raw").alias("h"), "raw")
    eighth = F.pmod(F.shiftrightunsigned("h", 3), F.lit(8))
    m, classes, begin = Params.start(unigram, seed), None, 0
    for k, end in enumerate(ROUNDS):
        shards = max(1, -(-n * (end - begin) // (8 * SHARD)))
        m = _round(rows.where((eighth >= begin) & (eighth < end)), shards, head, m, classes, unigram, seed + k)
        if classes is None:
            classes = Classes.of_vectors(m.t[:-1, :DIM], unigram)
            m = m.with_classes(classes, unigram)
        begin = end
    return m, classes


def score(docs: DataFrame, held_out, seed: int = 11) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score (log10 probability of the text).

    ``held_out``: boolean column expression over doc_id; where it is null (no
    id) the row is training.  A null or empty text is its end token alone.  With
    no training rows every word is unseen and ``train_tokens`` is 0.  Rows are
    scored each for itself, repeated ids included; other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(F.col("text")).alias("raw"))
    train = src.where(~F.col("held_out"))
    counts = materialize(count_words(train), "lm-counts")
    words, c = _head(counts)
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    size = int((c >= LEAST).sum())
    other = n - int(c[:size].sum()) + 0.5 * (v - size) + 0.5
    unigram = np.append(c[:size] + 0.5, other)
    unigram = unigram / unigram.sum()
    head = spark.sparkContext.broadcast(words)
    shared = spark.sparkContext.broadcast(Scorer(*_train(train, n, head, unigram, seed)))

    def texts(b: pa.RecordBatch) -> dict:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        ids, lengths, hashes = encode(cols["raw"])
        first = np.cumsum(lengths) - lengths
        counts, numbers = head.value.find(hashes, size)
        there = counts >= 0
        w, inside, share = numbers[ids], there[ids], np.where(there, np.log10(np.maximum(counts, 0) + 0.5), 0.0)[ids]
        logp = shared.value(*contexts(w, lengths, size + 1), w)
        per = lambda x: np.add.reduceat(x, first)
        rest = np.flatnonzero(~inside)
        owner = np.repeat(np.arange(len(lengths)), lengths)[rest]
        return {
            "doc_id": cols["doc_id"],
            "held_out": cols["held_out"],
            "n_tokens": pa.array(lengths, pa.int64()),
            "n_head": pa.array(per(inside.astype(np.int64))),
            "n_other": pa.array(per((w == size).astype(np.int64))),
            "head_sum": pa.array(per(share)),
            "head_other": pa.array(per(np.where(w == size, share, 0.0))),
            "logp": pa.array(per(logp) / np.log(10)),
            "rest": pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32()), pa.array(hashes[ids[rest]])),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _portions(whole, "raw"):
                yield pa.RecordBatch.from_pydict(texts(part))

    schema = "doc_id long, held_out boolean, n_tokens long, n_head long, n_other long, head_sum double, head_other double, logp double, rest array<long>"
    table = map_arrow(src, run, schema)
    table = materialize(table.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = table.select("row", F.explode("rest").alias("hash")).join(counts, "hash", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest_sum"), F.count("c").alias("n_rest"))
    out = table.drop("rest").join(rare, "row", "left").fillna({"rest_sum": 0.0, "n_rest": 0})
    scale = float(np.log10(n + 0.5 * (v + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("n_rest")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("rest_sum") - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("logp") + F.col("head_other") + F.col("rest_sum") - F.col("n_other") * float(np.log10(other))).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """:func:`score` with the fold crc32(doc_id) mod 5 = 1 held out."""
    return score(docs, id_fold(F.col("doc_id"), 5) == 1)
