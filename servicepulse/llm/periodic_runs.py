"""Periodic runs of words by an online sparse diagonal DP.

Word ``i`` lies with an earlier occurrence of itself, ``i - d``, on diagonal ``d``
of a text's matrix of equal words.  The DP walks a text from left to right and
keeps the match length of the diagonals in use: an occurrence at lag ``d``
lengthens the match of diagonal ``d``, a word that differs ends it, and a
diagonal that ends with sufficient length emits its run there and then.

The matrix is kept sparse without losing a run.  A run of period ``q`` needs at
least ``2 q`` matches in a row on diagonal ``q`` (16 where ``q`` is under 8), and so
holds a whole block of ``B`` matches that starts at a multiple of ``B``, for any power
of two ``B <= max(q, 8)``.  Only the blocks of the scale ``B`` with ``B <= q < 2 B``
(``B = 8`` for all ``q < 16``) put their earlier occurrences at these lags on the
diagonals, which is at most ``n`` per scale.  A lag that is a multiple of the
period of a run that is open over both occurrences adds nothing and is passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import map_batches, text_bytes

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_FIRST = 8
_STEP = 64


def _first_difference(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first position from ``at`` on, going by ``step`` (1 or -1), whose word differs from that ``lag`` before it.

    Going back it may be ``lag - 1``, going on the end of the text.
    """
    width = _STEP
    while True:
        lo, hi = (at, min(at + width, len(x))) if step > 0 else (max(at - width + 1, lag), at + 1)
        if lo >= hi:
            return at
        differ = np.flatnonzero(x[lo:hi] != x[lo - lag : hi - lag])
        if len(differ):
            return lo + int(differ[0] if step > 0 else differ[-1])
        at, width = (hi, width * 4) if step > 0 else (lo - 1, width * 4)


def _smallest(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether no divisor of ``q`` is a period of words ``start`` to ``end``.

    With three periods of ``q`` at hand any smaller period would make a divisor of ``q`` one.
    """
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = q // f
            if np.array_equal(x[start + p : end], x[start : end - p]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _ranks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers for pairs of numbers, equal exactly where the pairs are, and how many there are."""
    names, inverse = np.unique(x.astype(np.int64) * (int(y.max()) + 1) + y, return_inverse=True)
    return inverse, len(names)


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return []
    out: list[tuple[int, int, int]] = []
    # Block names of the scale by doubling; once all blocks differ, no longer block repeats.
    block, width, different = x, 1, len(number)
    while width < _FIRST:
        block, different = _ranks(block[:-width], block[width:])
        width *= 2
    opened: list[tuple[int, int, int]] = []  # (start, end, period) of repeating stretches met so far
    while different < len(block) and width * LEAST_PERIODS <= max(n, _FIRST * LEAST_PERIODS):
        least, most = (1, 2 * _FIRST - 1) if width == _FIRST else (width, 2 * width - 1)
        most = min(most, n // LEAST_PERIODS)
        # Places of every name in order; of those, the earlier occurrences of each aligned block at lags of this scale.
        at = np.arange(0, len(block), width)
        places = np.sort(block * n + np.arange(len(block)))
        lo = np.searchsorted(places, block[at] * n + np.maximum(at - most, 0))
        hi = np.searchsorted(places, block[at] * n + np.maximum(at - least, -1), "right")
        upto: dict[int, int] = {}  # diagonal -> where its match length was last ended
        opened = sorted(r for r in opened if r[1] - r[0] >= width + least)  # shorter ones cover no pair of this scale
        live, taken, known = [], 0, len(opened)
        for k in np.flatnonzero(hi > lo):
            c = int(at[k])
            lags = c - (places[lo[k] : hi[k]] % n)[::-1]
            while taken < known and opened[taken][0] < c:
                live.append(opened[taken])
                taken += 1
            live = [r for r in live if r[1] >= c + width]
            for s, _, p in live:
                lags = lags[(lags % p != 0) | (lags == p) | (c - lags < s)]
            for d in lags.tolist():
                if upto.get(d, 0) > c or any(d % p == 0 and d != p and c - d >= s for s, _, p in live):
                    continue  # this match is already counted, or a shorter period explains it
                end = upto[d] = _first_difference(x, c + width, d, 1)
                start = _first_difference(x, c - 1, d, -1) + 1 - d
                if end - start >= 2 * d:
                    live.append((start, end, d))
                    opened.append((start, end, d))
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * d) and _smallest(x, start, end, d):
                    out.append((start, end - start, d))
        if width > n:
            break
        block, different = _ranks(block[:-width], block[width:]) if len(block) > width else (block[:0], 0)
        width *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone) > 0
    return [w for w, g in zip(words, gone) if not g]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the crc32 of their id, made periodic from some word on; the others as they are."""
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_text: bool = True) -> DataFrame:
    """The runs of every row of ``docs`` (doc_id, text) and the text without its repeats.

    Words are what stands between white space (space, \\x09 to \\x0D), compared
    byte by byte; ``prepare`` may change a document's words first.  A run is a
    stretch of words with smallest period q, of ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods at least, that no neighbouring word extends.

    Returns doc_id, n_words, n_runs, runs (array of start, length, period, by start, then period), start, length, period and exponent_milli of the run with most
    periods (null without runs), and with ``with_text`` collapsed: the words that no
    run holds after its first period, joined by one space.  Null, empty and blank texts have no word
    and no run.  Every row is returned, repeated ids and null ids too; other columns are ignored.
    A text is handled whole, in memory that grows with its own length.
    """

    def run(cols, _):
        out: dict[str, list] = {k: [] for k in ("n_words", "n_runs", "runs", "start", "length", "period", "exponent_milli", "collapsed")}
        for i, raw in zip(cols["doc_id"].to_pylist(), cols["raw"].to_pylist()):
            words = raw.split()
            if prepare:
                words = prepare(i, words)
            runs = find_runs(words)
            best = strongest(runs)
            out["n_words"].append(len(words))
            out["n_runs"].append(len(runs))
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
            for name, v in zip(("start", "length", "period"), best or (None, None, None)):
                out[name].append(v)
            out["exponent_milli"].append(best and 1000 * best[1] // best[2])
            if with_text:
                out["collapsed"].append(b" ".join(collapse(words, runs)).decode())
        return {"doc_id": cols["doc_id"], **out}

    schema = "doc_id long, n_words long, n_runs long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, exponent_milli long"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw"))
    return map_batches(src, run, schema + (", collapsed string" if with_text else ""), rows=256)


def digest(found: DataFrame) -> DataFrame:
    """Digests of the runs and of the collapsed text of each row of ``periodic_runs``."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    runs = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", sha(runs).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
