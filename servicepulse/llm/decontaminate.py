"""Benchmark passages in documents, by SimHash of item-sized windows.

An item of ``L`` words is compared with every window of ``L`` words of every
document, on their five-word shingles; a document of fewer words is one window
as a whole.  The similarity of a window and an item
is the weighted Jaccard similarity, a shingle weighing as often as it occurs:
the sum of the smaller over the sum of the larger weights.

A window of ``a`` shingles of similarity ``s`` to an item of ``b`` shares at least
``s (a + b) / (1 + s)`` of them, so windows with fewer shingles of items of that
length are passed over; this loses nothing.  Every other window gets a SimHash fingerprint
of ``BITS`` bits, and a multi-index over the items' fingerprints, one table per
block of ``BLOCK_BITS`` bits, gives all items within ``RADIUS``: a fingerprint
that near agrees in some block up to the block's pigeonhole share.  Each
candidate is then verified by its exact similarity.  A shingle votes once for
each of its occurrences in the window, the first, second and so on with votes
of their own, so the weighted similarity is that of plain sets of votes.  At
similarity 0.8 a pair is expected 19 bits apart with deviation 4, however often
shingles repeat; ``RADIUS`` is six deviations further.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import U, WordHashes, map_arrow, map_batches, mix64, shingle_hashes, text_bytes, words_of
from servicepulse.session import materialize

BITS, RADIUS, BLOCK_BITS = 128, 44, 8
#: Items and bytes of benchmark text that are broadcast at a time.
ITEMS, ITEM_BYTES = 2000, 4 << 20
_SALTS = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25))


def signs(shingles: np.ndarray) -> np.ndarray:
    """(n, BITS) of +1 and -1: the pseudo-random signs of each shingle."""
    words = np.stack([mix64(shingles ^ s) for s in _SALTS], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def occurrences(s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position, how often its shingle occurs in the ``width`` positions that end there, and that start there."""
    order = np.argsort(s, kind="stable")
    group = np.concatenate([[0], np.cumsum(s[order][1:] != s[order][:-1])])
    at = group * (len(s) + width) + order
    rank = np.arange(len(s))
    ending, starting = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    ending[order] = rank - np.searchsorted(at, at - (width - 1)) + 1
    starting[order] = np.searchsorted(at, at + (width - 1), "right") - rank
    return ending, starting


def votes(shingles: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Signs of each shingle as the ``nth`` of its kind: one vote per shingle and occurrence number."""
    return signs(np.where(nth > 1, mix64(shingles + nth.astype(np.uint64) * _SALTS[0]), shingles))


def window_sums(s: np.ndarray, width: int) -> np.ndarray:
    """Sums of votes of all windows of ``width`` shingles, occurrences numbered within each window.

    A window takes the vote of the last of its kind when it gains an occurrence, and gives back that one when it loses one.
    """
    ending, starting = occurrences(s, width)
    gained = np.zeros((len(s) + 1, BITS), np.int32)
    np.cumsum(votes(s, ending), axis=0, out=gained[1:])
    if ending.max() == 1:
        return gained[width:] - gained[:-width]
    lost = np.zeros((len(s) - width + 1, BITS), np.int32)
    np.cumsum(votes(s[: len(s) - width], starting[: len(s) - width]), axis=0, out=lost[1:])
    return gained[width:] - lost


def fingerprint(total: np.ndarray) -> np.ndarray:
    """Sums of signs (n, BITS) -> packed fingerprints (n, BITS / 8 bytes)."""
    return np.packbits(total > 0, axis=1)


class Benchmark:
    """Items with their shingles, fingerprints and the multi-index over them."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, percent: int):
        words = WordHashes()
        self.shingle, self.percent = shingle, percent
        self.ids, self.words, self.counts = [], [], []
        sets, prints = [], []
        for item, raw in items:
            h = words.of(words_of(raw))
            s = shingle_hashes(h, shingle)
            if len(s):
                self.ids.append(item)
                self.words.append(len(h))
                self.counts.append(Counter(s.tolist()))
                sets.append(s)
                prints.append(fingerprint(window_sums(s, len(s)))[0])
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known >> U(44)).astype(np.int64)] = True
        self.prints = np.array(prints, np.uint8).reshape(len(prints), BITS // 8)
        self.lengths: dict[int, np.ndarray] = {n: np.flatnonzero(np.array(self.words) == n) for n in sorted(set(self.words))}
        # Which lengths of items each known shingle belongs to.
        self.member = np.zeros((len(self.known), len(self.lengths)), bool)
        for k, items in enumerate(self.lengths.values()):
            self.member[np.searchsorted(self.known, np.concatenate([sets[i] for i in items])), k] = True
        # Per block of a fingerprint: which items have a value within the block's share of each value.
        blocks = BITS // BLOCK_BITS
        share, more = divmod(RADIUS, blocks)
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        self.near = [(apart <= (share if j <= more else share - 1))[:, self.prints[:, j]] for j in range(blocks)] if prints else []

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> np.ndarray:
        """(windows, items): whether the fingerprints are within RADIUS, by way of the block tables."""
        met = np.zeros((len(prints), len(items)), bool)
        for j, table in enumerate(self.near):
            met |= table[prints[:, j]][:, items]
        w, i = np.nonzero(met)
        far = np.bitwise_count(prints[w] ^ self.prints[items[i]]).sum(axis=1) > RADIUS
        met[w[far], i[far]] = False
        return met

    def similarity(self, item: int, shingles: np.ndarray) -> tuple[int, int]:
        """Shared and joint weight of a window and an item."""
        own, other = Counter(shingles.tolist()), self.counts[item]
        shared = sum((own & other).values())
        return shared, own.total() + other.total() - shared

    def find(self, h: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Items found in a text of word hashes ``h``: item -> (shared, joint weight, first word) of its best window."""
        best: dict[int, tuple[int, int, int]] = {}
        if len(h) >= self.shingle:
            self._windows(shingle_hashes(h, self.shingle), best)
        # Items and windows shorter than a shingle are one shingle as a whole.
        for n, items in self.lengths.items():
            if n < self.shingle and n <= len(h):
                whole = shingle_hashes(h, n)
                for item in items:
                    at = np.flatnonzero(whole == U(next(iter(self.counts[item]))))
                    if len(at):
                        best[item] = (1, 1, int(at[0]))
        return best

    def _windows(self, s: np.ndarray, best: dict[int, tuple[int, int, int]]) -> None:
        maybe = np.flatnonzero(self.bitmap[(s >> U(44)).astype(np.int64)])
        if not len(maybe):
            return
        at = np.searchsorted(self.known, s[maybe]).clip(max=len(self.known) - 1)
        known = self.known[at] == s[maybe]
        maybe, member = maybe[known], self.member[at[known]]
        totals = member.sum(axis=0)
        for k, (n, items) in enumerate(self.lengths.items()):
            size = n - self.shingle + 1
            # A text shorter than the item is one window as a whole.
            width = min(size, len(s))
            need = -(-self.percent * (size + width) // (100 + self.percent))
            if size < 1 or need > width or totals[k] < need:
                continue
            hit = np.zeros(len(s) + 1, np.int64)
            hit[maybe[member[:, k]] + 1] = 1
            hits = np.cumsum(hit)
            starts = np.flatnonzero(hits[width:] - hits[:-width] >= need)
            # In blocks of windows, so that the sums of signs stay small.
            for lo in range(0, len(starts), 2048):
                some = starts[lo : lo + 2048]
                runs = np.split(some, np.flatnonzero(np.diff(some) > width) + 1)
                for run in runs:
                    a = int(run[0])
                    prints = fingerprint(window_sums(s[a : int(run[-1]) + width], width)[run - a])
                    for w, i in zip(*np.nonzero(self.candidates(prints, items))):
                        item, p = int(items[i]), int(run[w])
                        shared, joint = self.similarity(item, s[p : p + width])
                        if shared * 100 >= self.percent * joint and (item not in best or shared * best[item][1] > best[item][0] * joint):
                            best[item] = (shared, joint, p)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, first_word, n_words, shared, joint, similarity: the best window of
    every document for every item that it holds at ``percent`` or more; of equally
    good windows the first.

    ``n_words`` are the words of the window: the item's, or the document's if it
    has fewer.  Words are A-Z lower-cased and split at white space.  Items of fewer words than
    ``shingle`` are one shingle as a whole.  Items and documents that are null,
    empty or blank match nothing.  Null ids are returned as they are; rows that
    repeat an id are each searched and each returned; other columns are ignored.
    ``benchmark`` (item_id, text) is broadcast in blocks of bounded size.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("raw"))
    schema = "doc_id long, item_id long, first_word long, n_words long, shared long, joint long, similarity double"
    out = None
    for index in _Blocks(benchmark, shingle, percent):
        found = _search(src, docs.sparkSession.sparkContext.broadcast(index), schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item (as
    :func:`contaminated` finds them); rows are dropped in place, nothing is shuffled."""
    at = docs.columns.index("text")
    blocks = _Blocks(benchmark, shingle, percent)
    for k, index in enumerate(blocks):
        docs = map_arrow(docs, _dropper(docs.sparkSession.sparkContext.broadcast(index), at), docs.schema)
        if k + 1 < len(blocks):
            docs = materialize(docs, "decontaminated")
    return docs


def _dropper(shared, at: int):
    def run(batches):
        words = WordHashes()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                hashes = (words.of(words_of((t or "").encode())) for t in b.column(at).to_pylist())
                yield b.filter(pa.array([not (len(h) and shared.value.find(h)) for h in hashes]))

    return run


class _Blocks:
    """The benchmark's items in blocks of bounded size, indexed one at a time."""

    def __init__(self, benchmark: DataFrame, shingle: int, percent: int):
        self.items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes(F.col("text")).alias("raw")).where(F.length("raw") > 0)
        self.shingle, self.percent = shingle, percent
        size = self.items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("b")).first()
        self.n = max(1, -(-size["n"] // ITEMS), -(-(size["b"] or 0) // ITEM_BYTES))

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        for block in range(self.n):
            rows = self.items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(self.n)) == block).collect()
            yield Benchmark(sorted(((r["item_id"], bytes(r["raw"])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), self.shingle, self.percent)


def _search(src: DataFrame, shared, schema: str) -> DataFrame:
    def run(cols, words):
        bench = shared.value
        rows = []
        for doc, raw in zip(cols["doc_id"].to_pylist(), cols["raw"].to_pylist()):
            h = words.of(words_of(raw))
            for item, (common, joint, p) in sorted(bench.find(h).items()) if len(h) else ():
                rows.append((doc, bench.ids[item], p, min(bench.words[item], len(h)), common, joint, common / joint))
        names = ("doc_id", "item_id", "first_word", "n_words", "shared", "joint", "similarity")
        return {n: pa.array([r[i] for r in rows], pa.float64() if n == "similarity" else pa.int64()) for i, n in enumerate(names)}

    return map_batches(src, run, schema, WordHashes)
