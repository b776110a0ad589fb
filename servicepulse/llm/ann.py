"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A vector's code has ``SUBSTRINGS`` parts of up to 64 bits.  Each part holds the
signs of the centred, reduced vector under a rotation that is learnt (iterative
quantisation) so that the signs lose little of the vector.  Rows are indexed in
blocks; a block has one table per part, from the part's values to rows.  A
query probes each table within the pigeonhole share of the radius: a code
within radius ``r`` of the query's has a part within its share, so every such
code is retrieved.  Codes beyond ``r`` over all parts are dropped and the rest
are ranked by the cosine of the original vectors in double precision.

The rotations and the radius are fitted on a bounded sample; all rows are
indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servicepulse.llm.common import map_arrow
from servicepulse.session import materialize

#: Bound of the sample for rotations and radius, and share of its true neighbours the radius must reach.
SAMPLE, REACH = 12_000, 0.985
SUBSTRINGS, BITS = 4, 64
#: Vectors of an index block, and queries that are broadcast at a time.
BLOCK, QUERIES = 16_384, 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Coder:
    """Mean, reduction and rotations; ``radius`` is set by :func:`fit`."""

    def __init__(self, mean: np.ndarray, maps: list[np.ndarray], radius: int):
        self.mean, self.maps, self.radius = mean, maps, radius

    @property
    def dim(self) -> int:
        return len(self.mean)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors: (rows, SUBSTRINGS) unsigned 64-bit parts."""
        out = np.zeros((len(unit), len(self.maps)), np.uint64)
        for j, m in enumerate(self.maps):
            bits = np.zeros((len(unit), 64), np.uint8)
            bits[:, : m.shape[1]] = (unit - self.mean) @ m > 0
            out[:, j] = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
        return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def fit(x: np.ndarray, k: int, seed: int = 5, rounds: int = 25) -> Coder:
    """Learn the rotations on a sample of vectors and the radius that reaches REACH of its own neighbours."""
    unit = _unit(x)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    reduce = axes[:, ::-1][:, : min(BITS, x.shape[1])]
    z = centred @ reduce
    rng = np.random.default_rng(seed)
    maps = []
    for _ in range(SUBSTRINGS):
        rot = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(z @ rot).T @ z)
            rot = (u @ vt).T
        maps.append(reduce @ rot)
    coder = Coder(mean, maps, 0)
    codes = coder.codes(unit)
    reached = []
    for i in np.linspace(0, len(x) - 1, min(len(x), 300)).astype(int):
        s = unit @ unit[i]
        s[i] = -2
        near = np.argsort(-s)[: min(k, len(x) - 1)]
        reached.append(hamming(codes[near], codes[i]))
    flat = np.concatenate(reached) if reached else np.zeros(0)
    coder.radius = int(np.quantile(flat, REACH, method="higher")) if len(flat) else SUBSTRINGS * BITS
    return coder


class Index:
    """Tables of one block: per part its distinct values and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            keys, starts = np.unique(codes[order, j], return_index=True)
            self.tables.append((keys, np.append(starts, len(order)), order))

    @staticmethod
    def _ball(radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(64), k)], np.uint64)

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``q``, in order."""
        share, more = divmod(radius, len(self.tables))
        mark = np.zeros(len(self.codes), bool)
        for j, (keys, starts, order) in enumerate(self.tables):
            # radius = parts * share + more: all parts beyond share, `more` of them by one, cannot add up to it.
            own = share if j <= more else share - 1
            if own < 0:
                continue
            if own <= 2 and sum(comb(64, i) for i in range(own + 1)) < len(keys):
                want = np.sort(q[j] ^ self._ball(own))
                at = np.searchsorted(keys, want).clip(max=len(keys) - 1)
                hit = at[keys[at] == want]
            else:
                hit = np.flatnonzero(np.bitwise_count(keys ^ q[j]) <= own)
            sizes = starts[hit + 1] - starts[hit]
            flat = np.arange(int(sizes.sum())) + np.repeat(starts[hit] - (np.cumsum(sizes) - sizes), sizes)
            mark[order[flat]] = True
        rows = np.flatnonzero(mark)
        return rows[hamming(self.codes[rows], q) <= radius]


def _search(ids: list[list[int]], x: np.ndarray, coder: Coder, qid: np.ndarray, qx: np.ndarray, k: int):
    """The block's ``k`` nearest of every query: query ids, vec ids, scores."""
    unit, qunit = _unit(x), _unit(qx)
    index, qcodes = Index(coder.codes(unit)), coder.codes(qunit)
    least = np.array([v[0] for v in ids])
    out_q, out_v, out_s = [], [], []
    for i in range(len(qid)):
        radius = coder.radius
        rows = index.within(qcodes[i], radius)
        while len(rows) <= k and radius < SUBSTRINGS * BITS:
            radius = min(SUBSTRINGS * BITS, radius + 8)
            rows = index.within(qcodes[i], radius)
        s = np.einsum("ij,j->i", unit[rows], qunit[i])
        best = np.lexsort((least[rows], -s))[: k + 1] if len(s) <= 64 else None
        if best is None:
            cut = -np.partition(-s, k)[k]
            some = np.flatnonzero(s >= cut)
            best = some[np.lexsort((least[rows[some]], -s[some]))][: k + 1]
        found = sorted((-s[b], v) for b in best for v in ids[rows[b]] if v != qid[i])[:k]
        out_q += [int(qid[i])] * len(found)
        out_v += [v for _, v in found]
        out_s += [float(-d) for d, _ in found]
    return out_q, out_v, out_s


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` rows nearest to every row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (cosine), ties to the smaller
    vec_id, for ``vectors`` (vec_id, embedding).  Vectors that are null, zero,
    empty, hold null or non-finite components, or have another length than most
    of the sample take no part, nor do rows without vec_id.  Rows equal in id and
    vector count once; a query never finds its own id.  With fewer than ``k``
    candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    src = src.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))
    # Equal vectors have equal scores, so only the k + 1 smallest ids of each can be among anyone's nearest.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = src.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = materialize(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-classes")
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow()["embedding"].to_pylist()
    sizes = [len(v) for v in sample]
    result = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], result)
    if sizes:
        dim = max(sorted(set(sizes)), key=sizes.count)
        coder = fit(np.array([v for v in sample if len(v) == dim]), k)
        queries = materialize(src.where((F.col("vec_id") % every == 0) & (F.size("embedding") == dim)).distinct(), "ann-queries")
        parts = max(1, -(-queries.count() // (QUERIES * 9 // 10)))
        for part in range(parts):
            table = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow()
            if table.num_rows:
                shared = spark.sparkContext.broadcast((coder, table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist())))
                found = found.unionByName(materialize(map_arrow(classes.where(F.size("embedding") == dim), _searcher(shared, k), result), "ann-found"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, qid, qx = shared.value
        held: list[pa.RecordBatch] = []

        def search():
            table = pa.Table.from_batches(held)
            x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, coder.dim)
            q, v, s = _search(table["ids"].to_pylist(), x, coder, qid, qx, k)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield search()
                held = []
        if sum(b.num_rows for b in held):
            yield search()

    return run
