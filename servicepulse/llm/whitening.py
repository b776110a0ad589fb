"""Whitening of vectors by an incremental eigendecomposition.

1. Every partition keeps the spectrum of its scatter matrix (count, mean,
   eigenvalues, eigenvectors) and takes its vectors in blocks: a block, centred
   on its own mean, is reduced to the rows of its triangular factor, which have
   the same scatter, and each row, and the step between the two means, is a centred
   rank-one update.  An update turns the eigenvalues into the roots of a
   secular equation; components that the vector does not touch, and all but one of
   those of equal eigenvalues, are deflated first.
2. Spectra are combined in a tree, ``FAN`` to a task: one takes the other's
   eigenpairs, and the step between the means, as successive rank-one updates.
3. One distributed Rayleigh-Ritz step refines the result: the covariance of the
   centred vectors, projected on the basis found, is summed over all rows and solved, which
   leaves eigenvectors of double precision whatever the roundings before.

Vectors are whole numbers: a component ``c`` counts as ``floor(SCALE * c) + SHIFT``,
so counts and sums are exact and do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import map_arrow
from servicepulse.session import materialize

SCALE, SHIFT = 1024, 100_000
#: Vectors that a task takes at a time; spectra that a task combines.
BLOCK, FAN = 2048, 16
#: Entries beyond this are no whole numbers in double precision.
_WHOLE = float(1 << 52)
#: Eigenvalues below this share of the largest count as none.
_FLAT = 1e-12
_EPS, _TINY = float(np.finfo(float).eps), float(np.finfo(float).tiny)


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for ascending, distinct ``d`` and positive ``z2``.

    Each root is given by its nearest pole (an index) and its distance from it.  Interpolation by two
    poles, kept in a bracket that shrinks in every round.
    """
    n = len(d)
    width = np.append(np.diff(d), z2.sum())
    k = np.arange(n)
    gap = d[None, :] - d[:, None]  # gap[i, j]: pole j seen from pole i

    middle = 1 + (z2 / (gap - width[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (k < n - 1)  # the root lies in the upper half of its interval
    near = k + right
    seen = gap[near]
    lo = np.where(right, -width / 2, np.where((middle < 0) & (k == n - 1), width / 2, 0.0))
    hi = np.where(right, 0.0, np.where((k == n - 1) & (middle < 0), width, width / 2))
    below, above = np.clip(k, 0, max(n - 2, 0)), np.minimum(k + 1, n - 1)
    t, open_ = (lo + hi) / 2, np.ones(n, bool)
    for _ in range(80):
        # The middle of a bracket may be a pole only where the bracket has closed on it.
        delta = seen - t[:, None]
        delta[delta == 0] = _TINY
        part = z2 / delta
        slope = part / delta
        f = 1 + part.sum(axis=1)
        lo, hi = np.where(f < 0, t, lo), np.where(f >= 0, t, hi)
        open_ &= (np.abs(f) > 8 * n * _EPS * (1 + np.abs(part).sum(axis=1))) & (hi - lo > 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not open_.any():
            break
        a, b = delta[k, below], delta[k, above]
        left = np.where(k[None, :] <= below[:, None], slope, 0).sum(axis=1)
        rest = slope.sum(axis=1) - left
        c = f - a * left - b * rest
        p = (a + b) * f - a * b * (left + rest)
        q = a * b * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            # The last root lies beyond both of its poles: the other solution.
            c[-1] = abs(c[-1])
            step[-1] = (p[-1] + root[-1]) / (2 * c[-1]) if p[-1] >= 0 else 2 * q[-1] / (p[-1] - root[-1])
        open_ &= ~(np.abs(step) <= 2 * _EPS * np.abs(t))
        to = t + step
        to = np.where((to > lo) & (to < hi), to, (lo + hi) / 2)
        t = np.where(open_, to, t)
    return near, t


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of ``q diag(lam) q' + v v'``."""
    z = q.T @ v
    norm = float(np.sqrt(z @ z))
    if not norm:
        return lam, q
    tol = 8 * _EPS * max(float(np.abs(lam).max()), norm * norm)
    lam, q = lam.copy(), q.copy()
    # Deflation: what the vector does not touch stays; equal eigenvalues are turned until it touches one of them.
    touched = np.abs(z) * norm > tol
    z = np.where(touched, z, 0.0)
    last = -1
    for i in np.flatnonzero(touched):
        if last >= 0 and abs(z[last] * z[i] * (lam[i] - lam[last])) <= tol * (z[i] ** 2 + z[last] ** 2):
            r = float(np.hypot(z[last], z[i]))
            c, s = z[i] / r, z[last] / r
            a, b = q[:, last].copy(), q[:, i].copy()
            q[:, last], q[:, i] = c * a - s * b, s * a + c * b
            la, lb = lam[last], lam[i]
            lam[last], lam[i] = c * c * la + s * s * lb, s * s * la + c * c * lb
            z[last], z[i] = 0.0, r
        last = i
    live = np.flatnonzero(z != 0)
    d = lam[live]
    order = np.argsort(d, kind="stable")
    live, d = live[order], d[order]
    z2 = z[live] ** 2
    near, t = _roots(d, z2)
    # d_i - x_j without cancellation, and the vector that has these roots exactly: so the new basis is orthogonal.
    away = (d[:, None] - d[near][None, :]) - t[None, :]
    away[away == 0] = _TINY
    n = len(d)
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, 1.0)
    ratio = away / np.where(poles == 0, 1.0, poles)
    ratio[np.arange(n), np.arange(n)] = away[np.arange(n), np.arange(n)]
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[live])
    u = exact[:, None] / away
    u /= np.sqrt((u * u).sum(axis=0))
    lam[live] = d[near] + t
    q[:, live] = q[:, live] @ u
    order = np.argsort(lam, kind="stable")
    return lam[order], q[:, order]


class Spectrum:
    """Count, exact sums, mean, eigenvalues and eigenvectors of the scatter of some vectors."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, np.zeros(dims, np.int64)
        self.mean, self.lam, self.q = np.zeros(dims), np.zeros(dims), np.eye(dims)

    def _step(self, n: int, mean: np.ndarray) -> None:
        """``n`` more vectors round ``mean``: the step between the means, as one update."""
        if self.n:
            gap = mean - self.mean
            self.lam, self.q = rank_one(self.lam, self.q, gap * np.sqrt(self.n * n / (self.n + n)))
            self.mean = self.mean + gap * (n / (self.n + n))
        else:
            self.mean = mean
        self.n += n

    def add(self, x: np.ndarray) -> None:
        """Take a block of whole-numbered vectors."""
        self.sums += x.sum(axis=0)
        mean = x.mean(axis=0, dtype=np.float64)
        y = x - mean
        for v in np.linalg.qr(y, mode="r") if len(y) > y.shape[1] else y:
            self.lam, self.q = rank_one(self.lam, self.q, v)
        self._step(len(x), mean)

    def combine(self, other: "Spectrum") -> None:
        """Take another spectrum's eigenpairs."""
        if not self.n:
            self.lam, self.q, self.mean, self.n = other.lam, other.q, other.mean, other.n
        elif other.n:
            for value, vector in zip(other.lam, other.q.T):
                if value > 0:
                    self.lam, self.q = rank_one(self.lam, self.q, vector * np.sqrt(value))
            self._step(other.n, other.mean)
        self.sums += other.sums

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": self.sums, "mean": self.mean, "lam": self.lam, "q": self.q.ravel()}

    @classmethod
    def of(cls, n, sums, mean, lam, q) -> "Spectrum":
        out = cls(len(sums))
        out.n, out.sums, out.mean, out.lam = int(n), np.array(sums, np.int64), np.array(mean, float), np.array(lam, float)
        out.q = np.array(q, float).reshape(len(sums), -1)
        return out


_SPECTRUM = "part long, n long, sums array<long>, mean array<double>, lam array<double>, q array<double>"
_SPECTRUM_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("lam", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))])


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in rows], f.type) for f in _SPECTRUM_ARROW}, schema=_SPECTRUM_ARROW)


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array of long) of the rows that take part."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) * SCALE > _WHOLE))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), c.alias("c")).where(F.col("c").isNotNull() & ~bad & (F.size("c") > 0))
    return rows.select("id", F.transform("c", lambda v: (F.floor(v * SCALE) + SHIFT).cast("long")).alias("x"))


def spectrum(rows: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all vectors of ``rows`` (x): updates within partitions, then a tree of combinations."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dims)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                own.add(_vectors(b.slice(i, BLOCK), dims))
        if own.n:
            yield _emit([own.row(0)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Spectrum(dims)
        for b in batches:
            for r in b.to_pylist():
                whole.combine(Spectrum.of(r["n"], r["sums"], r["mean"], r["lam"], r["q"]))
        if whole.n:
            yield _emit([whole.row(0)])

    parts = materialize(map_arrow(rows.select("x"), fold, _SPECTRUM).withColumn("part", F.spark_partition_id().cast("long")), "whitening-spectra")
    while (left := parts.count()) > 1:
        # FAN spectra to a task, by their rank among the parts that are left.
        groups = -(-left // FAN)
        dealt = parts.repartition(groups, F.pmod("part", F.lit(groups))) if groups > 1 else parts.coalesce(1)
        parts = materialize(map_arrow(dealt, join, _SPECTRUM).withColumn("part", F.spark_partition_id().cast("long")), "whitening-spectra")
    r = parts.first()
    return Spectrum(dims) if r is None else Spectrum.of(r["n"], r["sums"], r["mean"], r["lam"], r["q"])


def _moments(rows: DataFrame, fn, size: int) -> np.ndarray:
    """Sum over all rows of y y' for ``fn``'s rows y; symmetric, ``size`` x ``size``, summed by Spark."""
    pairs = np.triu_indices(size)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = fn(b)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs[0]))), pa.array(total[pairs])], names=["k", "v"])

    got = map_arrow(rows, part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(pairs[0]))
    flat[got["k"].to_numpy()] = got["v"].to_numpy()
    out = np.zeros((size, size))
    out[pairs] = flat
    return out + np.triu(out, 1).T


def refine(rows: DataFrame, found: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance: one Rayleigh-Ritz step over all rows."""
    dims, q = len(found.mean), found.q
    whole, rest = np.divmod(found.sums, found.n)  # the mean in two parts, so that centring is exact to rounding

    def projected(b: pa.RecordBatch) -> np.ndarray:
        return ((_vectors(b, dims) - whole) - rest / found.n) @ q

    values, turn = np.linalg.eigh(_moments(rows.select("x"), projected, dims) / found.n)
    values, basis = values[::-1], (q @ turn)[:, ::-1]
    basis = basis / np.sqrt((basis * basis).sum(axis=0))
    # One sign for all: the entry of largest size is positive.
    return np.maximum(values, 0), basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)


def _squares(x: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum of (n x - rest)^2 per row, exact; None where it is no long.

    64-bit arithmetic wraps round, so it is right wherever the true sum fits; doubles tell where it does.
    """
    about = ((x * float(n) - rest) ** 2).sum(axis=1)
    out = ((x * n - rest) ** 2).sum(axis=1).tolist()
    for i in np.flatnonzero(about > 2.0**62).tolist():
        true = sum((n * int(e) - int(r)) ** 2 for e, r in zip(x[i], rest))
        out[i] = true if true < 1 << 63 else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """Whitened coordinates of every row of ``vectors`` for the first ``components`` principal components.

    Rows whose vector is null or empty, or holds null or non-finite entries (or entries beyond 2^42,
    which are no whole numbers at this scale), take no part; nor do vectors of
    another length than most (of equally frequent lengths the longest is kept).  Repeated rows count each time.
    An empty table gives no row.

    Returns for each row that takes part and each component: ``id_col``, component (from 1, by falling eigenvalue), n (rows that take part),
    deviation (sum over dimensions of (n x - S)^2, exact; null where it is no long), whitened (null for a component without variance),
    explained (share of the trace; null if the trace is 0) and identity_error: the largest absolute entry of
    the covariance of ``whitened`` minus the identity, over the components that have variance (null if none has).
    Other columns of ``vectors`` are ignored.
    """
    spark = vectors.sparkSession
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, n = int(lengths["dims"]), int(lengths["n"])
    rows = rows.where(F.size("x") == dims)
    found = spectrum(rows, dims)
    values, basis = refine(rows, found)
    k = min(components, dims)
    real = int((values[:k] > _FLAT * values[0]).sum()) if values[0] > 0 else 0
    whole, rest = np.divmod(found.sums, n)
    axes = basis[:, :real] / np.sqrt(values[:real])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, dims) - whole  # n x - S = n * x - rest, exact
            y = np.concatenate([(x - rest / n) @ axes, np.full((len(x), k - real), np.nan)], axis=1)
            off = _squares(x, rest, n)
            w = pa.array(y.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(off, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), w)], names=["id", "deviation", "w"])

    table = materialize(map_arrow(rows, project, "id long, deviation long, w array<double>"), "whitening-rows")
    error = None
    if real:

        def kept(b: pa.RecordBatch) -> np.ndarray:
            return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, real)

        error = float(np.abs(_moments(table.select(F.slice("w", 1, real).alias("w")), kept, real) / n - np.eye(real)).max())
    trace = float(values.sum())
    shares = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values[:k]))
    out = table.select(F.col("id"), "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
