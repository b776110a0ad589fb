"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servicepulse.session import materialize

U = np.uint64
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_bytes(text: Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and \\x09-\\x0D.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is exactly this rule.
    """
    return raw.lower().split()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered per task; the first LIMIT words, mostly the frequent ones, stay."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply finaliser)."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of a sequence of word hashes, in order.

    Fewer than ``k`` words: the whole sequence as one shingle; none: empty.
    """
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    x = np.full(n - width + 1, U(width), dtype=np.uint64)
    for j in range(width):
        x = mix64(x * _M1 + h[j : n - width + 1 + j])
    return x


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver found it."""
    env = df.sparkSession.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[dict[str, pa.Array], object], dict], schema: str, setup: Callable[[], object] | None = None, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` for a function from some rows' columns to a dict of output columns.

    ``setup`` runs once per task; its result is passed on to ``fn``, which gets
    at most ``rows`` rows at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for whole in batches:
            for b in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                out = fn({n: b.column(i) for i, n in enumerate(b.schema.names)}, state)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=False) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected graph of ``edges`` (a, b: long).

    Returns node, label (the smallest node of its component) for every node with
    an edge.  Each round takes the smallest label around each node and then
    follows the label of the label, so long chains close in logarithmically
    many rounds; every round is written to the shared folder.
    """
    spark = edges.sparkSession
    e = materialize(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{name}-edges")
    lab = materialize(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    while True:
        near = e.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = lab.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        # A label is the smallest node seen so far, so it has a row of its own unless the frame is empty.
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = materialize(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), f"{name}-labels")
        lab = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return lab


def broadcast_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
