"""Feature-collection JSON read in parallel, however few files it comes in.

A document is one JSON value, often gigabytes on one line or pretty-printed over millions, so
Spark's JSON reader gives each file to one task.  Here files are cut into byte ranges by the text source (its
record separator is ``}``, so records are small and no task needs a whole file), and two
passes find the elements of the top-level ``features`` arrays:

1. per range: by how much it changes the nesting depth and whether it flips between inside and
   outside of a string, for either state at its start.  Running sums over the ranges of a file then
   give the true state at every start (one row per range).
2. per range, from its true start: every element that lies in it, as text, and the pieces of the elements that
   cross its borders, which are put together by Spark.

The elements are written as JSON lines, which any number of tasks can read.
Pages of documents (many files, or one document per line) go the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_arrow, materialize, scratch_path

_ESCAPED = re.compile(rb"\\.", re.S)
_QUOTE = 2
# What a byte may be: a bracket that opens (1) or closes (-1), or a quote.
_MARK = np.zeros(256, np.int8)
_MARK[[ord("{"), ord("[")]], _MARK[[ord("}"), ord("]")]], _MARK[ord('"')] = 1, -1, _QUOTE
_BLANKS = bytes.maketrans(b"\r\n", b"  ")
_KEY = b'"features"'
# Depths: 1 in the document, 2 in one of its arrays, 3 in an element.
_IN_ARRAY, _IN_ELEMENT = 2, 3


def _marks(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the brackets and the quotes that delimit strings, in order (strings not told apart): where they
    stand, by how much they change the depth, and how many quotes there are up to each."""
    if b"\\" in buf:
        buf = _ESCAPED.sub(b"  ", buf)
    mark = _MARK[np.frombuffer(buf, np.uint8)]
    at = np.flatnonzero(mark)
    mark = mark[at]
    quote = mark == _QUOTE
    return at, np.where(quote, 0, mark), np.cumsum(quote)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict, bytes]]:
    """(file, start), the batch's first row there, and the text: runs of rows of one range, in order.

    The separator that ended each record is put back.
    """
    for b in batches:
        if not b.num_rows:
            continue
        files, starts, raw = b.column("file").to_numpy(), b.column("start").to_numpy(), b.column("raw")
        cuts = (np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(files)]):
            first = {n: b.column(n)[lo].as_py() for n in b.schema.names if n not in ("raw", "file", "start")}
            run = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), raw.slice(lo, hi - lo))
            yield (int(files[lo]), int(starts[lo])), first, pc.binary_join(run, b"}")[0].as_py() + b"}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, flips (0 or 1), change of depth if the range starts outside and if it starts inside of a string."""
    seen: dict[tuple[int, int], list[int]] = {}
    for at, _, buf in _ranges(batches):
        _, step, quotes = _marks(buf)
        odd = quotes & 1 == 1
        plain, quoted = int(step[~odd].sum(dtype=np.int64)), int(step[odd].sum(dtype=np.int64))
        row = seen.setdefault(at, [0, 0, 0])
        if row[0]:
            plain, quoted = quoted, plain
        row[0] ^= int(quotes[-1]) & 1 if len(quotes) else 0
        row[1] += plain
        row[2] += quoted
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3))],
        names=["file", "start", "flips", "plain", "quoted"])


class _Cutter:
    """Elements of one range, from the state at its start."""

    def __init__(self, inside: int, depth: int):
        self.inside, self.depth, self.started = inside, depth, depth < _IN_ELEMENT
        self.wanted: bool | None = None if depth >= _IN_ARRAY else False
        self.known, self.piece = False, []
        self.out: list[tuple[str, bool | None, bytes]] = []

    def _cut(self, buf: bytes, lo: int, hi: int) -> None:
        """Text of an element up to its end: the end of one that began before the range, or a whole one."""
        self.piece.append(buf[lo:hi])
        self.out.append(("element" if self.started else "head", self.wanted, b"".join(self.piece)))
        self.piece, self.started = [], True

    def take(self, buf: bytes) -> None:
        at, step, quotes = _marks(buf)
        bracket = (step != 0) & ((quotes + self.inside) & 1 == 0)
        self.inside = (self.inside + int(quotes[-1])) & 1 if len(quotes) else self.inside
        at, step = at[bracket], step[bracket]
        up = step > 0
        after = self.depth + np.cumsum(step, dtype=np.int64)
        # Only borders of elements and of the document's arrays matter.
        border = np.flatnonzero(np.where(up, (after == _IN_ELEMENT) | (after == _IN_ARRAY), (after == _IN_ARRAY) | (after == _IN_ARRAY - 1)))
        lo = 0 if self.depth >= _IN_ELEMENT else None
        for k in border.tolist():
            pos, opening, depth = int(at[k]), bool(up[k]), int(after[k])
            if opening and depth == _IN_ELEMENT:
                lo = pos
            elif not opening and depth == _IN_ARRAY:
                self._cut(buf, lo or 0, pos + 1)
                lo = None
            elif opening:
                before = buf[max(buf.rfind(b"}", 0, pos), 0) : pos].rstrip()
                self.wanted = buf[pos : pos + 1] == b"[" and before.endswith(b":") and before[:-1].rstrip().endswith(_KEY)
                self.known = True
            else:
                self.wanted, self.known = False, True
        if lo is not None:
            self.piece.append(buf[lo:])
        if len(after):
            self.depth = int(after[-1])

    def finish(self) -> list[tuple[str, bool | None, bytes]]:
        if self.piece:
            self.out.append(("tail" if self.started else "middle", self.wanted, b"".join(self.piece)))
        return self.out + [("state", self.wanted if self.known else None, b"")]


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, kind, wanted (in a features array; null: as at the start of the range), raw."""

    def rows(at, found):
        # Strings hold no line breaks, so blanks may stand for them.
        found = [(k, w, raw.translate(_BLANKS) if b"\n" in raw or b"\r" in raw else raw) for k, w, raw in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * len(found), pa.int64()), pa.array([at[1]] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.binary())],
            names=["file", "start", "kind", "wanted", "raw"])

    at, cutter = None, None
    for here, state, buf in _ranges(batches):
        if here != at:
            if cutter:
                yield rows(at, cutter.finish())
            at, cutter = here, _Cutter(state["inside"], state["depth"])
        cutter.take(buf)
        yield rows(at, cutter.out)
        cutter.out = []
    if cutter:
        yield rows(at, cutter.finish())


def feature_texts(spark: SparkSession, path) -> DataFrame:
    """value: the text of every object in a top-level ``features`` array of the documents, on one line each.

    Elements that are no objects (null, numbers) are left out.  A document whose brackets do not match gives what its
    brackets say.  UTF-8 only.
    """
    # Files go by numbers: a path beside every short record would be longer than the record.
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    numbers = F.broadcast(materialize(listed.withColumn("file", F.monotonically_increasing_id()), "feature-files"))
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    text = text.select("path", "start", F.col("value").cast("binary").alias("raw"))
    numbered = text.join(numbers, "path").select("file", "start", "raw")
    effects = materialize(map_arrow(numbered, _effects, "file long, start long, flips long, plain long, quoted long"), "feature-ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = effects.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    state = state.withColumn("step", F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted")))
    state = state.select("file", "start", "inside", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"))
    # One row per byte range (128 MB by default), so the side that is broadcast is a millionth of the input.
    states = materialize(state.join(numbers, "file"), "feature-states")
    ranged = text.join(F.broadcast(states), ["path", "start"])
    found = materialize(map_arrow(ranged.select("file", "start", "inside", "depth", "raw"), _elements, "file long, start long, kind string, wanted boolean, raw binary"), "feature-pieces", compression="zstd")
    flags = found.where("kind = 'state'").withColumn("given", F.last("wanted", ignorenulls=True).over(before)).select("file", "start", "given")
    given = found.where("kind <> 'state'").join(F.broadcast(flags), ["file", "start"]).withColumn("wanted", F.coalesce("wanted", "given", F.lit(False)))
    # A piece without an end goes with those that follow, up to the one that ends the element.
    order = F.when(F.col("kind") == "tail", 1).otherwise(0)
    number = F.sum(order).over(Window.partitionBy("file").orderBy("start", order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = given.where("kind <> 'element'").withColumn("order", order).withColumn("number", number)
    whole = pieces.groupBy("file", "number").agg(F.bool_or((F.col("kind") == "tail") & F.col("wanted")).alias("wanted"), F.sort_array(F.collect_list(F.struct("start", "order", "raw"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["raw"]))
    out = given.where("kind = 'element' and wanted").select("raw").unionByName(whole.where("wanted").select(joined.alias("raw")))
    return out.select(F.col("raw").cast("string").alias("value"))


def read_split_features(spark: SparkSession, path, element: T.StructType | None = None) -> DataFrame:
    """The elements of the documents' ``features`` arrays as rows (attributes, geometry, ...)."""
    folder = scratch_path(spark, "features")
    # Compressed, so in files small enough for a task each.
    feature_texts(spark, path).write.option("maxRecordsPerFile", 500_000).option("compression", "gzip").text(folder)
    reader = spark.read if element is None else spark.read.schema(element)
    return reader.json(folder)
