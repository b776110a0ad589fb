"""CSV tables: files of different headers, types from one read, reuse by arguments.

* **Headers.** The first line of every file is read on its own (a few bytes per
  file, by the session's Hadoop FileSystem); files of one header are one scan, the
  scans are united by column name.  A column that a file lacks is NULL there.
* **Types.** The rows are read once, as text, and written as Parquet to the shared checkpoint folder.  One
  aggregate over the written table finds, per column, which kinds of values occur.  The narrowest type that holds every value is applied when the
  written table is read.  So a text value that turns up late in a column of numbers is
  kept: the column is text then, and the report says how many of its values were not.
* **Reuse.** The written table is named by a digest of the files (path, size,
  time of change) and options.  A second load with the same arguments finds it and reads no
  input; a file that has changed makes another digest.
"""

from __future__ import annotations

import csv
import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Mapping, Sequence, Union

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Kinds of text values, one bit each.
INT, LONG, DOUBLE, BOOL, DATE, TEXT, WIDE = (1 << i for i in range(7))
# Narrowest first: the type, and the kinds that it holds.
_LATTICE = (
    ("int", INT), ("bigint", INT | LONG), ("decimal(38,0)", INT | LONG | WIDE), ("double", INT | LONG | WIDE | DOUBLE),
    ("boolean", BOOL), ("date", DATE),
)
_THREADS = 32
REUSE_SUBDIR = "reuse"


@dataclass(frozen=True)
class CsvTable:
    """A loaded table: its rows, the type of each column, how many values it
    has and how many of them are no plain text, and the files of each header."""

    rows: DataFrame
    types: Mapping[str, str]
    filled: Mapping[str, int]
    typed: Mapping[str, int]
    headers: Mapping[tuple[str, ...], Sequence[str]]

    def conflicts(self) -> dict[str, int]:
        """Text columns in which some values are numbers, dates or flags: how many are."""
        return {c: self.typed[c] for c, t in self.types.items() if t == "string" and 0 < self.typed[c] < self.filled[c]}

    def report(self) -> DataFrame:
        """column_name, type, filled, typed, conflict: one row per column."""
        odd = self.conflicts()
        rows = [(c, t, self.filled[c], self.typed[c], c in odd) for c, t in self.types.items()]
        return self.rows.sparkSession.createDataFrame(rows, "column_name string, type string, filled bigint, typed bigint, conflict boolean")


def kind_of(v: Column) -> Column:
    """The kind of a text value (NULL has none).

    Cheap tests of bytes (first character, a colon, the length) come before the patterns, so that most values meet one pattern or none.
    """
    number = v.rlike(r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+$")
    broken = v.contains(".") | v.contains("e") | v.contains("E")
    # Up to two characters of a line end may follow where a pattern ends.
    day = F.length(v).between(10, 12) & v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull()
    # A whole number that no whole type holds is a double.
    digits = F.when(v.try_cast("int").isNotNull(), INT).when(v.try_cast("bigint").isNotNull(), LONG).when(v.try_cast("decimal(38,0)").isNotNull(), WIDE).otherwise(DOUBLE)
    numeric = (
        F.when(v.contains(":"), TEXT)
        .when(number, F.when(broken, DOUBLE).otherwise(digits))
        .when(day, DATE).when(v.isin("-Inf", "-Infinity"), DOUBLE).otherwise(TEXT)
    )
    # From "+" to "9": signs, the point and the digits are among these first characters.
    return (
        F.when(v.isNull(), F.lit(None).cast("int"))
        .when((v >= "+") & (v < ":"), numeric)
        .when(v.isin("NaN", "Inf", "Infinity"), DOUBLE)
        .when(F.octet_length(v).between(4, 5) & F.lower(v).isin("true", "false"), BOOL)
        .otherwise(TEXT)
    )


def type_of(kinds: int) -> str:
    """The narrowest type that holds all of some kinds; text for none."""
    return next((t for t, holds in _LATTICE if kinds and not kinds & ~holds), "string")


def _names(header: Sequence[str]) -> list[str]:
    """Column names of a header: empty ones and repeats (whatever their case) get their position."""
    lower = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if lower.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def _header(spark: SparkSession, path: str, options: Mapping[str, str]) -> list[str] | None:
    """The names in the first line of a file that is not blank; None for a file without one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        charset = options.get("encoding", options.get("charset", "UTF-8"))
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, charset))
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
        quote = options.get("quote", '"')
        while line is not None and quote and options.get("multiLine", "false") == "true" and line.count(quote) % 2:
            more = reader.readLine()
            if more is None:
                break
            line += "\n" + more
    finally:
        stream.close()
    if line is None:
        return None
    dialect = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    return _names(next(csv.reader([line.lstrip("\ufeff")], delimiter=options.get("sep", options.get("delimiter", ",")), **dialect)))


def _listing(spark: SparkSession, path: Union[str, Sequence[str]], glob: str | None) -> list[tuple[str, int, str]]:
    """(path, size, time of change) of the files, by Spark's own (distributed) listing; contents are not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path).select("path", "length", F.col("modificationTime").cast("string").alias("changed"))
    return sorted(tuple(r) for r in rows.collect())


def _as_text(spark: SparkSession, headers: Mapping[tuple[str, ...], Sequence[str]], options: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """All rows as text under names c0, c1, ..., and the columns' true names: spelt as first met, in that order."""
    at: dict[str, int] = {}
    spelt: list[str] = []
    for names in headers:
        for n in names:
            if n.lower() not in at:
                at[n.lower()] = len(spelt)
                spelt.append(n)
    whole = None
    for names, paths in headers.items():
        part = spark.read.options(**{"mode": "PERMISSIVE", **options, "header": "true"}).schema(", ".join(f"c{at[n.lower()]} string" for n in names)).csv(list(paths))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole.select(*(f"c{i}" for i in range(len(spelt)))), spelt


def load_csv(spark: SparkSession, path: Union[str, Sequence[str]], glob: str | None = None, reuse: bool = True, **options: str) -> CsvTable:
    """Load CSV files (a file, a folder, or a list of either; ``glob`` filters file names) with header lines.

    Every file is read by its own header; ``options`` are those of Spark's CSV reader.  Blank fields are NULL.
    Types are int, bigint, decimal(38,0), double, boolean, date or string, the first that holds every value of the column;
    a column without values is a string.  Files without a line are left out; a ``ValueError`` says if no file has one.
    ``reuse=False`` reads the files again even if a written table of the same files and options exists.
    """
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    files = _listing(spark, path, glob)
    digest = hashlib.sha256(json.dumps([files, sorted(options.items())]).encode()).hexdigest()[:32]
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{REUSE_SUBDIR}/csv-{digest}"
    note = _read_note(spark, folder) if reuse else None
    if note is None:
        note = _write(spark, folder, [f[0] for f in files], options)
    spelt, types = note["columns"], note["types"]
    stored = spark.read.schema(", ".join(f"c{i} string" for i in range(len(spelt)))).parquet(f"{folder}/rows")
    rows = stored.select(*(F.col(f"c{i}").cast(t).alias(n) for i, (n, t) in enumerate(zip(spelt, types))))
    named = lambda values: dict(zip(spelt, values))
    return CsvTable(rows, named(types), named(note["filled"]), named(note["typed"]), {tuple(h): p for h, p in note["headers"]})


def _write(spark: SparkSession, folder: str, paths: Sequence[str], options: Mapping[str, str]) -> dict:
    """Read the files once: rows to ``folder``, and what was learnt about them beside it."""
    with ThreadPoolExecutor(_THREADS) as pool:
        found = list(pool.map(lambda p: _header(spark, p, options), paths))
    headers: dict[tuple[str, ...], list[str]] = {}
    for p, h in zip(paths, found):
        if h:
            headers.setdefault(tuple(h), []).append(p)
    if not headers:
        raise ValueError(f"no CSV file with a header line in {paths[:3]}")
    text, spelt = _as_text(spark, headers, options)
    text.write.mode("overwrite").parquet(f"{folder}/rows")
    # One row per column; none without rows.
    found = {r["column"]: (r["kinds"] or 0, r["filled"], r["typed"]) for r in _kinds(spark.read.schema(text.schema).parquet(f"{folder}/rows")).collect()}
    got = [found.get(i, (0, 0, 0)) for i in range(len(spelt))]
    note = {
        "columns": spelt,
        "types": [type_of(k) for k, _, _ in got],
        "filled": [n for _, n, _ in got],
        "typed": [t for _, _, t in got],
        "headers": [[list(h), p] for h, p in headers.items()],
    }
    # Written last: a folder without it is not reused.
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/note")
    return note


def _kinds(text: DataFrame) -> DataFrame:
    """column (its place), kinds (which occur), filled (how many values), typed (how many of them are no plain text).

    The values of a row are taken one after the other by the same code: written out for every column, the generated
    method soon is too long for the JVM to compile.
    """
    kinds = text.select(F.posexplode(F.array(*text.columns)).alias("column", "value")).select("column", kind_of(F.col("value")).alias("kind"))
    return kinds.groupBy("column").agg(F.bit_or("kind").alias("kinds"), F.count("kind").alias("filled"), F.count_if(F.col("kind") != TEXT).alias("typed"))


def _read_note(spark: SparkSession, folder: str) -> dict | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/note/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.option("wholetext", "true").text(f"{folder}/note/part-*").first()[0])
