"""Most frequent values of several columns without counting every value.

Spark's mergeable frequent-items sketch (a fixed number of counters per column) is kept in one
pass over the rows: per task, then per group of tasks, then for all.  Three outcomes per column:

* the sketch tracked every value: its counts are exact, and the pass is all that is needed.  (A
  sketch that had to drop counters gives estimates that cannot add up to the number of values.)
* else the values it returns are candidates, and a second pass counts these only.  They are proven if the k-th
  of their exact counts is above what any other value can reach, by the sketch's error bound;
* else (an id-like column, whose values are all about as frequent) the column's values are counted in full.

No value is estimated in the result, and ties are broken by the value.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from . import topk as TK

# Counters per column, and values read from a sketch: its counters are decremented by a sample
# median of at least 2 * RETURNED counters, so RETURNED estimates add up to less than all once any was dropped.
TRACKED, RETURNED = 1024, 256
# Tasks' sketches are combined in this many groups before they meet.
GROUPS = 64
# The sketch's error is at most this many times the number of values over TRACKED.
_ERROR = 3.5


def _sketch(df: DataFrame, cols: Sequence[str]):
    """One row: per column i, s{i} (array of item, count) and n{i} (values that are not null); None without rows."""
    turn = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("turn")
    named = df.select(*[C.qcol(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)], turn)
    some = named.groupBy("turn").agg(*[F.expr(f"approx_top_k_accumulate(v{i}, {TRACKED})").alias(f"s{i}") for i in range(len(cols))], *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))])
    every = some.groupBy(F.lit(0).alias("all")).agg(*[F.expr(f"approx_top_k_combine(s{i}, {TRACKED})").alias(f"s{i}") for i in range(len(cols))], *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(cols))])
    return every.select(*[F.expr(f"approx_top_k_estimate(s{i}, {RETURNED})").alias(f"s{i}") for i in range(len(cols))], *[f"n{i}" for i in range(len(cols))]).first()


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """column_name, value, count, rank: the ``k`` most frequent values of each string column, ties by value; nulls do not count."""
    spark = df.sparkSession
    if k > RETURNED:
        return _counted(df, cols, k)
    row = _sketch(df, cols)
    known: list[tuple[str, str, int]] = []
    candidates: dict[str, list] = {}
    for i, c in enumerate(cols if row else []):
        # A null may be tracked as an item; it is not counted in n.
        items = [(r["item"], r["count"]) for r in row[f"s{i}"] or [] if r["item"] is not None]
        if sum(n for _, n in items) == (row[f"n{i}"] or 0):
            known += [(c, v, n) for v, n in items]
        else:
            candidates[c] = items
    full = []
    if candidates:
        named = spark.createDataFrame([(c, v) for c, items in candidates.items() for v, _ in items], "column_name string, value string")
        stacked = df.select(*[C.qcol(c).cast("string").alias(c) for c in candidates]).unpivot([], list(candidates), "column_name", "value")
        # At most RETURNED values per column.
        exact = stacked.join(F.broadcast(named), ["column_name", "value"]).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")).collect()
        for c, items in candidates.items():
            own = [(r["column_name"], r["value"], r["count"]) for r in exact if r["column_name"] == c]
            n = row[f"n{cols.index(c)}"]
            # What is not among the candidates: at most two errors if all items above one error are, else as much as the least of them too.
            bound = math.ceil(2 * _ERROR * n / TRACKED) + (min(e for _, e in items) if len(items) >= RETURNED - 1 else 0)
            counts = sorted((x[2] for x in own), reverse=True)
            if sum(counts) == n or len(counts) >= k and counts[k - 1] > bound:
                known += own
            else:
                full.append(c)
    best = [x for c in cols for x in _ranked([y for y in known if y[0] == c], k)]
    out = spark.createDataFrame(best, "column_name string, value string, count bigint, rank int")
    return out.unionByName(_counted(df, full, k)) if full else out


def _ranked(values: list[tuple[str, str, int]], k: int) -> list[tuple[str, str, int, int]]:
    order = sorted(values, key=lambda x: (-x[2], x[1].encode()))[:k]
    return [(*x, i) for i, x in enumerate(order, 1)]


def _counted(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The same by counting every value."""
    stacked = df.select(*[C.qcol(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")
    pairs = materialize(TK.counts(stacked, ["column_name", "value"]), "value-counts")
    return TK.top_k_per_group(pairs, "column_name", "value", k).select("column_name", "value", "count", "rank")
