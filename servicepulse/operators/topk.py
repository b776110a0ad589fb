"""Top-k helpers with a deterministic tie-break (key ascending).

* ``top_k`` -> ``orderBy(...).limit(k)``: planned as TakeOrderedAndProject,
  each task keeps only k rows.
* ``top_n`` -> for larger n, a form whose final merge stays bounded: a
  two-level top-n (per-partition groups with WindowGroupLimit before and after
  the shuffle) as far as the optimizer limits groups, else a cut found on a
  hash sample that leaves little more than n rows;
* ``top_k_per_group`` -> ``row_number() <= k`` over a window partitioned by
  the group; Spark plans it with WindowGroupLimit, which trims every task to
  k rows per group before the shuffle.  It is always applied to an already
  aggregated (group, key, count) table, so a partition holds the distinct
  keys of one group, never its raw rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

COUNT = "count"


def order_desc_then_key(count_col: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(count_col).desc()] + [F.col(f"`{k}`").asc_nulls_first() for k in keys]


def without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``keys`` (pandas groupby semantics).

    Only columns the schema marks nullable are tested: a filter on a
    provably non-null derived column would otherwise be rewritten by the
    optimizer into a large inferred predicate on the scan.
    """
    nullable = {f.name: f.nullable for f in df.schema.fields}
    for k in keys:
        if nullable.get(k, True):
            df = df.where(F.col(f"`{k}`").isNotNull())
    return df


def counts(df: DataFrame, keys: Sequence[str], name: str = COUNT, drop_null_keys: bool = True) -> DataFrame:
    """Row count per key combination (pandas ``value_counts``/``size``).

    Rows with a NULL key are dropped first, as pandas does by default.
    """
    if drop_null_keys:
        df = without_null_keys(df, keys)
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias(name))


def top_k(agg: DataFrame, key: str | Sequence[str], k: int, count_col: str = COUNT) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return agg.orderBy(*order_desc_then_key(count_col, keys)).limit(k)


# Up to this n a plain orderBy().limit(n) is used: every input partition
# sends at most n rows to the final merge.
DIRECT_TOP_N = 100
# Number of intermediate groups of the two-level top-n.
TOP_N_FAN_IN = 512


def top_n(df: DataFrame, order: Sequence[Column], n: int, fan_in: int = TOP_N_FAN_IN) -> DataFrame:
    """The first ``n`` rows of ``df`` in ``order`` (a total order), exactly.

    For small ``n`` this is ``orderBy().limit()``.  For larger ``n`` a plain
    top-n would funnel ``n`` rows from every input partition into one task;
    instead each input partition is assigned to one of ``fan_in`` groups,
    ``row_number() <= n`` per group runs as WindowGroupLimit before and
    after the shuffle, and only ``fan_in * n`` rows reach the final merge.
    """
    if n <= DIRECT_TOP_N:
        return df.orderBy(*order).limit(n)
    if n > _window_group_limit_threshold(df):
        raise ValueError(f"n = {n} is above the optimizer's group limit; use first_rows")
    grp = df.withColumn("__grp", F.spark_partition_id() % F.lit(fan_in))
    w = Window.partitionBy("__grp").orderBy(*order)
    cand = grp.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn", "__grp")
    return cand.orderBy(*order).limit(n)


#: One row in so many is in the hash sample of ``first_rows``.
SAMPLE_ONE_IN = 1024


def _up_to(df: DataFrame, keys: Sequence[str], cut) -> Column:
    """Rows not after ``cut`` in the order of ``keys`` ascending, NULLs first."""
    types = {f.name: f.dataType for f in df.schema.fields}
    inside = F.lit(True)
    for k in reversed(keys):
        c, v = F.col(f"`{k}`"), cut[k]
        if v is None:
            inside = c.isNull() & inside
        else:
            lit = F.lit(v if isinstance(v, (bool, int, float, str)) else str(v)).cast(types[k])
            inside = F.coalesce((c < lit) | ((c == lit) & inside), F.lit(True))
    return inside


def first_rows(df: DataFrame, keys: Sequence[str], n: int, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """The first ``n`` rows of ``df`` ordered by ``keys`` ascending, NULLs first, exactly.

    Up to the optimizer's group limit this is ``top_n``.  Beyond it the cut is
    found first: the top of a hash sample of the rows gives a row that about
    2n rows do not come after; those are written once (with a later cut if they
    are fewer than n), and the final merge sees only them.
    """
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    if n <= _window_group_limit_threshold(df):
        return top_n(df, order, n)
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    sample = df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(one_in)) == 0)
    m = -(-2 * n // one_in) + 16
    while True:
        top = sample.orderBy(*order).limit(m).collect()
        if len(top) < m:  # the whole sample: the input is of the order of n
            return df.orderBy(*order).limit(n)
        kept = materialize(df.where(_up_to(df, keys, top[-1])), "first-rows")
        if kept.count() >= n:
            return kept.orderBy(*order).limit(n)
        m *= 4


def _window_group_limit_threshold(df: DataFrame) -> int:
    """The optimizer's bound on pushed group limits; -1 (no push-down) and what is no number count as none."""
    value = df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    return int(value) if value.lstrip("-").isdigit() else 0


def top_k_per_group(agg: DataFrame, group: str | Sequence[str], key: str, k: int, count_col: str = COUNT, rank_col: str = "rank") -> DataFrame:
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(*order_desc_then_key(count_col, [key]))
    return agg.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# Largest key set broadcast for a semi-join; larger sets use a salted
# shuffle join.
BROADCAST_MAX_KEYS = 100_000
SEMI_JOIN_SALTS = 32


def semi_join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Keep rows of ``df`` whose key is in ``small``.

    ``max_rows`` is the bound of ``small`` (k of a top-k).  Up to
    ``BROADCAST_MAX_KEYS`` rows it is broadcast; beyond, or without a bound, a
    salted shuffle semi-join is used.
    """
    side = small.select(*keys).distinct()
    if max_rows is not None and max_rows <= BROADCAST_MAX_KEYS:
        return df.join(F.broadcast(side), on=list(keys), how="left_semi")
    # Salted shuffle semi-join: a hot key's rows spread over SEMI_JOIN_SALTS
    # tasks (the salt is a hash of the whole row, so retries agree).
    salted_side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SEMI_JOIN_SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SEMI_JOIN_SALTS)).cast("int")
    return df.withColumn("__salt", salt).join(salted_side, on=list(keys) + ["__salt"], how="left_semi").drop("__salt")

