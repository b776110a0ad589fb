"""Exact grouped median that stays bounded when one group is huge.

Spark's built-in ``median``/``percentile`` keeps a value->count map per group
and merges all partial maps of a group in one task: with a hot group holding
a large share of a 100 TB table that map is unbounded.  This operator gives
the same exact result (linear interpolation between the two middle values,
as pandas/DuckDB ``median``) with bounded per-task state:

1. per group: count, min, max (plain partial aggregates -- usually computed
   inside the caller's own report aggregate, see ``median_stats``);
2. while a group has more than ``finish_at`` candidate rows, build a
   ``bins``-bucket histogram over its candidate range (first round on a
   sign*log1p scale for heavy tails, then equal width)
   (``groupBy(group, bin)`` -- the hot group is spread over ``bins`` keys and
   pre-aggregated map-side), keep only the bucket(s) holding the middle
   ranks and shrink the range to their real min/max; the lowest and the
   highest value always fall in different buckets, so every round shrinks the
   range, infinite values included, until the group is done;
   When the two middle ranks fall in two different buckets they are the
   lower bucket's max and the upper bucket's min, and the group is done;
   a range of one value is done as well;
3. finish: collapse the remaining candidates to (value, count), rank them
   with a running sum inside each group (at most ``finish_at`` rows per
   group), and pick the two middle values.

If any group needs narrowing, or there are more groups than may be broadcast,
the values are collapsed to (group, value, count) and written once; all rounds
and the finish read that table, so the input is read once whatever the number
of rounds, and a value that repeats in a hot group is one row.  The state of
each round is written too (lineage cut; it survives executor loss).  Several
value columns are handled in one pass by stacking them under a measure key.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Optional, Sequence, Union

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialize
from .topk import without_null_keys

_M, _V = "__measure", "__value"
_G = "__all"

# Broadcast the per-group state only below this many groups (each state row
# is a few numbers plus the key), otherwise use a shuffle join.
BROADCAST_MAX_GROUPS = 200_000
DEFAULT_BINS = 4096
# At most this many candidate rows per group reach the final ranking window
# (one task per group; the window buffer spills beyond memory).
DEFAULT_FINISH_AT = 1_000_000


def _col(v: Union[str, Column]) -> Column:
    return F.col(f"`{v}`") if isinstance(v, str) else v


def _clean(c: Column) -> Column:
    """Double value with NaN treated as missing (as pandas does)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def stat_names(i: int) -> tuple[str, str, str]:
    return f"__med{i}_n", f"__med{i}_lo", f"__med{i}_hi"


def median_stats(values: Mapping[str, Union[str, Column]]) -> list[Column]:
    """Aggregate columns (count, min, max per measure) to add to the caller's
    own ``groupBy(...).agg(...)`` so the median needs no extra pass for them."""
    out = []
    for i, v in enumerate(values.values()):
        x = _clean(_col(v))
        n, lo, hi = stat_names(i)
        out += [F.count(x).alias(n), F.min(x).alias(lo), F.max(x).alias(hi)]
    return out


def stats_from_aggregate(agg: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long (keys, measure, n, lo, hi) table from the ``median_stats``
    columns of a per-group aggregate."""
    gkeys = list(keys) if keys else [_G]
    key_cols = [F.col(f"`{k}`") for k in keys] if keys else [F.lit(0).alias(_G)]
    entries = []
    for i, name in enumerate(names):
        n, lo, hi = stat_names(i)
        entries.append(F.struct(F.lit(name).alias(_M), F.col(n).alias("n"), F.col(lo).alias("lo"), F.col(hi).alias("hi")))
    return agg.select(*key_cols, F.explode(F.array(*entries)).alias("s")).select(*gkeys, "s.*")


def _log_scale(c: Column) -> Column:
    """sign(v) * log1p(|v|): monotone, spreads heavy-tailed values."""
    return F.signum(c) * F.log1p(F.abs(c))


def _bin(v: Column, lo: Column, hi: Column, bins: int, log_scale: bool) -> Column:
    """Bucket of ``v`` in [lo, hi]; non-decreasing in ``v`` (required for the
    rank bookkeeping).  The log scale falls back to equal width when it
    cannot separate lo and hi."""
    # Halves, so that the width of a finite range is finite.
    linear = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * bins)
    if log_scale:
        tl, th = _log_scale(lo), _log_scale(hi)
        logged = F.floor((_log_scale(v) - tl) / (th - tl) * bins)
        raw = F.when(th > tl, logged).otherwise(linear)
    else:
        raw = linear
    inner = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    finite = (F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf"))
    # The ends have the first and the last bucket; beside an infinite end the
    # rest shares one in between.
    return F.when(v == hi, F.lit(bins - 1)).when(v == lo, F.lit(0)).when(finite, inner).otherwise(F.lit(bins // 2))


# Salts per group when the state is too large to broadcast: a hot group's
# rows are then spread over this many join tasks.
JOIN_SALTS = 32


def _state_join(data: DataFrame, state: DataFrame, keys: Sequence[str], n_groups: int) -> DataFrame:
    """Attach each (group, value, count) row's group state.  Broadcast while the
    number of groups is below the bound; otherwise a salted shuffle join: every
    state row is replicated over ``JOIN_SALTS`` salts and every data row takes
    a salt from the hash of its value (deterministic, so retries agree; a
    value occurs once per group)."""
    if n_groups <= BROADCAST_MAX_GROUPS:
        return data.join(F.broadcast(state), on=list(keys), how="inner")
    salted_state = state.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    salted_data = data.withColumn("__salt", F.pmod(F.xxhash64(F.col(_V)), F.lit(JOIN_SALTS)).cast("int"))
    return salted_data.join(salted_state, on=list(keys) + ["__salt"], how="inner").drop("__salt")


def _done(finish_at: int) -> Column:
    """Whether a state's group needs no more narrowing."""
    return F.col("v1").isNotNull() | (F.col("cand") <= finish_at)


def _resolve(long: DataFrame, state: DataFrame, G: Sequence[str], n_groups: int, n_open: int, bins: int, finish_at: int) -> DataFrame:
    """Narrow the open groups of ``state`` on the values of ``long`` (G, value, w), then rank: G and the median."""
    known, done = F.col("v1").isNotNull(), _done(finish_at)
    round_no = 0
    while n_open:
        open_groups = state.where(~done)
        # First round on a log scale (heavy tails land in fewer, finer
        # buckets around the bulk), later rounds equal width.
        binned = (
            _state_join(long, open_groups.drop("v1", "v2"), G, n_groups)
            .where(F.col(_V).between(F.col("lo"), F.col("hi")))
            .withColumn("bin", _bin(F.col(_V), F.col("lo"), F.col("hi"), bins, log_scale=round_no == 0))
        )
        round_no += 1
        hist = binned.groupBy(*G, "bin", "k1", "k2", "below").agg(
            F.sum("w").alias("c"), F.min(_V).alias("bmin"), F.max(_V).alias("bmax")
        )
        w = Window.partitionBy(*G).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.col("below") + F.coalesce(F.sum("c").over(w), F.lit(0)))
        picked = hist.where((F.col("before") <= F.col("k2")) & (F.col("before") + F.col("c") > F.col("k1")))
        narrowed = picked.groupBy(*G, "k1", "k2").agg(
            F.min("bmin").alias("lo"),
            F.max("bmax").alias("hi"),
            F.min("before").alias("below"),
            F.sum("c").alias("cand"),
            F.count(F.lit(1)).alias("nbins"),
            F.min_by("bmax", "bin").alias("a_max"),
            F.max_by("bmin", "bin").alias("b_min"),
        )
        # Two bins picked: k1 is the last rank of the lower bin and k2 the
        # first rank of the upper one, so the middle values are known.
        narrowed = narrowed.select(
            *G, "k1", "k2", "lo", "hi", "below", "cand",
            F.when(F.col("nbins") == 2, F.col("a_max")).when(F.col("lo") == F.col("hi"), F.col("lo")).alias("v1"),
            F.when(F.col("nbins") == 2, F.col("b_min")).when(F.col("lo") == F.col("hi"), F.col("hi")).alias("v2"),
        )
        state = materialize(state.where(done).unionByName(narrowed), "median-state")
        n_open = state.where(~done).count()

    todo = state.where(~known).drop("v1", "v2")
    cand = _state_join(long, todo, G, n_groups).where(F.col(_V).between(F.col("lo"), F.col("hi")))
    counted = cand.groupBy(*G, _V, "k1", "k2", "below").agg(F.sum("w").alias("c"))
    w = Window.partitionBy(*G).orderBy(_V).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("end", F.col("below") + F.sum("c").over(w)).withColumn("start", F.col("end") - F.col("c"))
    lo_v = F.max(F.when((F.col("start") <= F.col("k1")) & (F.col("k1") < F.col("end")), F.col(_V)))
    hi_v = F.max(F.when((F.col("start") <= F.col("k2")) & (F.col("k2") < F.col("end")), F.col(_V)))
    finished = ranked.groupBy(*G).agg(lo_v.alias("v1"), hi_v.alias("v2"))
    both = state.where(known).select(*G, "v1", "v2").unionByName(finished)
    return both.select(*G, (F.col("v1") + (F.col("v2") - F.col("v1")) * F.lit(0.5)).alias("__median"))


def grouped_medians(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Union[str, Column]],
    *,
    stats: Optional[DataFrame] = None,
    bins: int = DEFAULT_BINS,
    finish_at: int = DEFAULT_FINISH_AT,
) -> DataFrame:
    """Exact median of each value column per group.

    Returns one row per group with at least one non-null value of some
    measure: ``keys`` + one double column per entry of ``values``.  Rows
    whose key has a NULL are ignored, as pandas ``groupby`` does.  ``stats``
    (from ``stats_from_aggregate`` over a materialized aggregate) supplies
    count/min/max per group and measure; groups absent from it get no
    median.  Without it they are computed here (one extra pass).
    """
    keys = list(keys)
    names = list(values)
    gkeys = keys if keys else [_G]
    cols = [F.col(f"`{k}`") for k in keys] if keys else [F.lit(0).alias(_G)]
    vals = [_clean(_col(v)).alias(n) for n, v in values.items()]
    wide = without_null_keys(df.select(*cols, *vals), keys)
    long = wide.unpivot(gkeys, names, _M, _V).where(F.col(_V).isNotNull())
    G = gkeys + [_M]

    if stats is None:
        stats = materialize(
            long.groupBy(*G).agg(F.count(F.lit(1)).alias("n"), F.min(_V).alias("lo"), F.max(_V).alias("hi")),
            "median-stats",
        )
    # State per (group, measure): target ranks k1 <= k2, candidate value
    # range [lo, hi] holding ``cand`` rows with ``below`` rows under it, and
    # the two middle values v1/v2 once they are known.
    state = stats.where(F.col("n") > 0).select(
        *G,
        F.floor((F.col("n") - 1) / 2).alias("k1"),
        F.ceil((F.col("n") - 1) / 2).alias("k2"),
        "lo",
        "hi",
        F.lit(0).cast("long").alias("below"),
        F.col("n").cast("long").alias("cand"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("v1"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi")).alias("v2"),
    )
    n_groups, n_open = state.agg(F.count(F.lit(1)), F.count_if(~_done(finish_at))).first()

    long = long.withColumn("w", F.lit(1).cast("long"))
    if n_open or n_groups > BROADCAST_MAX_GROUPS:
        long = materialize(long.groupBy(*G, _V).agg(F.count(F.lit(1)).alias("w")), "median-values")

    med = _resolve(long, state, G, n_groups, n_open, bins, finish_at)
    out = med.groupBy(*gkeys).agg(*[F.max(F.when(F.col(_M) == F.lit(n), F.col("__median"))).alias(n) for n in names])
    return out.drop(_G) if not keys else out


def median_of(df: DataFrame, value: Union[str, Column], name: str = "median", **kw) -> DataFrame:
    """One-row frame holding the exact median of ``value`` over all rows."""
    return grouped_medians(df, [], {name: value}, **kw)


# Rank error of the brackets' sketch: one part in so many of the rows.
BRACKET_ACCURACY = 10_000


def bracket_stats(values: Mapping[str, Union[str, Column]]) -> list[Column]:
    """Aggregate columns to add to a keyless report: per measure its count and
    two values that enclose the middle ranks (a mergeable quantile sketch,
    asked two errors below and above the middle)."""
    off = 2 / BRACKET_ACCURACY
    out = []
    for i, v in enumerate(values.values()):
        x = _clean(_col(v))
        out += [F.count(x).alias(f"__bn{i}"), F.percentile_approx(x, [0.5 - off, 0.5 + off], BRACKET_ACCURACY).alias(f"__br{i}")]
    return out


def bracketed_medians(
    df: DataFrame, values: Mapping[str, Union[str, Column]], stats, *, bins: int = DEFAULT_BINS, finish_at: int = DEFAULT_FINISH_AT
) -> dict[str, float]:
    """Exact median of each measure over all rows, None without a value.

    ``stats``: the row of ``bracket_stats`` over the same rows.  One pass keeps the values inside the
    brackets (about one row in ``BRACKET_ACCURACY / 4``, collapsed to distinct values before the shuffle)
    and counts those below and above on the way.  Ranks are checked, and that every value was counted once
    (a task that ran twice may count twice): a measure that fails is done by ``grouped_medians`` over all of its values.
    """
    spark = df.sparkSession
    size = {n: stats[f"__bn{i}"] for i, n in enumerate(values)}
    ends = {n: stats[f"__br{i}"] for i, n in enumerate(values) if size[n]}
    out: dict[str, float] = dict.fromkeys(values)
    if not ends:
        return out
    names = list(ends)
    cols = [F.col(f"x{i}") for i in range(len(names))]
    wide = df.select(*[_clean(_col(values[n])).alias(f"x{i}") for i, n in enumerate(names)])
    seen = Observation()
    below = [F.count_if(x < F.lit(ends[n][0])).alias(f"b{i}") for i, (x, n) in enumerate(zip(cols, names))]
    above = [F.count_if(x > F.lit(ends[n][1])).alias(f"a{i}") for i, (x, n) in enumerate(zip(cols, names))]
    inside = [x.between(F.lit(ends[n][0]), F.lit(ends[n][1])) for x, n in zip(cols, names)]
    kept = F.array_compact(F.array(*[F.when(i, F.struct(F.lit(n).alias(_M), x.alias(_V))) for i, x, n in zip(inside, cols, names)]))
    rows = wide.observe(seen, *below, *above).where(reduce(Column.__or__, inside)).select(F.explode(kept).alias("e")).select(F.lit(0).alias(_G), "e.*")
    long = materialize(rows.groupBy(_G, _M, _V).agg(F.count(F.lit(1)).alias("w")), "median-brackets")
    found = {r[_M]: r["cand"] for r in long.groupBy(_M).agg(F.sum("w").alias("cand")).collect()}
    state, missed = [], []
    for i, n in enumerate(names):
        lo, hi = ends[n]
        under, cand = seen.get[f"b{i}"], found.get(n, 0)
        k1, k2 = (size[n] - 1) // 2, size[n] // 2
        if under + cand + seen.get[f"a{i}"] == size[n] and under <= k1 and k2 < under + cand:
            same = lo if lo == hi else None
            state.append((0, n, k1, k2, lo, hi, under, cand, same, same))
        else:
            missed.append(n)
    if state:
        schema = f"{_G} int, {_M} string, k1 bigint, k2 bigint, lo double, hi double, below bigint, cand bigint, v1 double, v2 double"
        n_open = sum(s[8] is None and s[7] > finish_at for s in state)
        med = _resolve(long, spark.createDataFrame(state, schema), [_G, _M], len(state), n_open, bins, finish_at)
        out.update({r[_M]: r["__median"] for r in med.collect()})
    if missed:
        out.update(grouped_medians(df, [], {n: values[n] for n in missed}, bins=bins, finish_at=finish_at).first().asDict())
    return out
