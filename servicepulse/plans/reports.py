"""Tables behind the charts: distributions, crosstabs, grids, map points.

Crosstabs are conditional counts or a ``pivot`` on the four fixed priority
labels (no distinct-values job), zero-filled and unpivoted back to long
form; the complete grid is built by exploding the fixed labels onto the
top-k keys (no cross join).  The map sample is an exact top-n over a
seeded hash after a hash-cutoff prefilter.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import aggs as A
from ..functions import columns as C
from ..operators import topk as TK
from ..operators.median import median_stats
from ..session import materialize
from .common import attach_medians, order_by_priority, ratio, require_columns, resolved, type_col

_PRIOS = list(K.PRIORITY_ORDER)


def priority_distribution(df: DataFrame) -> DataFrame:
    require_columns(df, K.PRIORITY_COL)
    out = TK.counts(df, [K.PRIORITY_COL], name="Count").withColumnRenamed(K.PRIORITY_COL, "Priority")
    return out.orderBy(C.priority_rank(F.col("Priority")))


def method_distribution(df: DataFrame) -> DataFrame:
    require_columns(df, K.METHOD_COL)
    out = TK.counts(df, [K.METHOD_COL], name="Count").withColumnRenamed(K.METHOD_COL, "Method")
    return out.orderBy(F.col("Count").desc(), F.col("Method"))


def _crosstab_long(agg_wide: DataFrame, ids: list[str], value_name: str) -> DataFrame:
    return agg_wide.unpivot(ids, _PRIOS, "Priority", value_name)


def priority_by_type(df: DataFrame, k: int = K.CROSSTAB_TYPES) -> DataFrame:
    """Counts of the top-k types x priority, zeros included, long form.

    Like a crosstab, a priority column exists only if some row of the top-k
    types has it; all-zero priority columns are dropped again.
    """
    require_columns(df, K.PRIORITY_COL)
    t = type_col(df)
    pairs = materialize(TK.counts(df, [t, K.PRIORITY_COL]), "pairs")  # one pass, read twice
    top = TK.top_k(pairs.groupBy(t).agg(F.sum("count").alias("count")), t, k)
    kept = TK.semi_join_small(pairs, top, [t], max_rows=k)
    wide = kept.groupBy(t).pivot(K.PRIORITY_COL, _PRIOS).agg(F.sum("count")).na.fill(0, _PRIOS)
    long = _crosstab_long(wide, [t], "Count").withColumn("Count", F.col("Count").cast("long"))
    present = F.sum("Count").over(Window.partitionBy("Priority"))
    return long.withColumn("__present", present).where(F.col("__present") > 0).drop("__present")


def performance_by_method(df: DataFrame, min_count: int = K.MIN_METHOD_COUNT) -> DataFrame:
    """Mean/median ratio and non-null ratio count per method; methods with
    more than ``min_count`` ratios only; by count desc."""
    require_columns(df, K.METHOD_COL, K.RATIO_COL)
    meds = {"median_performance_ratio": ratio()}
    agg = TK.without_null_keys(df, [K.METHOD_COL]).groupBy(K.METHOD_COL).agg(
        F.avg(K.RATIO_COL).alias("mean_performance_ratio"), F.count(K.RATIO_COL).alias("Count"), *median_stats(meds)
    )
    agg = agg.where(F.col("Count") > min_count)
    out = attach_medians(agg, df, [K.METHOD_COL], meds)
    return out.select(
        F.col(K.METHOD_COL).alias("Method"), "mean_performance_ratio", "median_performance_ratio", "Count"
    ).orderBy(F.col("Count").desc(), F.col("Method"))


def priority_performance(df: DataFrame) -> DataFrame:
    """Per priority: mean/median ratio and hours, count, met %, and the
    displayed score (met % at one decimal)."""
    require_columns(df, K.PRIORITY_COL, K.RATIO_COL)
    meds = {"median_performance": ratio(), "median_resolution_hours": F.col(K.HOURS_COL)}
    agg = TK.without_null_keys(df, [K.PRIORITY_COL]).groupBy(K.PRIORITY_COL).agg(
        F.avg(K.RATIO_COL).alias("avg_performance"),
        F.avg(K.HOURS_COL).alias("avg_resolution_hours"),
        F.count(F.lit(1)).alias("count"),
        A.met_pct(ratio()).alias("target_met_pct"),
        *median_stats(meds),
    )
    out = attach_medians(agg, df, [K.PRIORITY_COL], meds)
    return order_by_priority(out.select(
        K.PRIORITY_COL, "avg_performance", "median_performance", "avg_resolution_hours", "median_resolution_hours",
        "count", "target_met_pct", F.round("target_met_pct", 1).alias("performance_score"),
    ))


def map_points(
    df: DataFrame, n: int = K.MAP_SAMPLE_SIZE, seed: int = K.MAP_SAMPLE_SEED, id_cols: Optional[list[str]] = None,
    oversample: float = 4.0,
) -> DataFrame:
    """Rows with valid coordinates; when more than ``n``, a seeded sample of
    exactly ``n``: the ``n`` rows with the smallest MD5 of the seed and their
    own (non-derived) columns or ``id_cols`` as text (NULL as empty text), ties
    by all their own columns, so the choice depends neither on partitioning nor
    on the engine.

    The hash is uniform, so with ``N`` points the rows below a cutoff that
    keeps about ``4n`` of them are written once (widened if fewer than ``n``
    pass) and the exact top-``n`` is taken from that small set: no task and
    no merge step grows with the input.  Ordered HIGH..LOW."""
    require_columns(df, "latitude", "longitude")
    if K.VALID_COORDS_COL in df.columns:
        pts = df.where(F.col(K.VALID_COORDS_COL))
    else:
        lat, lon = C.to_double(C.qcol("latitude")), C.to_double(C.qcol("longitude"))
        pts = df.where(C.valid_coords(lat, lon))
    # The ticket's own columns identify a row; the derived columns are
    # functions of them, so they add nothing but hashing cost.
    cols = id_cols or [c for c in df.columns if c not in K.ADDED_COLUMNS]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(C.qcol(c).cast("string"), F.lit("")) for c in cols])
    hashed = pts.withColumn("__h", F.md5(text.cast("binary")))
    own = [c for c in df.columns if c not in K.ADDED_COLUMNS]
    total = pts.count()
    if total <= n:
        sample = hashed.drop("__h")
    else:
        frac = min(1.0, oversample * n / total)
        while True:
            cut = int(frac * 16**15)
            kept = hashed if cut >= 16**15 else hashed.where(F.col("__h") < F.lit(f"{cut:015x}"))
            cand = materialize(kept, "sample")
            if frac >= 1.0 or cand.count() >= n:
                break
            frac = min(1.0, frac * 4)
        sample = cand.orderBy(F.col("__h"), *[C.qcol(c).asc_nulls_first() for c in own]).limit(n).drop("__h")
    if K.PRIORITY_COL in sample.columns:
        sample = order_by_priority(sample)
    return sample


def type_priority_grid(df: DataFrame, k: int = K.GRID_TYPES) -> DataFrame:
    """Top-k types x the four priorities, every cell present: mean/median
    ratio, met % and non-null ratio count; empty cells count 0, others NULL."""
    require_columns(df, K.PRIORITY_COL, K.RATIO_COL)
    t = type_col(df)
    cell = [t, K.PRIORITY_COL]
    meds = {"median_perf": ratio()}
    # One pass: every (type, priority) cell with its row count and median
    # stats, written once; the top-k types are ranked from those cells.
    cells = materialize(
        TK.without_null_keys(df, [t]).groupBy(*cell).agg(
            F.count(F.lit(1)).alias("__rows"),
            F.avg(K.RATIO_COL).alias("avg_perf"), A.met_pct(ratio()).alias("target_met"),
            F.count(K.RATIO_COL).alias("count"), *median_stats(meds),
        ),
        "cells",
    )
    top = TK.top_k(cells.groupBy(t).agg(F.sum("__rows").alias("count")), t, k)
    agg = TK.semi_join_small(cells, top, [t], max_rows=k).where(F.col(K.PRIORITY_COL).isin(*_PRIOS)).drop("__rows")
    agg = attach_medians(agg, df, cell, meds, written=True)  # cells are written; top-k over them is deterministic
    grid = top.select(t, F.explode(F.array(*[F.lit(p) for p in _PRIOS])).alias(K.PRIORITY_COL))
    out = grid.join(agg, on=cell, how="left")
    return out.select(
        t, K.PRIORITY_COL, "avg_perf", "median_perf", "target_met", F.coalesce(F.col("count"), F.lit(0)).alias("count")
    ).orderBy(t, C.priority_rank(F.col(K.PRIORITY_COL)))


def method_priority_share(df: DataFrame) -> DataFrame:
    """Row-normalised method x priority crosstab in %, all four priorities
    (missing as 0), long form, methods by HIGH share desc."""
    require_columns(df, K.METHOD_COL, K.PRIORITY_COL)
    rows = TK.without_null_keys(df, [K.METHOD_COL, K.PRIORITY_COL])
    # One aggregate: the row total (over every priority value present) and
    # the count of each of the four priorities.
    wide = rows.groupBy(K.METHOD_COL).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(K.PRIORITY_COL) == F.lit(p)).alias(p) for p in _PRIOS]
    )
    shares = wide.select(K.METHOD_COL, *[A.pct(F.col(p), F.col("__n")).alias(p) for p in _PRIOS])
    long = shares.unpivot([K.METHOD_COL], _PRIOS, K.PRIORITY_COL, "Percentage")
    high = F.max(F.when(F.col(K.PRIORITY_COL) == "HIGH", F.col("Percentage"))).over(Window.partitionBy(K.METHOD_COL))
    return long.withColumn("__high", high).orderBy(F.col("__high").desc(), F.col(K.METHOD_COL), C.priority_rank(F.col(K.PRIORITY_COL))).drop("__high")


def method_priority_met(df: DataFrame) -> DataFrame:
    """Met % per observed (method, priority) pair over resolved rows."""
    require_columns(df, K.METHOD_COL, K.PRIORITY_COL, K.RATIO_COL)
    rows = TK.without_null_keys(df.where(resolved()), [K.METHOD_COL, K.PRIORITY_COL])
    out = rows.groupBy(K.METHOD_COL, K.PRIORITY_COL).agg(A.met_pct(ratio()).alias("Percent_Meeting_Target"))
    return out.orderBy(K.METHOD_COL, C.priority_rank(F.col(K.PRIORITY_COL)))


def top_types(df: DataFrame, k: int = K.TOP_TYPES) -> DataFrame:
    """Names of the top-k request types (with their volume)."""
    t = type_col(df)
    return TK.top_k(TK.counts(df, [t]), t, k)
