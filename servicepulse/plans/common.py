"""Pieces shared by the report builders."""

from __future__ import annotations

from typing import Mapping, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import aggs as A
from ..functions import columns as C
from ..operators.median import grouped_medians, stat_names, stats_from_aggregate
from ..operators.standardise import coerce_timestamp
from ..roles import Roles, frame_roles
from ..session import materialize


def roles_of(df: DataFrame) -> Roles:
    return frame_roles(df)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required column(s) not available: {', '.join(missing)}")


def type_col(df: DataFrame) -> str:
    r = roles_of(df)
    if r.request_type is None:
        raise ValueError("no request-type column")
    return r.request_type


def zip_col(df: DataFrame) -> str:
    r = roles_of(df)
    if r.zip is None:
        raise ValueError("no zip column")
    return r.zip


def created_ts(df: DataFrame) -> Column:
    r = roles_of(df)
    if r.created is None:
        raise ValueError("no creation-date column")
    dtype = df.schema[r.created].dataType
    return coerce_timestamp(C.qcol(r.created), dtype, epoch_millis=True)


def report_base(df: DataFrame) -> DataFrame:
    """The columns that the summary, geographic and seasonal tables use, written
    once to the checkpoint folder: a set of tables then reads the raw input a
    single time and a few narrow columns after that."""
    r = roles_of(df)
    roles = [c for c in (r.request_type, r.zip, r.status, r.created) if c is not None]
    derived = [K.PRIORITY_COL, K.METHOD_COL, K.HOURS_COL, K.RESOLVED_COL, K.TARGET_COL, K.RATIO_COL, K.CATEGORY_COL]
    names = dict.fromkeys([*roles, *[c for c in derived if c in df.columns]])
    return materialize(df.select(*[C.qcol(c) for c in names]), "report-base")


def attach_medians(
    agg: DataFrame, df: DataFrame, keys: Sequence[str], values: Mapping[str, Union[str, Column]], *, written: bool = False
) -> DataFrame:
    """Add exact medians of ``values`` (computed on the rows of ``df``) to the
    per-group table ``agg``.

    ``agg`` must carry ``median_stats(values)`` among its aggregates: the
    report's own pass then also yields each group's count/min/max, and the
    median needs only its finishing pass over the rows.  ``agg`` is written
    once to the checkpoint folder (it decides which groups -- e.g. a top-k --
    get a median, so it must not be recomputed differently).  ``written``:
    ``agg`` is already a deterministic function of a written table (e.g. a
    key-ordered top-k over it), so it is not written again.
    """
    names = list(values)
    if not written:
        agg = materialize(agg, "report")
    med = grouped_medians(df, keys, values, stats=stats_from_aggregate(agg, keys, names))
    stat_cols = [c for i in range(len(names)) for c in stat_names(i)]
    if keys:
        return agg.join(med, on=list(keys), how="left").drop(*stat_cols)
    # No key: both sides hold at most one row.  Combine them with a union and
    # a global aggregate instead of a (constant-key) join.
    base = agg.drop(*stat_cols)
    types = dict(base.dtypes)
    left = base.select("*", *[F.lit(None).cast("double").alias(n) for n in names], F.lit(1).alias("__from_agg"))
    right = med.select(*[F.lit(None).cast(types[c]).alias(c) for c in base.columns], *names, F.lit(None).cast("int").alias("__from_agg"))
    both = left.unionByName(right)
    cols = base.columns + names
    out = both.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in cols], F.count("__from_agg").alias("__n"))
    return out.where(F.col("__n") > 0).drop("__n")


def share_of_total(agg: DataFrame, count_col: str, out: str = "percent_of_total") -> DataFrame:
    """Percentage of each group's count in the sum over all groups.

    ``agg`` is an aggregated table (one row per group, NULL-key group
    included so the denominator counts every row).  It is written once to
    the checkpoint folder; the total is one scalar summed from it, so no
    step gathers the groups into a single task.
    """
    agg = materialize(agg, "groups")
    total = agg.agg(F.sum(F.col(count_col))).first()[0] or 0
    return agg.withColumn(out, A.pct(F.col(count_col), F.lit(total).cast("long")))


def order_by_priority(df: DataFrame, *extra: Column, col: str = K.PRIORITY_COL) -> DataFrame:
    return df.orderBy(C.priority_rank(F.col(col)), *extra)


def resolved() -> Column:
    return F.col(K.RESOLVED_COL)


def hours() -> Column:
    return F.col(K.HOURS_COL)


def ratio() -> Column:
    return F.col(K.RATIO_COL)
