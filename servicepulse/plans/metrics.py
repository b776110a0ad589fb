"""Metric tables of the performance summary.

Population rules: counts and rates use all rows; hours, ratio and met %
use resolved rows only.  Each table is one grouped aggregate with
conditional aggregates (no per-category re-scan of the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import aggs as A
from ..functions import columns as C
from ..operators import topk as T
from ..operators.median import median_stats
from ..session import materialize
from .common import attach_medians, created_ts, hours, ratio, report_base, resolved, roles_of, type_col, zip_col


def overall_metrics(df: DataFrame) -> DataFrame:
    """One row: totals, resolution rate, met % / mean / median over resolved."""
    meds = {"median_resolution_hours": F.when(resolved(), hours())}
    base = df.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(resolved()).alias("resolved_requests"),
        A.rate(resolved()).alias("resolution_rate"),
        A.met_pct(ratio(), resolved(), empty_value=0.0).alias("percent_meeting_target"),
        A.avg_where(hours(), resolved()).alias("avg_resolution_hours"),
        *median_stats(meds),
    )
    return attach_medians(base, df, [], meds)


def status_counts(df: DataFrame) -> DataFrame:
    status = roles_of(df).status
    if status is None:
        raise ValueError("no status column")
    return T.counts(df, [status]).orderBy(*T.order_desc_then_key("count", [status]))


def category_counts(df: DataFrame) -> DataFrame:
    return T.counts(df, [K.CATEGORY_COL]).orderBy(*T.order_desc_then_key("count", [K.CATEGORY_COL]))


def _profile(df: DataFrame, key: str, with_target: bool) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("count"),
        A.avg_where(hours(), resolved()).alias("avg_resolution_hours"),
        A.rate(resolved()).alias("resolution_rate"),
    ]
    if with_target:
        aggs.append(F.max(K.TARGET_COL).alias("target_hours"))
    aggs.append(A.met_pct(ratio(), resolved(), empty_value=0.0).alias("percent_meeting_target"))
    return T.without_null_keys(df, [key]).groupBy(C.qcol(key)).agg(*aggs)


def type_profile(df: DataFrame, k: int = K.TOP_TYPES) -> DataFrame:
    """Top-k request types by volume with their resolution profile."""
    t = type_col(df)
    return T.top_k(_profile(df, t, True), t, k)


def type_category_counts(df: DataFrame, k: int = K.TOP_TYPES) -> DataFrame:
    """Category counts inside each of the top-k request types."""
    t = type_col(df)
    # The aggregated pairs are written once; the type totals and the result
    # both read them (one pass over the rows).
    per = materialize(T.counts(df, [t, K.CATEGORY_COL]), "pairs")
    top = T.top_k(per.groupBy(t).agg(F.sum("count").alias("count")), t, k)
    return T.semi_join_small(per, top, [t], max_rows=k)


def zip_profile(df: DataFrame, k: int = K.TOP_ZIPS) -> DataFrame:
    z = zip_col(df)
    return T.top_k(_profile(df, z, False), z, k)


def monthly_counts(df: DataFrame) -> DataFrame:
    m = C.month_label(created_ts(df))
    return df.select(m.alias("month")).where(F.col("month").isNotNull()).groupBy("month").agg(F.count(F.lit(1)).alias("count"))


def monthly_performance(df: DataFrame) -> DataFrame:
    m = C.month_label(created_ts(df))
    return (
        df.where(resolved())
        .select(m.alias("month"), ratio())
        .where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.avg(K.RATIO_COL).alias("avg_performance_ratio"))
    )


def performance_metrics(df: DataFrame) -> dict[str, DataFrame]:
    """All metric tables of the summary, by name.

    Building them writes the columns that the tables use (the one pass over
    the input) and small intermediate tables; everything else stays lazy until
    the caller's action.
    """
    return _summary(report_base(df))


def _summary(df: DataFrame) -> dict[str, DataFrame]:
    out = {
        "overall": overall_metrics(df),
        "performance_categories": category_counts(df),
    }
    r = roles_of(df)
    if r.status is not None:
        out["status_counts"] = status_counts(df)
    if r.request_type is not None:
        out["request_types"] = type_profile(df)
        out["request_type_categories"] = type_category_counts(df)
    if r.zip is not None:
        out["zipcode_metrics"] = zip_profile(df)
    if r.created is not None:
        out["monthly_counts"] = monthly_counts(df)
        out["monthly_performance"] = monthly_performance(df)
    return out
