"""Goal reports: achievement by priority, by method, priority x method and
over time.  Population: all rows (open tickets count with their age)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import aggs as A
from ..functions import columns as C
from ..operators import topk as TK
from ..operators.median import median_stats
from .common import attach_medians, created_ts, hours, order_by_priority, ratio, require_columns


def _goal_table(df: DataFrame, key: str) -> DataFrame:
    meds = {"median_resolution_hours": hours()}
    agg = TK.without_null_keys(df, [key]).groupBy(key).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg(K.HOURS_COL).alias("avg_resolution_hours"),
        A.met_count(ratio()).alias("target_met_count"),
        A.met_pct(ratio()).alias("target_met_pct"),
        F.avg(K.RATIO_COL).alias("avg_performance_ratio"),
        *median_stats(meds),
    )
    out = attach_medians(agg, df, [key], meds)
    return out.select(
        key,
        "total_requests",
        "avg_resolution_hours",
        "median_resolution_hours",
        "target_met_count",
        "target_met_pct",
        "avg_performance_ratio",
        C.goal_status(F.col("target_met_pct")).alias("goal_status"),
    )


def priority_goals(df: DataFrame) -> DataFrame:
    """Goal achievement per canonical priority, HIGH..LOW order."""
    require_columns(df, K.PRIORITY_COL, K.RATIO_COL)
    return order_by_priority(_goal_table(df, K.PRIORITY_COL))


def method_goals(df: DataFrame) -> DataFrame:
    """Goal achievement per intake method, by volume."""
    require_columns(df, K.METHOD_COL, K.RATIO_COL)
    return _goal_table(df, K.METHOD_COL).orderBy(F.col("total_requests").desc(), F.col(K.METHOD_COL))


def priority_by_method(df: DataFrame) -> DataFrame:
    """Count per (method, priority) with its share of the method's total and
    the pair's mean ratio and met %.  One aggregate; the method total is a
    window over the (method, priority) rows instead of a self-join."""
    require_columns(df, K.METHOD_COL, K.PRIORITY_COL)
    keys = [K.METHOD_COL, K.PRIORITY_COL]
    aggs = [F.count(F.lit(1)).alias("count")]
    if K.RATIO_COL in df.columns:
        aggs += [F.avg(K.RATIO_COL).alias("avg_performance_ratio"), A.met_pct(ratio()).alias("target_met_pct")]
    agg = TK.without_null_keys(df, keys).groupBy(*keys).agg(*aggs)
    total = F.sum("count").over(Window.partitionBy(K.METHOD_COL))
    out = agg.withColumn("count_total", total).withColumn("percentage", A.pct(F.col("count"), F.col("count_total")))
    cols = [*keys, "count", "count_total", "percentage"] + (["avg_performance_ratio", "target_met_pct"] if K.RATIO_COL in df.columns else [])
    return out.select(*cols).orderBy(F.col(K.METHOD_COL), C.priority_rank(F.col(K.PRIORITY_COL)))


def _months(df: DataFrame) -> tuple[DataFrame, list]:
    """Rows with their created month, and the monthly aggregates but the median."""
    with_month = df.withColumn("__month_date", C.month_start(created_ts(df))).where(F.col("__month_date").isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("request_count"),
        F.avg(K.HOURS_COL).alias("avg_resolution_hours"),
        A.met_pct(ratio()).alias("target_met_pct"),
    ]
    if K.PRIORITY_COL in df.columns:
        aggs.append(A.rate(F.col(K.PRIORITY_COL) == F.lit("HIGH")).alias("high_priority_pct"))
    return with_month, aggs


def performance_over_time(df: DataFrame) -> DataFrame:
    """Per created month: volume, mean/median hours, met %, HIGH share %."""
    with_month, aggs = _months(df)
    meds = {"median_resolution_hours": hours()}
    agg = with_month.groupBy("__month_date").agg(*aggs, *median_stats(meds))
    out = attach_medians(agg, with_month, ["__month_date"], meds)
    cols = ["request_count", "avg_resolution_hours", "median_resolution_hours", "target_met_pct"]
    if K.PRIORITY_COL in df.columns:
        cols.append("high_priority_pct")
    return out.select(
        C.month_label(F.col("__month_date")).alias("month"), *cols, F.col("__month_date").alias("month_date")
    ).orderBy("month_date")


def monthly_table(df: DataFrame) -> DataFrame:
    """Display table of the monthly metrics, month written as ``Mon yyyy``."""
    with_month, aggs = _months(df)
    m = with_month.groupBy(F.col("__month_date").alias("month_date")).agg(*aggs)
    cols = [c for c in ("request_count", "target_met_pct", "avg_resolution_hours", "high_priority_pct") if c in m.columns]
    return m.select(F.date_format(F.col("month_date").cast("date"), "MMM yyyy").alias("month"), *cols, "month_date").orderBy("month_date").drop("month_date")
