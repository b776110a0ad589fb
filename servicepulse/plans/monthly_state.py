"""Monthly reports kept up to date batch by batch.

A batch of tickets that has landed leaves its partial aggregates (counts and sums per created month,
nothing per ticket) in a state folder; a report adds up those of all batches, so new files do not
re-read old ones.  Deliveries are only appended, and of a batch delivered again the last
one counts: a job that died or ran twice changes nothing.  An open ticket's age
belongs to the batch's own ``as_of``; a batch is delivered again to age it or to close it.

Medians need the tickets themselves (``goals.performance_over_time``).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import aggs as A
from ..functions import columns as C
from .common import created_ts, hours, ratio, resolved

_SUMS = ("tickets", "resolved", "met", "high", "hours_n", "hours_sum", "ratio_n", "ratio_sum")
_SCHEMA = "batch string, delivered bigint, month string, tickets bigint, resolved bigint, met bigint, high bigint, hours_n bigint, hours_sum double, ratio_n bigint, ratio_sum double"


def add_batch(df: DataFrame, folder: str, batch: str) -> None:
    """Deliver the enriched tickets of ``batch``: their partial aggregates per created month (tickets without one have no part).

    A batch without any dated ticket leaves a mark too, so that it replaces an earlier delivery.
    """
    closed_ratio = F.when(resolved(), ratio())
    high = F.col(K.PRIORITY_COL) == "HIGH" if K.PRIORITY_COL in df.columns else F.lit(False)
    part = df.select(C.month_label(created_ts(df)).alias("month"), *[x.alias(n) for n, x in (("r", resolved()), ("m", A.meets(ratio())), ("h", hours()), ("q", closed_ratio), ("p", high))])
    part = part.where("month is not null").groupBy("month").agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if("r").alias("resolved"), F.count_if("m").alias("met"), F.count_if("p").alias("high"),
        F.count("h").alias("hours_n"), F.sum("h").alias("hours_sum"), F.count("q").alias("ratio_n"), F.sum("q").alias("ratio_sum"))
    mark = df.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in _SCHEMA.split(", ")[2:])])
    out = part.unionByName(mark).select(F.lit(batch).alias("batch"), F.lit(time.time_ns()).alias("delivered"), "month", *_SUMS)
    out.coalesce(1).write.mode("append").parquet(folder)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The partial aggregates in force: of every batch those of its last delivery."""
    rows = spark.read.schema(_SCHEMA).parquet(folder)
    last = F.max("delivered").over(Window.partitionBy("batch"))
    return rows.withColumn("last", last).where("delivered = last and month is not null").drop("last")


def monthly_report(spark: SparkSession, folder: str) -> DataFrame:
    """month, count, resolved, avg_resolution_hours, target_met_pct, high_priority_pct, avg_performance_ratio (of the resolved) over all batches."""
    total = state(spark, folder).groupBy("month").agg(*[F.sum(c).alias(c) for c in _SUMS])
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    return total.select(
        "month",
        F.col("tickets").alias("count"),
        "resolved",
        mean("hours_sum", "hours_n").alias("avg_resolution_hours"),
        A.pct(F.col("met"), F.col("tickets")).alias("target_met_pct"),
        A.pct(F.col("high"), F.col("tickets")).alias("high_priority_pct"),
        mean("ratio_sum", "ratio_n").alias("avg_performance_ratio"),
    )
