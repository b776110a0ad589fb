"""Spark-native analytics for municipal service-request (311-style) tickets.

Typical use::

    from servicepulse import analyze, read_csv_dir
    enriched, metrics = analyze(read_csv_dir(spark, "/data/311/"), as_of="2025-01-01")
    metrics["overall"].show()
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame

from .operators.classify import classify, enrich
from .operators.median import grouped_medians, median_of
from .operators.resolution import AsOf, ticket_age, with_resolution
from .operators.standardise import coerce_dates, standardise
from .plans import goals, insights, metrics, payload, reports
from .plans.insights import insight_tables
from .plans.metrics import performance_metrics
from .roles import Roles, resolve_roles
from .sources.csv_tables import load_csv
from .sources.files import limit_records, read_csv, read_csv_dir, read_features


def analyze(df: DataFrame, as_of: AsOf = None, persist: bool = False, **std_options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Standardise, add resolution time and classify ``df``; return the
    enriched frame and the summary metric tables.

    With ``persist`` the enriched frame is persisted first (worth it when
    several reports run over it)."""
    enriched = enrich(df, as_of=as_of, **std_options)
    if persist:
        enriched = enriched.persist()
    return enriched, performance_metrics(enriched)


__all__ = [
    "AsOf", "Roles", "analyze", "classify", "coerce_dates", "enrich", "goals", "grouped_medians", "insight_tables",
    "insights", "limit_records", "load_csv", "median_of", "metrics", "payload", "performance_metrics", "read_csv", "read_csv_dir",
    "read_features", "reports", "resolve_roles", "standardise", "ticket_age", "with_resolution",
]
