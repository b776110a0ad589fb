"""Batches of tickets merged into one monthly state."""

import pytest
from pyspark.sql import functions as F

from servicepulse.plans import metrics, monthly_state
from servicepulse.session import scratch_path

COLUMNS = ["count", "resolved", "avg_resolution_hours", "target_met_pct", "high_priority_pct", "avg_performance_ratio"]


def _report(spark, folder):
    return {r["month"]: [r[c] for c in COLUMNS] for r in monthly_state.monthly_report(spark, folder).collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for m in a:
        assert a[m] == pytest.approx(b[m], nan_ok=True)


def test_batches_add_up_to_the_full_run(spark, enriched001):
    whole, parts = scratch_path(spark, "state-whole"), scratch_path(spark, "state-parts")
    monthly_state.add_batch(enriched001, whole, "all")
    by = F.pmod("SR_ID", F.lit(3))
    for i in range(2):
        monthly_state.add_batch(enriched001.where(by == i), parts, f"b{i}")
    before = _report(spark, parts)
    monthly_state.add_batch(enriched001.where(by == 2), parts, "b2")
    full = _report(spark, whole)
    _same(_report(spark, parts), full)
    assert before != full
    # The reports that read the tickets say the same.
    assert {m: v[0] for m, v in full.items()} == {r["month"]: r["count"] for r in metrics.monthly_counts(enriched001).collect()}
    ratios = {r["month"]: r["avg_performance_ratio"] for r in metrics.monthly_performance(enriched001).collect()}
    assert {m: v[5] for m, v in full.items() if v[5] is not None} == pytest.approx(ratios)


def test_a_batch_delivered_again_counts_once(spark, enriched001):
    folder = scratch_path(spark, "state-again")
    some = enriched001.where("SR_ID % 5 = 0")
    monthly_state.add_batch(enriched001, folder, "x")
    monthly_state.add_batch(some, folder, "y")
    first = _report(spark, folder)
    monthly_state.add_batch(some, folder, "y")
    _same(_report(spark, folder), first)
    monthly_state.add_batch(enriched001.limit(0), folder, "x")  # withdrawn
    only = scratch_path(spark, "state-only")
    monthly_state.add_batch(some, only, "y")
    _same(_report(spark, folder), _report(spark, only))
    assert monthly_state.state(spark, folder).select("batch").distinct().collect()[0][0] == "y"
