"""Distributed exact median against a brute-force median."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from servicepulse.operators.median import grouped_medians, median_of


def _brute(rows, key_idx, val_idx):
    groups = {}
    for r in rows:
        k, v = r[key_idx], r[val_idx]
        if k is None or v is None or (isinstance(v, float) and np.isnan(v)):
            continue
        groups.setdefault(k, []).append(v)
    return {k: float(np.median(v)) for k, v in groups.items()}


@pytest.mark.parametrize("finish_at,bins", [(1_000_000, 4096), (300, 8), (50, 2)])
def test_grouped_median_skewed(spark, finish_at, bins):
    rnd = random.Random(7)
    rows = []
    for i in range(20000):
        g = "hot" if i % 3 else rnd.choice(["a", "b", None])
        v = rnd.choice([rnd.random() * 100, 5.0, 5.0, None, float(rnd.randint(0, 10)), float("nan")])
        if i % 101 == 0:
            v = 1e9
        rows.append((g, v, float(rnd.randint(-3, 3))))
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r.g: (r.mv, r.mw) for r in grouped_medians(df, ["g"], {"mv": "v", "mw": "w"}, finish_at=finish_at, bins=bins).collect()}
    bv, bw = _brute(rows, 0, 1), _brute(rows, 0, 2)
    assert set(got) == set(bv)
    for k in bv:
        assert got[k][0] == pytest.approx(bv[k], abs=1e-12)
        assert got[k][1] == pytest.approx(bw[k], abs=1e-12)


def test_global_median_even_and_ties(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 4.0, 7.0, 7.0, 7.0]], "v double")
    assert median_of(df, "v", finish_at=2, bins=2).first().median == 5.5


def test_median_empty_and_all_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert grouped_medians(df, ["g"], {"m": "v"}).count() == 0


def test_median_matches_builtin_on_adapter(spark, enriched001):
    got = {r.PRIORITY: r.m for r in grouped_medians(enriched001, ["PRIORITY"], {"m": "resolution_hours"}, finish_at=100, bins=16).collect()}
    want = {r.PRIORITY: r.m for r in enriched001.groupBy("PRIORITY").agg(F.median("resolution_hours").alias("m")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_forced_rounds_on_adapter_data_match_builtin(spark):
    from servicepulse.operators.classify import enrich
    from servicepulse.sources.tables import AS_OF, requests_from_tables
    from request_paths import SF01
    e = enrich(requests_from_tables(spark, SF01), as_of=AS_OF)
    vals = {"h": "resolution_hours", "r": "performance_ratio", "id": F.col("SR_ID"), "age": "hours_since_creation"}
    got = {r.PRIORITY: r for r in grouped_medians(e, ["PRIORITY"], vals, finish_at=1000, bins=64).collect()}
    want = {r.PRIORITY: r for r in e.groupBy("PRIORITY").agg(
        *[F.median(v if not isinstance(v, str) else F.col(v)).alias(k) for k, v in vals.items()]).collect()}
    assert got.keys() == want.keys()
    for p in want:
        for k in vals:
            assert got[p][k] == pytest.approx(want[p][k], rel=1e-12, abs=1e-9), (p, k)


def test_salted_state_join_for_many_groups(spark, monkeypatch):
    import servicepulse.operators.median as M
    monkeypatch.setattr(M, "BROADCAST_MAX_GROUPS", 1)  # force the salted shuffle join
    rows = [("hot" if i % 3 else f"g{i % 7}", float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in M.grouped_medians(df, ["g"], {"m": "v"}, finish_at=50, bins=8).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx(want)
    plan = M.grouped_medians(df, ["g"], {"m": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan
