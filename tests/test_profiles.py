"""Most frequent values by sketch and candidates, medians by brackets: against plain counts and sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from servicepulse.operators import heavy_hitters, median
from servicepulse.plans import insights


def _want(df, cols, k):
    out = []
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).count().collect()
        out += [(c, r[0], r[1], i) for i, r in enumerate(sorted(counts, key=lambda r: (-r[1], r[0].encode()))[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30_000):
        heavy = f"h{rng.randrange(6)}" if rng.random() < 0.5 else f"t{rng.randrange(9000)}"
        rows.append((f"s{i % 3}", f"id{i:06d}", heavy, None, f"f{rng.randrange(4000)}", None if i % 3 else "é"))
    return spark.createDataFrame(rows, "few string, ids string, heavy string, none string, flat string, rare string").repartition(6)


def test_top_values_of_each_kind(spark, wide, monkeypatch):
    full = []
    monkeypatch.setattr(heavy_hitters, "_counted", lambda df, cols, k, f=heavy_hitters._counted: (full.extend(cols), f(df, cols, k))[1])
    got = heavy_hitters.top_values(wide, wide.columns, 5)
    assert sorted(map(tuple, got.collect())) == _want(wide, wide.columns, 5)
    assert full == ["ids", "flat"]  # the heavy hitters were proven, the rest is exact from the sketch


def test_top_values_of_columns_with_few_values_read_the_rows_once(spark, wide, monkeypatch):
    monkeypatch.setattr(heavy_hitters, "_counted", None)
    assert sorted(map(tuple, heavy_hitters.top_values(wide, ["few", "none", "rare"], 2).collect())) == _want(wide, ["few", "none", "rare"], 2)
    assert heavy_hitters.top_values(wide.limit(0), ["few"], 5).collect() == []


def test_estimates_that_lost_a_counter_never_add_up(spark):
    """Just more values than counters, all once but some: the sum of what is returned stays below the rows."""
    for n in (heavy_hitters.TRACKED, 3 * heavy_hitters.TRACKED, 20 * heavy_hitters.TRACKED):
        df = spark.range(n).select(F.when(F.col("id") < 300, F.lit("x")).otherwise(F.col("id").cast("string")).alias("v")).repartition(5)
        assert sorted(map(tuple, heavy_hitters.top_values(df, ["v"], 3).collect())) == _want(df, ["v"], 3)


def test_profile_of_string_columns(spark, wide):
    assert sorted(map(tuple, insights.categorical_profile(wide, 3, 4).collect())) == _want(wide, wide.columns[:3], 4)


VALUES = {
    "uniform": lambda i, r: r.random(), "ties": lambda i, r: float(r.randrange(3)), "one": lambda i, r: 7.0, "nulls": lambda i, r: None,
    "some": lambda i, r: r.gauss(0, 1e6) if r.random() < 0.1 else None, "ends": lambda i, r: r.choice([float("inf"), float("-inf"), 1.0, 2.0]),
    "nan": lambda i, r: float("nan") if r.random() < 0.5 else r.paretovariate(0.3), "signed": lambda i, r: r.choice([0.0, -0.0, -1.0]),
}


@pytest.mark.parametrize("rows,finish_at", [(1, 10), (2, 10), (9001, 10), (20_000, 1_000_000)])
def test_bracketed_medians_are_exact(spark, rows, finish_at):
    rng = random.Random(rows)
    data = [tuple(f(i, rng) for f in VALUES.values()) for i in range(rows)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in VALUES)).repartition(5)
    row = df.agg(*median.bracket_stats({n: n for n in VALUES})).first()
    got = median.bracketed_medians(df, {n: n for n in VALUES}, row, bins=8, finish_at=finish_at)
    for n, column in zip(VALUES, zip(*data)):
        known = [v for v in column if v is not None and v == v]
        want = float(np.median(known)) if known else None
        assert got[n] == (want if want is None else pytest.approx(want, rel=1e-12, nan_ok=True)), n


def test_a_bracket_that_misses_the_middle_is_noticed(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert median.bracketed_medians(df, {"v": "v"}, {"__bn0": 1001, "__br0": [700.0, 800.0]}) == {"v": 500.0}
    assert median.bracketed_medians(df, {"v": "v"}, {"__bn0": 1001, "__br0": [500.0, 500.0]}) == {"v": 500.0}
