"""Property tests: the folded per-row rules against direct simulations of
the documented semantics, and the distributed median against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servicepulse import constants as K
from servicepulse.functions import columns as C
from servicepulse.operators.median import grouped_medians

TOKENS = ["PHONE", "WEB", "APP", "MOBILE", "EMAIL", "MAIL", "WALK-IN", "WALKIN", "IN-PERSON", "COUNTER", "FAX",
          "OTHER", "x", " ", "-", "phone", "Mail", "IN", "PERSON", "WALK"]

texts = st.lists(st.sampled_from(TOKENS), min_size=0, max_size=4).map("".join) | st.none()


def sequential_method(raw):
    """Sequential overwrite semantics: every rule re-tests the current value."""
    cur = "NONE" if raw is None else str(raw).upper()
    for key, label in K.METHOD_MAP:
        if key in cur:
            cur = label
    return cur if cur in {lab for _, lab in K.METHOD_MAP} else K.UNKNOWN_METHOD


def first_match_target(raw):
    u = "" if raw is None else str(raw).upper()
    return next((h for key, h in K.RESOLUTION_TARGETS if key in u), K.DEFAULT_TARGET_HOURS)


SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=40))
def test_method_matches_sequential_rules(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    got = [r.m for r in df.select(C.canon_method(F.col("raw")).alias("m")).collect()]
    assert got == [sequential_method(v) for v in values]


@SETTINGS
@given(st.lists(st.sampled_from(list(K.PRIORITY_MAP) + ["high", "x", " LOW", "urgent", "0"]) | st.none(), min_size=1, max_size=30))
def test_priority_matches_lookup(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    got = [r.p for r in df.select(C.canon_priority(F.col("raw")).alias("p")).collect()]
    want = [K.PRIORITY_MAP.get(str(v).upper(), "NORMAL") if v is not None else "NORMAL" for v in values]
    assert got == want


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["POTHOLE", "STREET", "LIGHT", "TREE", "TRASH", "water", " leak", "SIGNAL",
                                          "TRAFFIC ", "side", "walk", "graffiti", "DRAINAGE", "?"]), max_size=4).map("".join)
                | st.none(), min_size=1, max_size=30))
def test_target_matches_first_match(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    got = [r.t for r in df.select(C.target_hours(F.col("raw")).alias("t")).collect()]
    assert got == [first_match_target(v) for v in values]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]),
                  st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False))),
        min_size=1, max_size=300),
    st.sampled_from([(4, 2), (16, 5), (4096, 1_000_000)]),
)
def test_median_matches_numpy(spark, rows, cfg):
    bins, finish_at = cfg
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in grouped_medians(df, ["g"], {"m": "v"}, bins=bins, finish_at=finish_at).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        vals = [v for gg, v in rows if gg == g and v is not None]
        if vals:
            want[g] = float(np.median(vals))
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-9)
