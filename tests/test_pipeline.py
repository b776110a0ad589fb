"""End-to-end goldens and invariants over the adapter and the car CSV."""

import os

import pytest
from pyspark.sql import functions as F

from servicepulse import constants as K
from servicepulse.operators.classify import enrich
from servicepulse.plans import goals, insights, metrics, reports
from servicepulse.sources import files
from servicepulse.sources.tables import AS_OF, requests_from_tables

from request_paths import SF001, SF01

# Expected rows per category (FIXTURES.md §2).
GOLDEN = {
    SF001: {"Excellent": 876, "Good": 714, "On Target": 259, "Delayed": 1223, "Severely Delayed": 1867,
            "In Progress (Within Target)": 72, "In Progress (Exceeding Target)": 873, "Unknown": 116},
    SF01: {"Excellent": 8881, "Good": 6802, "On Target": 2727, "Delayed": 12260, "Severely Delayed": 18410,
           "In Progress (Within Target)": 649, "In Progress (Exceeding Target)": 9095, "Unknown": 1176},
}

CARS = os.path.join(os.path.dirname(__file__), "data", "cars_sample.csv")


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_golden_category_counts(spark, sf):
    e = enrich(requests_from_tables(spark, sf), as_of=AS_OF)
    got = {r[K.CATEGORY_COL]: r["count"] for r in metrics.category_counts(e).collect()}
    assert got == GOLDEN[sf]


def test_category_counts_sum_to_total(enriched001):
    total = metrics.overall_metrics(enriched001).first().total_requests
    assert sum(r["count"] for r in metrics.category_counts(enriched001).collect()) == total == 6000


def test_method_shares_sum_to_100(enriched001):
    for r in goals.priority_by_method(enriched001).groupBy(K.METHOD_COL).agg(F.sum("percentage").alias("s")).collect():
        assert r.s == pytest.approx(100.0)
    for r in reports.method_priority_share(enriched001).groupBy(K.METHOD_COL).agg(F.sum("Percentage").alias("s")).collect():
        assert r.s == pytest.approx(100.0)


def test_season_volume_always_four(spark):
    df = spark.createDataFrame(
        [("2024-01-05",), ("2024-03-31",), ("2024-04-01",), ("2024-12-31",), (None,)], "CREATED_DATE string"
    )
    e = enrich(df, as_of="2025-01-01")
    out = {r.season: r["count"] for r in insights.season_volume(e).collect()}
    assert out == {"Winter": 2, "Spring": 1, "Summer": 0, "Fall": 1}


def test_top_k_ties_break_on_key(spark):
    rows = [("b", "1"), ("a", "1"), ("c", "2"), ("c", "2"), (None, "9"), (None, "9"), (None, "9"), ("d", "3"), (None, None)]
    df = enrich(spark.createDataFrame(rows, "SR_TYPE string, ZIP_CODE string"), as_of="2025-01-01")
    got = [r.SR_TYPE for r in reports.top_types(df, k=3).collect()]
    # NULL types are filled with UNKNOWN (3 rows) before counting
    assert got == ["UNKNOWN", "c", "a"]
    zips = [r.ZIP_CODE for r in insights.top_zips(df, k=2).collect()]
    assert zips == ["9", "1"]
    from servicepulse.operators.standardise import drop_empty_rows
    assert df.count() == 9 and drop_empty_rows(spark.createDataFrame(rows, "SR_TYPE string, ZIP_CODE string")).count() == 8


def test_degenerate_car_csv(spark):
    raw = files.read_csv(spark, CARS)
    assert raw.count() == 39 and raw.where(F.col("horsepower").isNull()).count() == 1
    e = enrich(raw)
    m = metrics.overall_metrics(e).first()
    assert (m.total_requests, m.resolved_requests, m.resolution_rate, m.percent_meeting_target) == (39, 0, 0.0, 0.0)
    assert m.avg_resolution_hours is None and m.median_resolution_hours is None
    cats = {r[K.CATEGORY_COL]: r["count"] for r in metrics.category_counts(e).collect()}
    assert cats == {"Unknown": 39}
    first = e.first()
    assert first[K.PRIORITY_COL] == "NORMAL" and first[K.METHOD_COL] == "UNKNOWN"
    assert first.SR_TYPE == "UNKNOWN" and first[K.TARGET_COL] == 120
    assert "model-year" in e.columns


def test_report_tables_shapes(enriched001):
    assert reports.type_priority_grid(enriched001).count() == 20
    grid = reports.type_priority_grid(enriched001).collect()
    assert all(r["count"] >= 0 for r in grid)
    assert insights.season_volume(enriched001).count() == 4
    assert goals.priority_goals(enriched001).count() == 4
    pts = reports.map_points(enriched001)
    assert 0 < pts.count() <= K.MAP_SAMPLE_SIZE
    assert pts.where(~F.col(K.VALID_COORDS_COL)).count() == 0


def test_map_points_sample_is_stable(enriched001, spark):
    a = sorted(r.SR_ID for r in reports.map_points(enriched001, n=50).collect())
    b = sorted(r.SR_ID for r in reports.map_points(enriched001.repartition(7), n=50).collect())
    assert a == b and len(a) == 50


def test_insight_selector(enriched001):
    assert set(insights.insight_tables(enriched001, kind="seasonal")) == {
        "monthly_volumes", "seasonal_volumes", "top_request_types_by_season", "seasonal_performance"}
    comp = insights.insight_tables(enriched001, kind="comparative_request_type")
    assert comp["categories"].count() == 10
    assert "dataset_shape" in insights.insight_tables(enriched001, custom_question="why?")
    assert "request_type" in insights.insight_tables(enriched001, request_type="Graffiti")
    with pytest.raises(ValueError):
        insights.insight_tables(enriched001, kind="nope")


def test_payload_json_nulls(spark):
    from servicepulse.plans.payload import to_json_lines
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x")], "a double, b string")
    out = [r.json for r in to_json_lines(df).collect()]
    assert out == ['{"a":1.0,"b":null}', '{"a":null,"b":"x"}']


def test_analyze_returns_enriched_and_metrics(spark):
    from servicepulse import analyze
    raw = requests_from_tables(spark, SF001)
    enriched, m = analyze(raw, as_of=AS_OF)
    assert K.CATEGORY_COL in enriched.columns
    assert {"overall", "performance_categories", "status_counts", "request_types", "zipcode_metrics",
            "monthly_counts", "monthly_performance"} <= set(m)
    assert m["overall"].first().total_requests == 6000


def test_payload_sections(enriched001):
    from servicepulse.plans.payload import payload
    out = payload({"overall": metrics.overall_metrics(enriched001), "categories": metrics.category_counts(enriched001)})
    sections = [r.section for r in out.collect()]
    assert sections.count("overall") == 1 and sections.count("categories") == 8


def test_crosstab_drops_absent_priority_and_share_fills_zero(spark):
    rows = [("Pothole", "1"), ("Pothole", "1"), ("Tree", "2"), ("Tree", "1")]
    df = enrich(spark.createDataFrame(rows, "SR_TYPE string, SR_PRIORITY string"), as_of="2025-01-01")
    ct = {(r.SR_TYPE, r.Priority): r.Count for r in reports.priority_by_type(df).collect()}
    # only HIGH and MEDIUM occur, so only those columns exist (zeros filled)
    assert ct == {("Pothole", "HIGH"): 2, ("Pothole", "MEDIUM"): 0, ("Tree", "HIGH"): 1, ("Tree", "MEDIUM"): 1}
    share = {(r.METHOD_RECEIVED, r.PRIORITY): r.Percentage for r in reports.method_priority_share(df).collect()}
    assert share == {("UNKNOWN", "HIGH"): 75.0, ("UNKNOWN", "MEDIUM"): 25.0, ("UNKNOWN", "NORMAL"): 0.0, ("UNKNOWN", "LOW"): 0.0}


def test_count_map(enriched001):
    from servicepulse.plans.payload import count_map
    nested = count_map(metrics.type_category_counts(enriched001), "SR_TYPE", K.CATEGORY_COL).collect()
    assert len(nested) == 10
    assert all(sum(r.counts.values()) > 0 for r in nested)


def test_reports_on_frame_without_roles_raise_clear_errors(spark):
    e = enrich(files.read_csv(spark, CARS))
    for fn in (reports.map_points, metrics.zip_profile, insights.season_volume, metrics.status_counts):
        with pytest.raises(ValueError):
            fn(e)
    assert insights.numeric_profile(e).count() == 10  # first ten numeric columns, booleans excluded


@pytest.mark.parametrize("oversample", [4.0, 0.5])
def test_map_points_equals_brute_force(enriched001, oversample):
    n = 200
    got = sorted(r.SR_ID for r in reports.map_points(enriched001, n=n, oversample=oversample).collect())
    cols = [F.col(f"`{c}`") for c in enriched001.columns if c not in K.ADDED_COLUMNS]
    text = F.concat_ws("|", F.lit(str(K.MAP_SAMPLE_SEED)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    brute = enriched001.where(F.col(K.VALID_COORDS_COL)).withColumn("h", F.md5(text.cast("binary"))).orderBy("h", *cols).limit(n)
    assert got == sorted(r.SR_ID for r in brute.collect())


@pytest.mark.parametrize("kind,expected", [
    ("performance", {"overall", "performance_categories"}),
    ("improvement", {"overall", "request_types"}),
    ("geographic", {"top_zipcodes_by_volume", "zipcode_performance", "top_request_types_by_zipcode"}),
    ("comparative_priority", {"categories"}),
    ("comparative_method", {"categories"}),
    ("comparative_geographic", {"categories", "top_request_types"}),
])
def test_insight_selector_every_kind(enriched001, kind, expected):
    tables = insights.insight_tables(enriched001, kind=kind)
    assert expected <= set(tables)
    for name in expected:
        assert tables[name].count() > 0, (kind, name)


def test_insight_default_set(enriched001):
    tables = insights.insight_tables(enriched001)
    assert {"overall", "top_zipcodes_by_volume", "seasonal_volumes"} <= set(tables)
