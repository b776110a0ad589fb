"""One clock, roles carried through, one pass over the input, restartable streams."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from request_paths import SF001, local_dir
from servicepulse import constants as K
from servicepulse.operators.classify import enrich
from servicepulse.operators.median import grouped_medians
from servicepulse.operators.standardise import coerce_dates
from servicepulse.plans import goals, insights, metrics, reports
from servicepulse.session import scratch_path, scratch_scope
from servicepulse.sources.tables import AS_OF, requests_from_tables
from servicepulse.streaming import stream

HOURS, RATIO = K.HOURS_COL, K.RATIO_COL
MEDIANS = [
    (goals.priority_goals, K.PRIORITY_COL, HOURS, "median_resolution_hours"),
    (goals.method_goals, K.METHOD_COL, HOURS, "median_resolution_hours"),
    (insights.compare_priority, K.PRIORITY_COL, HOURS, "median_resolution_hours"),
    (insights.compare_type, "SR_TYPE", HOURS, "median_resolution_hours"),
    (insights.compare_zip, "ZIP_CODE", HOURS, "median_resolution_hours"),
    (insights.compare_method, K.METHOD_COL, HOURS, "median_resolution_hours"),
    (reports.performance_by_method, K.METHOD_COL, RATIO, "median_performance_ratio"),
    (reports.priority_performance, K.PRIORITY_COL, RATIO, "median_performance"),
]


@pytest.fixture(scope="module")
def open_now(spark):
    """Mostly open tickets, aged to the present instant."""
    rows = [("Pothole" if i % 2 else "Tree", f"2024-0{i % 9 + 1}-01 0{i % 10}:00:00", None if i % 5 else "2024-12-01 00:00:00", str(i % 4 + 1),
             ["Phone", "Web"][i % 2], f"3310{i % 3}") for i in range(60)]
    raw = spark.createDataFrame(rows, "SR_TYPE string, CREATED_DATE string, CLOSED_DATE string, SR_PRIORITY string, METHOD string, ZIP_CODE string")
    return enrich(raw)


@pytest.mark.parametrize("report,key,value,name", MEDIANS)
def test_medians_with_the_default_clock(open_now, report, key, value, name):
    want = {r[0]: r[1] for r in open_now.groupBy(key).agg(F.median(value)).collect()}
    got = {r[0]: r[name] for r in report(open_now).collect()}
    assert got and all(v is not None and v == pytest.approx(want[k]) for k, v in got.items())


def test_other_medians_with_the_default_clock(open_now):
    months = {r.month: r.median_resolution_hours for r in goals.performance_over_time(open_now).collect()}
    want = {r[0]: r[1] for r in open_now.groupBy(F.date_format("CREATED_DATE", "yyyy-MM")).agg(F.median(HOURS)).collect()}
    assert months == pytest.approx(want)
    grid = {(r.SR_TYPE, r[K.PRIORITY_COL]): r.median_perf for r in reports.type_priority_grid(open_now).collect() if r["count"]}
    cells = {(r[0], r[1]): r[2] for r in open_now.groupBy("SR_TYPE", K.PRIORITY_COL).agg(F.median(RATIO)).collect()}
    assert grid == pytest.approx(cells)
    profile = {r.column_name: r["median"] for r in insights.numeric_profile(open_now).collect()}
    assert profile[HOURS] == pytest.approx(open_now.agg(F.median(HOURS)).first()[0])


def test_overrides_hold_in_every_step(spark):
    raw = spark.createDataFrame(
        [("Pothole", "2024-01-01", "2024-01-02", "1", "x"), ("Tree", "2024-02-01", None, "2", "y")], "what string, opened_on string, done_on string, SR_PRIORITY string, area string")
    e = enrich(raw, as_of="2024-03-01", created="opened_on", closed="done_on", request_type="what", zip="area")
    rows = {r.what: r for r in e.collect()}
    assert rows["Pothole"][HOURS] == 24.0 and rows["Pothole"][K.RESOLVED_COL] and rows["Pothole"][K.TARGET_COL] == 72
    assert {r.month: r["count"] for r in metrics.monthly_counts(e).collect()} == {"2024-01": 1, "2024-02": 1}
    assert {r.what for r in metrics.type_profile(e).collect()} == {"Pothole", "Tree"}
    assert {r.area for r in insights.top_zips(e.where("what is not null")).collect()} == {"x", "y"}
    only = enrich(raw.withColumnRenamed("done_on", "CLOSED_DATE"), as_of="2024-03-01", created="opened_on")
    assert sorted(r[HOURS] for r in only.collect()) == [24.0, 29 * 24.0]
    with pytest.raises(ValueError):
        enrich(raw, created="nope")


@pytest.mark.parametrize("text,want", [
    ("1/5/2024 3:07 PM", "2024-01-05 15:07:00"), ("Jan 5, 2024", "2024-01-05 00:00:00"), ("05-Jan-2024", "2024-01-05 00:00:00"),
    ("2024-01-05 03:07 PM", "2024-01-05 15:07:00"), ("1-5-2024 15:07", "2024-01-05 15:07:00"), ("2024-01-05T03:07:00+05:00", "2024-01-05 03:07:00"), ("junk", None)])
def test_date_forms(spark, text, want):
    got = coerce_dates(spark.createDataFrame([(text,)], "CREATED_DATE string")).select(F.date_format("CREATED_DATE", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


def test_fractional_epoch_dates(spark):
    df = spark.createDataFrame([(1704467220000.0, 1704470820000), (float("nan"), None)], "CREATED_DATE double, CLOSED_DATE long")
    df = df.withColumn("CLOSED_DATE", F.col("CLOSED_DATE").cast("decimal(20,2)"))
    assert [r[HOURS] for r in enrich(df, as_of="2024-03-01").collect()] == [1.0, None]


def test_infinite_values_narrow(spark):
    rows = [("g", v) for v in [float("-inf")] * 40 + [float("inf")] * 50 + [1e308, -1e308, 1.0, 2.0, 3.0] * 11]
    df = spark.createDataFrame(rows, "g string, v double")
    import numpy as np
    assert grouped_medians(df, ["g"], {"m": "v"}, finish_at=3, bins=4).first().m == float(np.median([v for _, v in rows]))


class Reads:
    """Counts the written intermediate tables whose plan reads the raw input."""

    def __init__(self, monkeypatch):
        from servicepulse import session
        from servicepulse.operators import median
        from servicepulse.plans import common, insights, metrics, reports

        self.n, plain = 0, session.materialize

        def counted(df, name="state"):
            self.n += "lineitem.parquet" in df._jdf.queryExecution().executedPlan().toString()
            return plain(df, name)

        for module in (median, common, metrics, insights, reports):
            monkeypatch.setattr(module, "materialize", counted)


def _raw_scans(monkeypatch, build) -> int:
    reads = Reads(monkeypatch)
    tables = build()
    return reads.n + sum("lineitem.parquet" in t._jdf.queryExecution().executedPlan().toString() for t in tables.values())


def test_report_sets_read_the_input_once(enriched001, monkeypatch):
    assert _raw_scans(monkeypatch, lambda: metrics.performance_metrics(enriched001)) == 1
    assert _raw_scans(monkeypatch, lambda: insights.insight_tables(enriched001)) == 1


def test_narrowing_reads_the_input_once_more(enriched001, monkeypatch):
    build = lambda: {"m": grouped_medians(enriched001, [K.PRIORITY_COL], {"m": HOURS}, finish_at=50, bins=16)}
    assert _raw_scans(monkeypatch, build) == 2


def test_monthly_table_runs_no_median(enriched001, monkeypatch):
    assert _raw_scans(monkeypatch, lambda: {"t": goals.monthly_table(enriched001)}) == 1


def test_custom_question_has_the_metrics(enriched001):
    tables = insights.insight_tables(enriched001, custom_question="why")
    assert {"dataset_shape", "numeric_stats", "overall", "performance_categories"} <= set(tables)


def test_goal_rows_come_in_priority_order(enriched001):
    assert [r[0] for r in goals.priority_goals(enriched001).collect()] == ["HIGH", "MEDIUM", "NORMAL", "LOW"]


def test_restarted_stream_goes_on(spark):
    src, out = (local_dir(scratch_path(spark, n)) for n in ("restart-in", "restart-out"))
    raw = requests_from_tables(spark, SF001)
    for part in (0, 1):
        raw.where(F.col("SR_ID") % 2 == part).write.mode("append").parquet(src)
        s = stream.enrich_stream(stream.read_ticket_stream(spark, src, raw.schema, fmt="parquet"), as_of=AS_OF)
        stream.start(s, out, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == raw.count()


def test_scratch_scope_deletes_its_tables(spark):
    from servicepulse.session import materialize
    with scratch_scope(spark):
        path = materialize(spark.range(3), "gone").inputFiles()[0]
    assert not os.path.exists(local_dir(path.replace("file://", "file:")))


@pytest.mark.parametrize("one_in", [1024, 16, 3])
def test_first_rows_beyond_the_group_limit(spark, one_in):
    from servicepulse.operators import topk
    df = spark.range(40_000).select(
        F.when(F.col("id") % 9 != 0, F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") * 37 % 1000).cast("string")).alias("b"),
        F.timestamp_add("DAY", (F.col("id") % 300).cast("int"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("t"), (F.col("id") * 1.5).alias("d"), "id")
    keys = ["a", "b", "t", "d", "id"]
    want = df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(5000).collect()
    assert topk.first_rows(df, keys, 5000, one_in=one_in).collect() == want
