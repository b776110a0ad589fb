"""Plan-shape checks: native expressions only, no self-join, pruning."""

import pytest

import __spark_entry__ as E
from request_paths import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E._request_queries()))
def test_no_python_udf(spark, name):
    if name in ("src_csv", "src_features"):
        pytest.skip("writes its input first")
    plan = _plan(E._request_queries()[name](spark, SF001))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


def test_share_of_method_has_no_join(spark):
    plan = _plan(E._request_queries()["priority_by_method"](spark, SF001))
    assert "Window" in plan
    # the only join is the adapter's lineitem-orders join
    assert plan.count("Join") == 1


@pytest.mark.parametrize("name,lineitem,orders", [
    ("category_counts", {"l_orderkey", "l_partkey", "l_quantity", "l_linestatus", "l_shipdate"}, {"o_orderkey"}),
    ("status_counts", {"l_orderkey", "l_linestatus"}, {"o_orderkey"}),
    ("monthly_counts", {"l_orderkey", "l_shipdate"}, {"o_orderkey"}),
    ("top_types", {"l_orderkey", "l_partkey"}, {"o_orderkey"}),
    ("top_zips", {"l_orderkey"}, {"o_orderkey", "o_custkey"}),
    ("priority_distribution", {"l_orderkey"}, {"o_orderkey", "o_orderpriority"}),
])
def test_scan_reads_only_what_the_report_needs(spark, name, lineitem, orders):
    plan = _plan(E._request_queries()[name](spark, SF001))
    import re
    read = [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)]
    assert sorted(map(sorted, read)) == sorted(map(sorted, [lineitem, orders])), read


def test_no_inferred_predicate_on_nonnull_keys(spark, enriched001):
    from servicepulse.plans import goals
    plan = _plan(goals.priority_by_method(enriched001))
    assert "Condition : (CASE" not in plan and "isnotnull(CASE" not in plan.replace(" ", "")


@pytest.mark.parametrize("name", sorted(E._request_queries()))
def test_single_raw_scan_per_plan(spark, name):
    """No final plan reads the fact table twice (aggregates read twice are
    written once and read back)."""
    if name in ("src_csv", "src_features", "stream_category_counts"):
        pytest.skip("reads its own landed files")
    plan = _plan(E._request_queries()[name](spark, SF001))
    assert plan.count("lineitem.parquet") <= 1, name


def test_top_k_semi_join_is_broadcast_when_bounded(spark):
    from servicepulse.operators import topk as TK
    df = spark.range(1000).selectExpr("id % 50 AS k", "id")
    top = TK.top_k(TK.counts(df, ["k"]), "k", 3)
    assert "BroadcastHashJoin" in _plan(TK.semi_join_small(df, top, ["k"], max_rows=3))
    assert "__salt" in _plan(TK.semi_join_small(df, top, ["k"]))  # no bound: never broadcast by hint


def test_two_level_top_n_matches_global(spark):
    from pyspark.sql import functions as F
    from servicepulse.operators import topk as TK
    df = spark.range(0, 50000, 1, 12).select("id", F.xxhash64(F.lit(7), "id").alias("h"))
    order = [F.col("h"), F.col("id")]
    got = TK.top_n(df, order, 500, fan_in=5)
    plan = _plan(got)
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan
    assert [r.id for r in got.collect()] == [r.id for r in df.orderBy(*order).limit(500).collect()]


def test_salted_semi_join_above_bound(spark):
    from servicepulse.operators import topk as TK
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 11 AS STRING) END AS k", "id")
    small = spark.createDataFrame([("hot",), ("4",)], "k string")
    got = sorted(r.id for r in TK.semi_join_small(df, small, ["k"], max_rows=10_000_000).collect())
    want = sorted(r.id for r in df.where("k IN ('hot', '4')").collect())
    assert got == want
