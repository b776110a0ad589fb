"""Statistics behind the narrative insights: request-type detail, geography,
seasons, comparisons and dataset profiles.

Where the original filters the whole frame once per category, these are
single grouped aggregates with conditional aggregates; per-group top-k runs
on the aggregated (group, key, count) table.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import aggs as A
from ..functions import columns as C
from ..operators import topk as TK
from ..operators.heavy_hitters import top_values
from ..operators.median import bracket_stats, bracketed_medians, median_stats
from .common import attach_medians, created_ts, hours, ratio, report_base, resolved, share_of_total, type_col, zip_col
from .metrics import _summary, performance_metrics
from ..session import materialize

# ------------------------------------------------------------ request type


def type_detail(df: DataFrame, request_type: str) -> DataFrame:
    """One row of statistics for one request type (equality match).

    Counts and rates over the type's rows; hours, median and met % over its
    resolved rows; share of all rows.  No row when the type does not occur.
    """
    t = type_col(df)
    sel = C.qcol(t) == F.lit(request_type)
    sel_res = sel & resolved()
    meds = {"median_resolution_hours": F.when(sel_res, hours())}
    base = df.agg(
        F.count_if(sel).alias("count"),
        F.count(F.lit(1)).alias("__total"),
        F.count_if(sel_res).alias("resolved_count"),
        A.avg_where(hours(), sel_res).alias("avg_resolution_hours"),
        F.max(F.when(sel, F.col(K.TARGET_COL))).alias("target_hours"),
        A.met_count(ratio(), sel_res).alias("__met"),
        *median_stats(meds),
    ).where(F.col("count") > 0)
    # The finishing pass reads the type's resolved rows only.
    out = attach_medians(base, df.where(sel_res), [], {"median_resolution_hours": hours()})
    return out.select(
        F.lit(request_type).alias("request_type"),
        "count",
        A.pct(F.col("count"), F.col("__total")).alias("percent_of_total"),
        "resolved_count",
        A.pct(F.col("resolved_count"), F.col("count")).alias("resolution_rate"),
        "avg_resolution_hours",
        "median_resolution_hours",
        "target_hours",
        A.pct(F.col("__met"), F.col("resolved_count")).alias("percent_meeting_target"),
    )


def type_detail_categories(df: DataFrame, request_type: str) -> DataFrame:
    t = type_col(df)
    return TK.counts(df.where(C.qcol(t) == F.lit(request_type)), [K.CATEGORY_COL])


def type_detail_zips(df: DataFrame, request_type: str, k: int = K.TOP_ZIPS_PER_TYPE) -> DataFrame:
    t, z = type_col(df), zip_col(df)
    return TK.top_k(TK.counts(df.where(C.qcol(t) == F.lit(request_type)), [z]), z, k)


def type_detail_months(df: DataFrame, request_type: str) -> DataFrame:
    t = type_col(df)
    sub = df.where(C.qcol(t) == F.lit(request_type)).select(C.month_label(created_ts(df)).alias("month"))
    return TK.counts(sub, ["month"])


# ------------------------------------------------------------ geography


def top_zips(df: DataFrame, k: int = K.TOP_ZIPS) -> DataFrame:
    z = zip_col(df)
    return TK.top_k(TK.counts(df, [z]), z, k)


def zip_performance(df: DataFrame, k: int = K.TOP_ZIPS) -> DataFrame:
    """Mean ratio and met % over resolved rows for the top-k zips by volume;
    zips without a resolved row are left out.  One aggregate, then top-k."""
    z = zip_col(df)
    agg = TK.without_null_keys(df, [z]).groupBy(C.qcol(z)).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(resolved()).alias("__resolved"),
        A.avg_where(ratio(), resolved()).alias("avg_performance_ratio"),
        A.met_pct(ratio(), resolved()).alias("percent_meeting_target"),
    )
    return TK.top_k(agg, z, k).where(F.col("__resolved") > 0).select(z, "avg_performance_ratio", "percent_meeting_target")


def _top_keys_within_top_groups(df: DataFrame, group: str, key: str, k_groups: int, k_keys: int) -> DataFrame:
    """(group, key, count, rank) for the top ``k_keys`` keys inside each of
    the top ``k_groups`` groups.  One pass over the rows: the aggregated
    pairs are written once and both the group totals (rows with a NULL key
    still count towards their group's volume) and the per-group top-k read
    that small table."""
    pairs = materialize(TK.counts(TK.without_null_keys(df, [group]), [group, key], drop_null_keys=False), "pairs")
    totals = pairs.groupBy(group).agg(F.sum("count").alias("count"))
    top = TK.top_k(totals, group, k_groups)
    kept = TK.semi_join_small(TK.without_null_keys(pairs, [key]), top, [group], max_rows=k_groups)
    return TK.top_k_per_group(kept, group, key, k_keys)


def top_types_by_zip(df: DataFrame, k_zips: int = K.TOP_ZIPS, k_types: int = K.TOP_TYPES_PER_ZIP) -> DataFrame:
    return _top_keys_within_top_groups(df, zip_col(df), type_col(df), k_zips, k_types)


# ------------------------------------------------------------ seasons


def _with_season(df: DataFrame) -> DataFrame:
    m = F.month(created_ts(df))
    return df.withColumn("__month", m).withColumn("season", C.season(F.col("__month")))


def month_of_year_volume(df: DataFrame) -> DataFrame:
    s = _with_season(df).where(F.col("__month").isNotNull())
    return s.groupBy(F.col("__month").alias("month")).agg(F.count(F.lit(1)).alias("count"))


def season_volume(df: DataFrame) -> DataFrame:
    """Count per season; all four seasons present, empty ones as 0.

    A global aggregate pivoted on the four fixed labels, then unpivoted."""
    s = _with_season(df).where(F.col("season").isNotNull())
    wide = s.groupBy().pivot("season", list(K.SEASONS)).agg(F.count(F.lit(1)))
    long = wide.unpivot([], list(K.SEASONS), "season", "count")
    return long.select("season", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")).orderBy(C.season_rank(F.col("season")))


def top_types_by_season(df: DataFrame, k: int = K.TOP_TYPES_PER_SEASON) -> DataFrame:
    t = type_col(df)
    pairs = TK.counts(_with_season(df), ["season", t])
    return TK.top_k_per_group(pairs, "season", t, k)


def season_performance(df: DataFrame) -> DataFrame:
    """Mean ratio and met % per season over resolved rows (observed seasons)."""
    s = _with_season(df).where(resolved() & F.col("season").isNotNull())
    return s.groupBy("season").agg(
        F.avg(K.RATIO_COL).alias("avg_performance_ratio"), A.met_pct(ratio()).alias("percent_meeting_target")
    )


# ------------------------------------------------------------ comparisons


def _compare(df: DataFrame, key: str, k: Optional[int] = None) -> DataFrame:
    """Per key: count, share of all rows, mean/median hours, resolution
    rate, mean ratio, met % -- all rows.  With ``k`` only the top-k keys by
    volume are kept (the share still uses every row as denominator); the
    median's finishing pass then only keeps rows of those groups."""
    meds = {"median_resolution_hours": hours()}
    agg = df.groupBy(C.qcol(key)).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(K.HOURS_COL).alias("avg_resolution_hours"),
        A.rate(resolved()).alias("resolution_rate"),
        F.avg(K.RATIO_COL).alias("avg_performance_ratio"),
        A.met_pct(ratio()).alias("percent_meeting_target"),
        *median_stats(meds),
    )
    agg = TK.without_null_keys(share_of_total(agg, "count"), [key])
    if k is not None:
        agg = TK.top_k(agg, key, k)  # total order (count desc, key): deterministic over the written table
    out = attach_medians(agg, df, [key], meds, written=True)
    return out.select(
        key, "count", "percent_of_total", "avg_resolution_hours", "median_resolution_hours", "resolution_rate",
        "avg_performance_ratio", "percent_meeting_target",
    )


def compare_priority(df: DataFrame) -> DataFrame:
    return _compare(df, K.PRIORITY_COL).orderBy(C.priority_rank(F.col(K.PRIORITY_COL)))


def compare_type(df: DataFrame, k: int = K.TOP_TYPES) -> DataFrame:
    return _compare(df, type_col(df), k)


def compare_zip(df: DataFrame, k: int = K.TOP_ZIPS) -> DataFrame:
    return _compare(df, zip_col(df), k)


def compare_zip_types(df: DataFrame, k_zips: int = K.TOP_ZIPS, k_types: int = K.TOP_TYPES_PER_COMPARED_ZIP) -> DataFrame:
    return _top_keys_within_top_groups(df, zip_col(df), type_col(df), k_zips, k_types)


def compare_method(df: DataFrame) -> DataFrame:
    return _compare(df, K.METHOD_COL).orderBy(F.col("count").desc(), F.col(K.METHOD_COL))


# ------------------------------------------------------------ dataset profile

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def dataset_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and the column list (comma separated)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(",".join(df.columns)).alias("column_list")
    )


def numeric_profile(df: DataFrame, max_columns: int = K.PROFILE_NUMERIC_COLUMNS) -> DataFrame:
    """Mean, median, min, max of the first numeric columns (booleans are not
    numeric), one row per column.  One wide aggregate holds the statistics of
    all columns and a bracket of each median; the second pass over the rows
    keeps the values inside the brackets only (``median.bracketed_medians``)."""
    cols = numeric_columns(df)[:max_columns]
    if not cols:
        raise ValueError("no numeric column")
    values = {c: C.qcol(c).cast("double") for c in cols}
    own = [f(v).alias(f"{n}{i}") for i, v in enumerate(values.values()) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    row = df.agg(*own, *bracket_stats(values)).first()
    meds = bracketed_medians(df, values, row)
    rows = [(c, row[f"mean{i}"], meds.get(c), row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_name string, mean double, median double, min double, max double")


def categorical_profile(df: DataFrame, max_columns: int = K.PROFILE_CATEGORICAL_COLUMNS, k: int = K.PROFILE_TOP_VALUES) -> DataFrame:
    """Top-k values (with counts) of each of the first string columns, by a
    sketch of each and exact counts of its candidates (``heavy_hitters``)."""
    cols = string_columns(df)[:max_columns]
    if not cols:
        raise ValueError("no string column")
    return top_values(df, cols, k)


def preview_rows(df: DataFrame, n: int = K.PREVIEW_ROWS, order_by: Optional[list[str]] = None) -> DataFrame:
    """First ``n`` rows in a stable order (all columns ascending by default)."""
    keys = order_by or df.columns
    return df.orderBy(*[C.qcol(c).asc_nulls_first() for c in keys]).limit(n)


# ------------------------------------------------------------ selector

KINDS = ("performance", "geographic", "seasonal", "improvement", "comparative_priority", "comparative_request_type",
         "comparative_geographic", "comparative_method")


def _geographic(df: DataFrame) -> dict[str, DataFrame]:
    return {"top_zipcodes_by_volume": top_zips(df), "zipcode_performance": zip_performance(df),
            "top_request_types_by_zipcode": top_types_by_zip(df)}


def _seasonal(df: DataFrame) -> dict[str, DataFrame]:
    return {"monthly_volumes": month_of_year_volume(df), "seasonal_volumes": season_volume(df),
            "top_request_types_by_season": top_types_by_season(df), "seasonal_performance": season_performance(df)}


def insight_tables(
    df: DataFrame,
    kind: Optional[str] = None,
    request_type: Optional[str] = None,
    custom_question: Optional[str] = None,
) -> dict[str, DataFrame]:
    """Statistics tables for one insight request.

    Precedence: a custom question (dataset profile and the summary metrics) >
    an analysis kind > a request type > the default set (performance,
    geographic, seasonal, improvement).  ``performance`` and ``improvement``
    carry the summary metrics.  The comparison kind is the whole suffix after
    ``comparative_``.
    """
    if custom_question:
        return {
            "dataset_shape": dataset_shape(df),
            "data_sample": preview_rows(df),
            "numeric_stats": numeric_profile(df),
            "categorical_distributions": categorical_profile(df),
            **performance_metrics(df),
        }
    if kind:
        if kind in ("performance", "improvement"):
            return performance_metrics(df)
        if kind == "geographic":
            return _geographic(report_base(df))
        if kind == "seasonal":
            return _seasonal(report_base(df))
        if kind.startswith("comparative_"):
            which = kind[len("comparative_"):]
            if which == "priority":
                return {"categories": compare_priority(df)}
            if which == "request_type":
                return {"categories": compare_type(df)}
            if which == "geographic":
                return {"categories": compare_zip(df), "top_request_types": compare_zip_types(df)}
            if which == "method":
                return {"categories": compare_method(df)}
        raise ValueError(f"unknown analysis kind: {kind}")
    if request_type:
        return {"request_type": type_detail(df, request_type),
                "performance_categories": type_detail_categories(df, request_type),
                "top_zipcodes": type_detail_zips(df, request_type),
                "monthly_counts": type_detail_months(df, request_type)}
    base = report_base(df)
    return {**_summary(base), **_geographic(base), **_seasonal(base)}
