"""

Every query reads the whole ``lineitem``/``orders`` tables through the
request adapter (``servicepulse.sources.tables``), runs the library on that
input and returns a DataFrame.  Double outputs are rounded to 6 places on
both sides so that summation-order noise does not break the value hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicepulse import constants as K
from servicepulse.functions import columns as C
from servicepulse.operators import resolution, standardise as S
from servicepulse.operators.classify import classify, enrich
from servicepulse.operators.median import grouped_medians
from servicepulse.plans import goals, insights as I, metrics as M, monthly_state, payload, reports as R
from servicepulse.plans.common import report_base
from servicepulse.session import map_arrow, materialize, scratch_path
from servicepulse.sources import files
from servicepulse.sources.csv_tables import load_csv
from servicepulse.sources.tables import AS_OF, adapter_sql, requests_from_tables
from servicepulse.streaming import stream

try:  # the text-corpus operators are optional
    import corpus_pipeline
    from servicepulse.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

FLAGSHIP_SF = "/root/testdata/sf0.001"
DIGITS = 6


def _round(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.round(c, DIGITS).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*cols)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(requests_from_tables(spark, sf_dir), as_of=AS_OF)


def _q(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(fn(_enriched(spark, sf_dir)))

    run.__doc__ = fn.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: goal achievement by priority on sf0.001."""
    return _round(goals.priority_goals(_enriched(spark, FLAGSHIP_SF)))


DETAIL_TYPE = "Graffiti"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_tables(spark, sf_dir)


def _std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.standardise(_raw(spark, sf_dir))


def _grouped(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return scratch_path(spark, f"input-{what}")


def q_src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV source end to end: the request table written as CSV files, read
    back with header + type inference, enriched; category counts."""
    path = _scratch(spark, "csv")
    _raw(spark, sf_dir).write.option("header", "true").csv(path)
    df = files.read_csv_dir(spark, path)
    return M.category_counts(enrich(df, as_of=AS_OF))


def _csv_of_three_headers(spark: SparkSession, sf_dir: str) -> str:
    """The request table as CSV files of three headers: as it is; reversed, with a column more; sorted, with one less."""
    path = _scratch(spark, "csv-headers")
    raw = _raw(spark, sf_dir)
    third = F.pmod("SR_ID", F.lit(3))
    shapes = (raw.columns, ["EXTRA", *reversed(raw.columns)], sorted(c for c in raw.columns if c != "STATUS"))
    for i, columns in enumerate(shapes):
        raw.where(third == i).withColumn("EXTRA", F.lit("late")).select(*columns).write.mode("append").option("header", "true").csv(path)
    return path


def q_src_csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV folder whose files order their columns differently, have one more or one less; a number column holds some text."""
    df = files.read_csv_dir(spark, _csv_of_three_headers(spark, sf_dir))
    return df.groupBy("STATUS", "ZIP_CODE", "SR_TYPE", "EXTRA").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("SR_ID").cast("long")).alias("ids"), F.count_if(F.col("latitude") == "bad").alias("bad_latitudes"))


def q_csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found by the one read of such a folder, and the values of each column that are no plain text."""
    return load_csv(spark, _csv_of_three_headers(spark, sf_dir), "*.csv").report()


def _feature_of(raw: DataFrame) -> Column:
    """A ticket as an element of a feature collection: dates as epoch milliseconds, coordinates as geometry."""
    attrs = [c for c in raw.columns if c not in ("latitude", "longitude")]
    millis = {c: C.ntz_to_epoch_millis(F.col(c)) for c in ("CREATED_DATE", "CLOSED_DATE")}
    return F.struct(
        F.struct(*[(millis[c] if c in millis else F.col(c)).alias(c) for c in attrs]).alias("attributes"),
        F.struct(C.to_double(F.col("longitude")).alias("x"), C.to_double(F.col("latitude")).alias("y")).alias("geometry"),
    )


def q_src_features_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large feature documents end to end: each partition of the request table written as one document over
    many lines, read by byte ranges, enriched; category counts."""
    path = _scratch(spark, "feature-documents")
    raw = _raw(spark, sf_dir)

    def document(batches):
        yield pa.RecordBatch.from_pydict({"value": ['{"fields": [{"attributes": {"SR_ID": 0}}],', '"features": [']})
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(b.column(0), "", ",")], names=["value"])
        yield pa.RecordBatch.from_pydict({"value": ["null]}"]})

    map_arrow(raw.select(F.to_json(_feature_of(raw)).alias("value")), document, "value string").write.text(path)
    return M.category_counts(enrich(files.read_features(spark, path), as_of=AS_OF))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as text to collections of 1000 consecutive ones (the last one holds the rest)."""
    rest = pa.array([], pa.string())

    def page(features: pa.Array) -> str:
        return '{"features":[' + ",".join(features.to_pylist()) + "]}"

    for b in batches:
        rest = pa.concat_arrays([rest, b.column(0).cast(pa.string())])
        full = len(rest) // 1000 * 1000
        yield pa.RecordBatch.from_pydict({"value": pa.array([page(rest[i : i + 1000]) for i in range(0, full, 1000)], pa.string())})
        rest = rest[full:]
    if len(rest):
        yield pa.RecordBatch.from_pydict({"value": [page(rest)]})


def q_src_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-collection source end to end: the request table written as
    paged feature-collection JSON (dates as epoch milliseconds, coordinates
    as geometry), flattened, enriched; category counts."""
    path = _scratch(spark, "features")
    raw = _raw(spark, sf_dir)
    # Pages of at most 1000 consecutive rows of one input partition, put together where the rows are.
    pages = map_arrow(raw.select(F.to_json(_feature_of(raw)).alias("value")), _pages, "value string")
    pages.write.option("maxRecordsPerFile", 500).option("compression", "gzip").text(path)
    df = files.read_features(spark, path, multi_line=False)
    return M.category_counts(enrich(df, as_of=AS_OF))


def q_stream_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming end to end: the request table lands as Parquet
    files in a folder, is read as a file stream, enriched row by row and
    appended to a Parquet sink (exactly-once, checkpointed); the landed
    table is then counted per category."""
    src, out = _scratch(spark, "stream-in"), _scratch(spark, "stream-out")
    raw = _raw(spark, sf_dir)
    raw.write.parquet(src)
    s = stream.read_ticket_stream(spark, src, raw.schema, fmt="parquet")
    q = stream.start(stream.enrich_stream(s, as_of=AS_OF), out, fmt="parquet", available_now=True)
    q.awaitTermination()
    return M.category_counts(spark.read.parquet(out))


def q_limit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 1000 request records in a stable order."""
    return files.limit_records(_raw(spark, sf_dir), K.DEFAULT_RECORD_LIMIT)


def _us_text(ts) -> "Column":
    """``MM/dd/yyyy hh:mm:ss AM`` text of a zone-less timestamp, built from its
    date and its ISO text so no session time zone is involved."""
    iso = ts.cast("string")
    hour = F.substring(iso, 12, 2).cast("int")
    h12 = F.pmod(hour + F.lit(11), F.lit(12)) + F.lit(1)
    return F.format_string(
        "%s %02d:%s:%s %s", F.date_format(ts.cast("date"), "MM/dd/yyyy"), h12, F.substring(iso, 15, 2),
        F.substring(iso, 18, 2), F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")),
    )


def q_coerce_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date coercion of text dates written the way a 311 CSV export writes them."""
    raw = _raw(spark, sf_dir)
    text = raw.withColumns({c: _us_text(F.col(c)) for c in ("CREATED_DATE", "CLOSED_DATE")})
    return S.coerce_dates(text).select("SR_ID", "CREATED_DATE", "CLOSED_DATE")


def q_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text dates with an offset or zone letter (dropped, the wall clock stays), in ISO and three other forms, and junk."""
    raw = _raw(spark, sf_dir)

    def written(c: str) -> Column:
        ts = F.col(c)
        iso, kind = ts.cast("string"), F.col("SR_ID") % 7
        day, clock = F.substring(iso, 1, 10), F.substring(iso, 12, 8)
        return (
            F.when(kind == 0, F.concat(day, F.lit("T"), clock, F.lit("+05:00"))).when(kind == 1, F.concat(day, F.lit(" "), clock, F.lit("-03:30")))
            .when(kind == 2, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(kind == 3, F.concat(F.translate(day, "-", "/"), F.lit(" "), clock))
            .when(kind == 4, F.concat(F.date_format(ts.cast("date"), "d-MMM-yyyy "), clock)).when(kind == 5, F.lit("soon")).otherwise(_us_text(ts)))

    text = raw.withColumns({c: written(c) for c in ("CREATED_DATE", "CLOSED_DATE")})
    return S.coerce_dates(text).select("SR_ID", "CREATED_DATE", "CLOSED_DATE")


def q_no_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets without date columns: no hours, nothing resolved, no age column."""
    e = enrich(_raw(spark, sf_dir).drop("CREATED_DATE", "CLOSED_DATE"), as_of=AS_OF)
    return e.groupBy(K.CATEGORY_COL, K.RESOLVED_COL).agg(
        F.count(F.lit(1)).alias("count"), F.count(K.HOURS_COL).alias("with_hours"), F.lit(K.AGE_COL in e.columns).alias("has_age"))


def q_no_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets without a type column: one constant type and the default target."""
    e = enrich(_raw(spark, sf_dir).drop("SR_TYPE"), as_of=AS_OF)
    return e.groupBy("SR_TYPE", K.TARGET_COL, K.CATEGORY_COL).agg(F.count(F.lit(1)).alias("count"))


def q_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every priority value, canonical or as written, in the ordinal order."""
    seen = _std(spark, sf_dir).select(F.explode(F.array(K.PRIORITY_COL, F.upper("SR_PRIORITY"))).alias("value")).where("value is not null").distinct()
    return seen.select("value", C.priority_rank(F.col("value")).alias("place"))


def q_insight_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables each kind of insight gives, in order of precedence, and the tickets that the volume tables hold."""
    e = report_base(_enriched(spark, sf_dir))
    picks = [("geographic", {"kind": "geographic"}), ("seasonal", {"kind": "seasonal"}), ("method", {"kind": "comparative_method"}), ("priority", {"kind": "comparative_priority"}),
             ("kind over type", {"kind": "comparative_geographic", "request_type": DETAIL_TYPE}), ("type", {"request_type": DETAIL_TYPE})]
    out = None
    for name, args in picks:
        for table, df in I.insight_tables(e, **args).items():
            held = F.sum("count") if "count" in df.columns else F.lit(None)
            row = df.agg(F.count(F.lit(1)).alias("rows"), held.cast("long").alias("tickets")).select(F.lit(name).alias("pick"), F.lit(table).alias("table_name"), "rows", "tickets")
            out = row if out is None else out.unionByName(row)
    return out


def q_reuse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV folder loaded twice, then with one more file: the second load reads the first one's table, the third does not."""
    path = _scratch(spark, "csv-reuse")
    raw = materialize(_raw(spark, sf_dir), "requests")  # written twice below, joined once
    raw.write.option("header", "true").csv(path)
    loads = [load_csv(spark, path, "*.csv"), load_csv(spark, path, "*.csv")]
    raw.write.mode("append").option("header", "true").csv(path)
    loads.append(load_csv(spark, path, "*.csv"))
    first = set(loads[0].rows.inputFiles())
    out = None
    for i, t in enumerate(loads, 1):
        row = _grouped(t.rows, "STATUS").withColumns({"load": F.lit(i), "same_table": F.lit(set(t.rows.inputFiles()) == first)})
        out = row if out is None else out.unionByName(row)
    return out


def q_monthly_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly report of a state that got the tickets in three batches, one of them twice: first half, then whole."""
    folder, e = _scratch(spark, "monthly-state"), _enriched(spark, sf_dir)
    batch = F.pmod("SR_ID", F.lit(3))
    monthly_state.add_batch(e.where((batch == 1) & (F.col("SR_ID") % 2 == 0)), folder, "b1")
    for i in range(3):
        monthly_state.add_batch(e.where(batch == i), folder, f"b{i}")
    return _round(monthly_state.monthly_report(spark, folder))


def q_infer_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority inferred from an emergency flag column (no priority column)."""
    return _grouped(S.standardise(requests_from_tables(spark, sf_dir, emergency_flag=True)), K.PRIORITY_COL)


def q_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type profiles as JSON lines, fractions with four fixed decimals."""
    return payload.to_json_lines(M.type_profile(_enriched(spark, sf_dir)), decimals=4)


def q_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept when every seventh ticket has lost all its values."""
    raw = _raw(spark, sf_dir)
    holed = raw.select(*[F.when(F.col("SR_ID") % 7 != 0, F.col(c)).alias(c) for c in raw.columns])
    return S.standardise(S.drop_empty_rows(holed)).agg(F.count(F.lit(1)).alias("rows"), F.count("SR_ID").alias("ids"))


_RENAMED = {"CREATED_DATE": "opened_on", "CLOSED_DATE": "done_on", "SR_TYPE": "what", "ZIP_CODE": "area", "STATUS": "state"}


def q_role_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zip profile of tickets whose columns have names that no rule finds, with their roles given."""
    raw = _raw(spark, sf_dir).withColumnsRenamed(_RENAMED)
    roles = {"created": "opened_on", "closed": "done_on", "request_type": "what", "zip": "area", "status": "state"}
    return _round(M.zip_profile(enrich(raw, as_of=AS_OF, **roles)))


def q_median_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median hours per priority with the narrowing rounds forced (16 buckets, 50 values at the end)."""
    df = _enriched(spark, sf_dir)
    return _round(grouped_medians(df, [K.PRIORITY_COL], {"median_hours": F.col(K.HOURS_COL), "median_ratio": F.col(K.RATIO_COL)}, bins=16, finish_at=50))


#: Columns that choose the map sample, and its full order (as in the oracle).
MAP_IDS = ["SR_ID", "SR_TYPE", "SR_PRIORITY", "METHOD_RAW", "STATUS", "ZIP_CODE"]


def q_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.map_points(_enriched(spark, sf_dir), id_cols=MAP_IDS))


def _std_q(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(fn(_std(spark, sf_dir)))

    return run


def _detail(fn):
    return lambda df: fn(df, DETAIL_TYPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = _request_queries()
    if llm_queries is not None:
        out |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return out


def _request_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources
        "src_csv": q_src_csv,
        "src_csv_headers": q_src_csv_headers,
        "csv_types": q_csv_types,
        "src_features": q_src_features,
        "src_features_document": q_src_features_document,
        "limit_records": q_limit_records,
        "stream_category_counts": q_stream_category_counts,
        "preview_rows": _q(I.preview_rows),
        "payload_json": q_payload_json,
        # standardise
        "coerce_dates": q_coerce_dates,
        "text_dates": q_text_dates,
        "no_dates": q_no_dates,
        "no_type": q_no_type,
        "priority_order": q_priority_order,
        "insight_selector": q_insight_selector,
        "reuse_table": q_reuse_table,
        "monthly_state": q_monthly_state,
        "infer_priority": q_infer_priority,
        "canon_priority": _std_q(lambda d: _grouped(d, "SR_PRIORITY", K.PRIORITY_COL)),
        "canon_method": _std_q(lambda d: _grouped(d, "METHOD_RAW", K.METHOD_COL)),
        "valid_coords": _std_q(lambda d: _grouped(d, K.VALID_COORDS_COL)),
        "drop_empty": q_drop_empty,
        "role_overrides": q_role_overrides,
        "median_narrowed": q_median_narrowed,
        "standardise": _std_q(lambda d: d),
        # resolution time, targets, classification
        "resolution_hours": _std_q(lambda d: resolution.with_resolution(d, AS_OF).select(
            "SR_ID", "CREATED_DATE", "CLOSED_DATE", K.HOURS_COL, K.RESOLVED_COL)),
        "ticket_age": _std_q(lambda d: resolution.ticket_age(d, AS_OF).select("SR_ID", "CREATED_DATE", K.AGE_COL)),
        "target_hours": _std_q(lambda d: _grouped(classify(resolution.with_resolution(d, AS_OF)), "SR_TYPE", K.TARGET_COL)),
        "performance_category": _q(lambda d: _grouped(d, K.CATEGORY_COL, K.RESOLVED_COL)),
        "enrich": _q(lambda d: d),
        # summary metrics
        "overall_metrics": _q(M.overall_metrics),
        "status_counts": _q(M.status_counts),
        "category_counts": _q(M.category_counts),
        "type_profile": _q(M.type_profile),
        "type_category_counts": _q(M.type_category_counts),
        "zip_profile": _q(M.zip_profile),
        "monthly_counts": _q(M.monthly_counts),
        "monthly_performance": _q(M.monthly_performance),
        # goal reports
        "priority_goals": _q(goals.priority_goals),
        "method_goals": _q(goals.method_goals),
        "priority_by_method": _q(goals.priority_by_method),
        "performance_over_time": _q(goals.performance_over_time),
        # insight statistics
        "type_detail": _q(_detail(I.type_detail)),
        "type_detail_categories": _q(_detail(I.type_detail_categories)),
        "type_detail_zips": _q(_detail(I.type_detail_zips)),
        "type_detail_months": _q(_detail(I.type_detail_months)),
        "top_zips": _q(I.top_zips),
        "zip_performance": _q(I.zip_performance),
        "top_types_by_zip": _q(I.top_types_by_zip),
        "month_of_year_volume": _q(I.month_of_year_volume),
        "season_volume": _q(I.season_volume),
        "top_types_by_season": _q(I.top_types_by_season),
        "season_performance": _q(I.season_performance),
        "compare_priority": _q(I.compare_priority),
        "compare_type": _q(I.compare_type),
        "compare_zip": _q(I.compare_zip),
        "compare_zip_types": _q(I.compare_zip_types),
        "compare_method": _q(I.compare_method),
        "dataset_shape": _q(I.dataset_shape),
        "numeric_profile": _q(I.numeric_profile),
        "categorical_profile": _q(I.categorical_profile),
        # report tables
        "priority_distribution": _q(R.priority_distribution),
        "priority_by_type": _q(R.priority_by_type),
        "method_distribution": _q(R.method_distribution),
        "performance_by_method": _q(R.performance_by_method),
        "priority_performance": _q(R.priority_performance),
        "map_points": q_map_points,
        "type_priority_grid": _q(R.type_priority_grid),
        "method_priority_share": _q(R.method_priority_share),
        "method_priority_met": _q(R.method_priority_met),
        "monthly_table": _q(goals.monthly_table),
        "top_types": _q(R.top_types),
    }


# ---------------------------------------------------------------- oracles
# Shared CTEs: raw (adapter) -> std (standardise) -> enr (resolution, classify).

_PRIORITY_CASE = (
    "CASE upper(CAST({c} AS VARCHAR)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PRIORITY_MAP.items())
    + " ELSE 'NORMAL' END"
)

_STD_SQL = """std AS (
  SELECT SR_ID, COALESCE(SR_TYPE, 'UNKNOWN') AS SR_TYPE, {prio_src}, METHOD_RAW, STATUS, ZIP_CODE,
    CREATED_DATE, CLOSED_DATE,
    CASE WHEN isnan(TRY_CAST(latitude AS DOUBLE)) THEN NULL ELSE TRY_CAST(latitude AS DOUBLE) END AS latitude,
    CASE WHEN isnan(TRY_CAST(longitude AS DOUBLE)) THEN NULL ELSE TRY_CAST(longitude AS DOUBLE) END AS longitude,
    {prio} AS PRIORITY,
    CASE WHEN contains(upper(METHOD_RAW), 'PHONE') THEN 'PHONE'
         WHEN contains(upper(METHOD_RAW), 'WEB') THEN 'WEB'
         WHEN contains(upper(METHOD_RAW), 'APP') THEN 'MOBILE APP'
         WHEN contains(upper(METHOD_RAW), 'MOBILE') THEN 'MOBILE APP'
         WHEN contains(upper(METHOD_RAW), 'EMAIL') THEN 'OTHER'
         WHEN contains(upper(METHOD_RAW), 'WALK-IN') THEN 'WALK-IN'
         WHEN contains(upper(METHOD_RAW), 'WALKIN') THEN 'WALK-IN'
         WHEN contains(upper(METHOD_RAW), 'IN-PERSON') THEN 'WALK-IN'
         WHEN contains(upper(METHOD_RAW), 'COUNTER') THEN 'WALK-IN'
         WHEN contains(upper(METHOD_RAW), 'FAX') THEN 'OTHER'
         WHEN contains(upper(METHOD_RAW), 'MAIL') THEN 'OTHER'
         WHEN contains(upper(METHOD_RAW), 'OTHER') THEN 'OTHER'
         ELSE 'UNKNOWN' END AS METHOD_RECEIVED,
    COALESCE(TRY_CAST(latitude AS DOUBLE) > 25.0 AND TRY_CAST(latitude AS DOUBLE) < 26.5
             AND TRY_CAST(longitude AS DOUBLE) > -81.0 AND TRY_CAST(longitude AS DOUBLE) < -80.0, false) AS has_valid_coords
  FROM raw)"""

_RES_SQL = """res AS (
  SELECT *,
    CASE WHEN CLOSED_DATE IS NOT NULL THEN date_diff('microsecond', CREATED_DATE, CLOSED_DATE) / 3.6e9
         ELSE date_diff('microsecond', CREATED_DATE, TIMESTAMP '{as_of}') / 3.6e9 END AS resolution_hours,
    CLOSED_DATE IS NOT NULL AS is_resolved,
    date_diff('microsecond', CREATED_DATE, TIMESTAMP '{as_of}') / 3.6e9 AS hours_since_creation,
    CASE WHEN contains(upper(SR_TYPE), 'POTHOLE') THEN 72 WHEN contains(upper(SR_TYPE), 'STREETLIGHT') THEN 120
         WHEN contains(upper(SR_TYPE), 'TRAFFIC SIGNAL') THEN 24 WHEN contains(upper(SR_TYPE), 'GRAFFITI') THEN 168
         WHEN contains(upper(SR_TYPE), 'TRASH') THEN 48 WHEN contains(upper(SR_TYPE), 'WATER LEAK') THEN 24
         WHEN contains(upper(SR_TYPE), 'DRAINAGE') THEN 72 WHEN contains(upper(SR_TYPE), 'SIDEWALK') THEN 336
         WHEN contains(upper(SR_TYPE), 'TREE') THEN 120 ELSE 120 END AS target_hours
  FROM std),
enr AS (
  SELECT *, resolution_hours / target_hours AS performance_ratio,
    CASE WHEN resolution_hours / target_hours IS NULL THEN 'Unknown'
         WHEN NOT is_resolved AND resolution_hours / target_hours <= 0.9 THEN 'In Progress (Within Target)'
         WHEN NOT is_resolved THEN 'In Progress (Exceeding Target)'
         WHEN resolution_hours / target_hours <= 0.5 THEN 'Excellent'
         WHEN resolution_hours / target_hours <= 0.9 THEN 'Good'
         WHEN resolution_hours / target_hours <= 1.1 THEN 'On Target'
         WHEN resolution_hours / target_hours <= 2.0 THEN 'Delayed'
         ELSE 'Severely Delayed' END AS performance_category
  FROM res)"""


def _ctes(emergency_flag: bool = False) -> str:
    prio_src = "IS_EMERGENCY" if emergency_flag else "SR_PRIORITY"
    if emergency_flag:
        prio = "CASE WHEN upper(IS_EMERGENCY) IN ('YES','Y','TRUE','1') THEN 'HIGH' ELSE 'NORMAL' END"
    else:
        prio = _PRIORITY_CASE.format(c="SR_PRIORITY")
    return (
        f"WITH raw AS ({adapter_sql(emergency_flag)}),\n"
        + _STD_SQL.format(prio_src=prio_src, prio=prio)
        + ",\n"
        + _RES_SQL.format(as_of=AS_OF)
    )


def _sql(body: str, doubles: tuple[str, ...] = (), emergency_flag: bool = False) -> str:
    """Oracle text: shared CTEs, then ``body`` (which may add CTEs after a
    leading comma), with the listed double columns rounded like the Spark side."""
    body = body.strip()
    if body.startswith(","):
        head, _, select = body[1:].partition("\n--\n")
        inner = f"{_ctes(emergency_flag)},\n{head}\n{select}"
    else:
        inner = f"{_ctes(emergency_flag)}\n{body}"
    if not doubles:
        return inner
    repl = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({inner}) AS q"


MEETS = "COALESCE(performance_ratio <= 1.1, false)"
_MET = f"CAST(count_if({MEETS}) AS DOUBLE)"
_GOAL_DOUBLES = ("avg_resolution_hours", "median_resolution_hours", "target_met_pct", "avg_performance_ratio")
_SEASON = ("CASE WHEN month(CREATED_DATE) BETWEEN 1 AND 3 THEN 'Winter' WHEN month(CREATED_DATE) BETWEEN 4 AND 6 THEN 'Spring' "
           "WHEN month(CREATED_DATE) BETWEEN 7 AND 9 THEN 'Summer' WHEN month(CREATED_DATE) BETWEEN 10 AND 12 THEN 'Fall' END")


def _pct(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0 END"


def _goal_sql(key: str) -> str:
    return f"""SELECT {key}, CAST(count(*) AS BIGINT) AS total_requests, avg(resolution_hours) AS avg_resolution_hours,
  median(resolution_hours) AS median_resolution_hours,
  CAST(count_if({MEETS}) AS BIGINT) AS target_met_count,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met_pct,
  avg(performance_ratio) AS avg_performance_ratio,
  CASE WHEN {_pct(f"count_if({MEETS})", "count(*)")} >= 80 THEN 'Meeting Goal' ELSE 'Not Meeting Goal' END AS goal_status
FROM enr WHERE {key} IS NOT NULL GROUP BY {key}"""


def _counts_sql(keys: str, where: str = "", src: str = "enr", name: str = "count") -> str:
    w = f" WHERE {where}" if where else ""
    return f"SELECT {keys}, CAST(count(*) AS BIGINT) AS {name} FROM {src}{w} GROUP BY ALL"


def _profile_sql(key: str, with_target: bool, k: int) -> str:
    target = "max(target_hours) AS target_hours," if with_target else ""
    return f"""SELECT {key}, CAST(count(*) AS BIGINT) AS count,
  avg(CASE WHEN is_resolved THEN resolution_hours END) AS avg_resolution_hours,
  {_pct("count_if(is_resolved)", "count(*)")} AS resolution_rate, {target}
  COALESCE({_pct(f"count_if({MEETS} AND is_resolved)", "count_if(is_resolved)")}, 0.0) AS percent_meeting_target
FROM enr WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY count DESC, {key} ASC NULLS FIRST LIMIT {k}"""


def _top_in_top_sql(group: str, key: str, k_groups: int, k_keys: int) -> str:
    return f""", pairs AS (SELECT {group}, {key}, count(*) AS c FROM enr WHERE {group} IS NOT NULL GROUP BY ALL),
topg AS (SELECT {group} FROM pairs GROUP BY {group} ORDER BY sum(c) DESC, {group} ASC NULLS FIRST LIMIT {k_groups}),
ranked AS (SELECT {group}, {key}, c, row_number() OVER (PARTITION BY {group} ORDER BY c DESC, {key} ASC NULLS FIRST) AS r
           FROM pairs WHERE {key} IS NOT NULL AND {group} IN (SELECT {group} FROM topg))
--
SELECT {group}, {key}, CAST(c AS BIGINT) AS count, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= {k_keys}"""


def _compare_sql(key: str, k: int | None) -> str:
    lim = f" ORDER BY count DESC, {key} ASC NULLS FIRST LIMIT {k}" if k else ""
    return f""", agg AS (SELECT {key}, count(*) AS count, avg(resolution_hours) AS avg_resolution_hours,
  median(resolution_hours) AS median_resolution_hours, {_pct("count_if(is_resolved)", "count(*)")} AS resolution_rate,
  avg(performance_ratio) AS avg_performance_ratio, {_pct(f"count_if({MEETS})", "count(*)")} AS percent_meeting_target
  FROM enr GROUP BY {key}),
shares AS (SELECT *, {_pct("count", "sum(count) OVER ()")} AS percent_of_total FROM agg)
--
SELECT {key}, CAST(count AS BIGINT) AS count, percent_of_total, avg_resolution_hours, median_resolution_hours, resolution_rate,
  avg_performance_ratio, percent_meeting_target FROM shares WHERE {key} IS NOT NULL{lim}"""


_CMP_DOUBLES = ("percent_of_total", "avg_resolution_hours", "median_resolution_hours", "resolution_rate",
                "avg_performance_ratio", "percent_meeting_target")
_RAW_COLS = ("SR_ID", "SR_TYPE", "SR_PRIORITY", "METHOD_RAW", "STATUS", "ZIP_CODE", "CREATED_DATE", "CLOSED_DATE", "latitude", "longitude")
_ENR_COLS = _RAW_COLS + ("PRIORITY", "METHOD_RECEIVED", "has_valid_coords", "resolution_hours", "is_resolved",
                         "hours_since_creation", "target_hours", "performance_ratio", "performance_category")
_ENR_DOUBLES = ("latitude", "longitude", "resolution_hours", "hours_since_creation", "performance_ratio")
_PRIO_VALUES = "(VALUES ('HIGH'), ('MEDIUM'), ('NORMAL'), ('LOW')) t(PRIORITY)"


def _order_all(cols) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


def oracle_sql() -> dict[str, str]:
    out = _request_oracles()
    if llm_queries is not None:
        out |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out


def _table_row(pick: str, table: str, groups: str, tickets: bool = True) -> str:
    """One row of the selector's oracle: how many groups (c: their tickets) a table has."""
    return f"SELECT '{pick}' AS pick, '{table}' AS table_name, count(*) AS rows, CAST({'sum(c)' if tickets else 'NULL'} AS BIGINT) AS tickets FROM ({groups})"


def _groups(key: str, where: str = "true", limit: int | None = None) -> str:
    cut = f" ORDER BY count(*) DESC, {key} LIMIT {limit}" if limit else ""
    return f"SELECT {key} AS k, count(*) AS c FROM enr WHERE {key} IS NOT NULL AND {where} GROUP BY {key}{cut}"


def _tops_in(group: str, within: str, k: int) -> str:
    """Groups of the ``k`` most frequent types in each of ``group``."""
    return (f"SELECT * FROM (SELECT g, SR_TYPE, count(*) AS c, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, SR_TYPE) AS r "
            f"FROM (SELECT {group} AS g, SR_TYPE FROM enr) WHERE SR_TYPE IS NOT NULL AND {within} GROUP BY g, SR_TYPE) WHERE r <= {k}")


_TOP_ZIPS = f"g IN (SELECT ZIP_CODE FROM enr WHERE ZIP_CODE IS NOT NULL GROUP BY ZIP_CODE ORDER BY count(*) DESC, ZIP_CODE LIMIT {K.TOP_ZIPS})"
_DETAIL = f"SR_TYPE = '{DETAIL_TYPE}'"
_SELECTOR_SQL = " UNION ALL ".join((
    _table_row("geographic", "top_zipcodes_by_volume", _groups("ZIP_CODE", limit=K.TOP_ZIPS)),
    _table_row("geographic", "zipcode_performance", f"SELECT DISTINCT g FROM (SELECT ZIP_CODE AS g, is_resolved FROM enr) WHERE is_resolved AND {_TOP_ZIPS}", False),
    _table_row("geographic", "top_request_types_by_zipcode", _tops_in("ZIP_CODE", _TOP_ZIPS, 5)),
    _table_row("seasonal", "monthly_volumes", _groups("month(CREATED_DATE)")),
    "SELECT 'seasonal' AS pick, 'seasonal_volumes' AS table_name, 4 AS rows, count(CREATED_DATE) AS tickets FROM enr",
    _table_row("seasonal", "top_request_types_by_season", _tops_in(_SEASON, "g IS NOT NULL", 5)),
    _table_row("seasonal", "seasonal_performance", _groups(_SEASON, "is_resolved"), False),
    _table_row("method", "categories", _groups("METHOD_RECEIVED")),
    _table_row("priority", "categories", _groups("PRIORITY")),
    _table_row("kind over type", "categories", _groups("ZIP_CODE", limit=10)),
    _table_row("kind over type", "top_request_types", _tops_in("ZIP_CODE", _TOP_ZIPS, 3)),
    _table_row("type", "request_type", f"SELECT count(*) AS c FROM enr WHERE {_DETAIL}"),
    _table_row("type", "performance_categories", _groups("performance_category", _DETAIL)),
    _table_row("type", "top_zipcodes", _groups("ZIP_CODE", _DETAIL, 5)),
    _table_row("type", "monthly_counts", _groups("strftime(CREATED_DATE, '%Y-%m')", _DETAIL)),
))


def _request_oracles() -> dict[str, str]:
    d = DETAIL_TYPE
    sel = f"SR_TYPE = '{d}'"
    cat_counts = _counts_sql("performance_category", "performance_category IS NOT NULL")
    top_types = "SELECT SR_TYPE FROM enr WHERE SR_TYPE IS NOT NULL GROUP BY SR_TYPE ORDER BY count(*) DESC, SR_TYPE ASC LIMIT {k}"
    return {
        # sources
        "src_csv": _sql(cat_counts),
        "src_csv_headers": _sql("""SELECT CASE WHEN SR_ID % 3 = 2 THEN NULL ELSE STATUS END AS STATUS, CAST(ZIP_CODE AS INTEGER) AS ZIP_CODE, SR_TYPE,
  CASE WHEN SR_ID % 3 = 1 THEN 'late' END AS EXTRA, count(*) AS count, CAST(sum(SR_ID) AS BIGINT) AS ids, count(*) FILTER (latitude = 'bad') AS bad_latitudes
FROM raw GROUP BY ALL"""),
        "csv_types": _sql(" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS type, count({v}) AS filled, count({v}) FILTER ({typed}) AS typed, {odd} AS conflict FROM raw" for c, t, v, typed, odd in (
                ("SR_ID", "int", "SR_ID", "true", "false"), ("SR_TYPE", "string", "SR_TYPE", "false", "false"),
                ("SR_PRIORITY", "string", "SR_PRIORITY", "SR_PRIORITY <> 'urgent'", "true"), ("METHOD_RAW", "string", "METHOD_RAW", "false", "false"),
                ("STATUS", "string", "CASE WHEN SR_ID % 3 <> 2 THEN STATUS END", "false", "false"), ("ZIP_CODE", "int", "ZIP_CODE", "true", "false"),
                ("CREATED_DATE", "string", "CREATED_DATE", "false", "false"), ("CLOSED_DATE", "string", "CLOSED_DATE", "false", "false"),
                ("latitude", "string", "latitude", "latitude <> 'bad'", "true"), ("longitude", "double", "longitude", "true", "false"),
                ("EXTRA", "string", "CASE WHEN SR_ID % 3 = 1 THEN 1 END", "false", "false")))),
        "src_features": _sql(cat_counts),
        "src_features_document": _sql(cat_counts),
        "stream_category_counts": _sql(cat_counts),
        "limit_records": _sql(f"SELECT * FROM raw ORDER BY {_order_all(_RAW_COLS)} LIMIT {K.DEFAULT_RECORD_LIMIT}"),
        "preview_rows": _sql(f"SELECT * FROM enr ORDER BY {_order_all(_ENR_COLS)} LIMIT {K.PREVIEW_ROWS}", _ENR_DOUBLES),
        # standardise
        "coerce_dates": _sql("SELECT SR_ID, CREATED_DATE, CLOSED_DATE FROM raw"),
        "text_dates": _sql("SELECT SR_ID, CASE WHEN SR_ID % 7 <> 5 THEN CREATED_DATE END AS CREATED_DATE, CASE WHEN SR_ID % 7 <> 5 THEN CLOSED_DATE END AS CLOSED_DATE FROM raw"),
        "no_dates": _sql("SELECT 'Unknown' AS performance_category, false AS is_resolved, count(*) AS count, CAST(0 AS BIGINT) AS with_hours, false AS has_age FROM raw"),
        "no_type": _sql("""SELECT 'UNKNOWN' AS SR_TYPE, 120 AS target_hours, CASE WHEN h IS NULL THEN 'Unknown' WHEN NOT is_resolved AND h <= 108 THEN 'In Progress (Within Target)'
  WHEN NOT is_resolved THEN 'In Progress (Exceeding Target)' WHEN h <= 60 THEN 'Excellent' WHEN h <= 108 THEN 'Good' WHEN h <= 132 THEN 'On Target' WHEN h <= 240 THEN 'Delayed'
  ELSE 'Severely Delayed' END AS performance_category, count(*) AS count FROM (SELECT resolution_hours AS h, is_resolved FROM enr) GROUP BY ALL"""),
        "priority_order": _sql("""SELECT value, CAST(CASE value WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'NORMAL' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS INTEGER) AS place
FROM (SELECT PRIORITY AS value FROM std UNION SELECT upper(SR_PRIORITY) FROM std) WHERE value IS NOT NULL"""),
        "insight_selector": _sql(_SELECTOR_SQL),
        "reuse_table": _sql(" UNION ALL ".join(
            f"SELECT STATUS, {n} * count(*) AS count, {i} AS load, {same} AS same_table FROM raw GROUP BY STATUS" for i, n, same in ((1, 1, "true"), (2, 1, "true"), (3, 2, "false")))),
        "infer_priority": _sql(_counts_sql("PRIORITY", src="std"), emergency_flag=True),
        "canon_priority": _sql(_counts_sql("SR_PRIORITY, PRIORITY", src="std")),
        "canon_method": _sql(_counts_sql("METHOD_RAW, METHOD_RECEIVED", src="std")),
        "valid_coords": _sql(_counts_sql("has_valid_coords", src="std")),
        "drop_empty": _sql("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(SR_ID) AS BIGINT) AS ids FROM std WHERE SR_ID % 7 <> 0"),
        "role_overrides": _sql("SELECT * RENAME (ZIP_CODE AS area) FROM (" + _profile_sql("ZIP_CODE", False, K.TOP_ZIPS) + ")",
                               ("avg_resolution_hours", "resolution_rate", "percent_meeting_target")),
        "median_narrowed": _sql("SELECT PRIORITY, median(resolution_hours) AS median_hours, median(performance_ratio) AS median_ratio FROM enr GROUP BY PRIORITY",
                                ("median_hours", "median_ratio")),
        "payload_json": _sql("SELECT '{' || " + " || ',' || ".join(
            f"""'"{c}":' || COALESCE({e}, 'null')""" for c, e in (
                ("SR_TYPE", "'\"' || SR_TYPE || '\"'"), ("count", 'CAST("count" AS VARCHAR)'),
                ("avg_resolution_hours", "CAST(CAST(avg_resolution_hours AS DECIMAL(38, 4)) AS VARCHAR)"),
                ("resolution_rate", "CAST(CAST(resolution_rate AS DECIMAL(38, 4)) AS VARCHAR)"), ("target_hours", "CAST(target_hours AS VARCHAR)"),
                ("percent_meeting_target", "CAST(CAST(percent_meeting_target AS DECIMAL(38, 4)) AS VARCHAR)"))
        ) + " || '}' AS json FROM (" + _profile_sql("SR_TYPE", True, K.TOP_TYPES) + ")"),
        "map_points": _sql("SELECT * FROM enr WHERE has_valid_coords ORDER BY md5(concat_ws('|', '" + str(K.MAP_SAMPLE_SEED) + "', "
                           + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in MAP_IDS) + ")), " + _order_all(
                               ["SR_ID", "SR_TYPE", "SR_PRIORITY", "METHOD_RAW", "STATUS", "ZIP_CODE", "CREATED_DATE", "CLOSED_DATE", "latitude", "longitude"])
                           + f" LIMIT {K.MAP_SAMPLE_SIZE}", _ENR_DOUBLES),
        "standardise": _sql("SELECT * FROM std", ("latitude", "longitude")),
        # resolution time, targets, classification
        "resolution_hours": _sql("SELECT SR_ID, CREATED_DATE, CLOSED_DATE, resolution_hours, is_resolved FROM res", ("resolution_hours",)),
        "ticket_age": _sql("SELECT SR_ID, CREATED_DATE, hours_since_creation FROM res", ("hours_since_creation",)),
        "target_hours": _sql(_counts_sql("SR_TYPE, target_hours", src="res")),
        "performance_category": _sql(_counts_sql("performance_category, is_resolved")),
        "enrich": _sql("SELECT * FROM enr", _ENR_DOUBLES),
        # summary metrics
        "overall_metrics": _sql(f"""SELECT CAST(count(*) AS BIGINT) AS total_requests,
  CAST(count_if(is_resolved) AS BIGINT) AS resolved_requests,
  {_pct("count_if(is_resolved)", "count(*)")} AS resolution_rate,
  COALESCE({_pct(f"count_if({MEETS} AND is_resolved)", "count_if(is_resolved)")}, 0.0) AS percent_meeting_target,
  avg(CASE WHEN is_resolved THEN resolution_hours END) AS avg_resolution_hours,
  median(CASE WHEN is_resolved THEN resolution_hours END) AS median_resolution_hours FROM enr""",
            ("resolution_rate", "percent_meeting_target", "avg_resolution_hours", "median_resolution_hours")),
        "status_counts": _sql(_counts_sql("STATUS", "STATUS IS NOT NULL")),
        "category_counts": _sql(cat_counts),
        "type_profile": _sql(_profile_sql("SR_TYPE", True, K.TOP_TYPES), ("avg_resolution_hours", "resolution_rate", "percent_meeting_target")),
        "type_category_counts": _sql(f""", top AS ({top_types.format(k=K.TOP_TYPES)})
--
{_counts_sql("SR_TYPE, performance_category", "SR_TYPE IN (SELECT SR_TYPE FROM top) AND performance_category IS NOT NULL")}"""),
        "zip_profile": _sql(_profile_sql("ZIP_CODE", False, K.TOP_ZIPS), ("avg_resolution_hours", "resolution_rate", "percent_meeting_target")),
        "monthly_counts": _sql("SELECT strftime(CREATED_DATE, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS count FROM enr WHERE CREATED_DATE IS NOT NULL GROUP BY ALL"),
        "monthly_performance": _sql("SELECT strftime(CREATED_DATE, '%Y-%m') AS month, avg(performance_ratio) AS avg_performance_ratio FROM enr "
                                    "WHERE is_resolved AND CREATED_DATE IS NOT NULL GROUP BY ALL", ("avg_performance_ratio",)),
        "monthly_state": _sql(f"""SELECT strftime(CREATED_DATE, '%Y-%m') AS month, count(*) AS count, CAST(count_if(is_resolved) AS BIGINT) AS resolved, avg(resolution_hours) AS avg_resolution_hours,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met_pct, {_pct("count_if(PRIORITY = 'HIGH')", "count(*)")} AS high_priority_pct,
  avg(CASE WHEN is_resolved THEN performance_ratio END) AS avg_performance_ratio FROM enr WHERE CREATED_DATE IS NOT NULL GROUP BY ALL""",
            ("avg_resolution_hours", "target_met_pct", "high_priority_pct", "avg_performance_ratio")),
        # goal reports
        "priority_goals": _sql(_goal_sql("PRIORITY"), _GOAL_DOUBLES),
        "method_goals": _sql(_goal_sql("METHOD_RECEIVED"), _GOAL_DOUBLES),
        "priority_by_method": _sql(f""", agg AS (SELECT METHOD_RECEIVED, PRIORITY, count(*) AS c, avg(performance_ratio) AS avg_performance_ratio,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met_pct FROM enr WHERE METHOD_RECEIVED IS NOT NULL AND PRIORITY IS NOT NULL GROUP BY ALL)
--
SELECT METHOD_RECEIVED, PRIORITY, CAST(c AS BIGINT) AS count, CAST(sum(c) OVER (PARTITION BY METHOD_RECEIVED) AS BIGINT) AS count_total,
  {_pct("c", "sum(c) OVER (PARTITION BY METHOD_RECEIVED)")} AS percentage, avg_performance_ratio, target_met_pct FROM agg""",
            ("percentage", "avg_performance_ratio", "target_met_pct")),
        "performance_over_time": _sql(f"""SELECT strftime(date_trunc('month', CREATED_DATE), '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS request_count,
  avg(resolution_hours) AS avg_resolution_hours, median(resolution_hours) AS median_resolution_hours,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met_pct, {_pct("count_if(PRIORITY = 'HIGH')", "count(*)")} AS high_priority_pct,
  date_trunc('month', CREATED_DATE) AS month_date
FROM enr WHERE CREATED_DATE IS NOT NULL GROUP BY date_trunc('month', CREATED_DATE)""",
            ("avg_resolution_hours", "median_resolution_hours", "target_met_pct", "high_priority_pct")),
        # insight statistics
        "type_detail": _sql(f"""SELECT '{d}' AS request_type, CAST(count_if({sel}) AS BIGINT) AS count,
  {_pct(f"count_if({sel})", "count(*)")} AS percent_of_total,
  CAST(count_if({sel} AND is_resolved) AS BIGINT) AS resolved_count,
  {_pct(f"count_if({sel} AND is_resolved)", f"count_if({sel})")} AS resolution_rate,
  avg(CASE WHEN {sel} AND is_resolved THEN resolution_hours END) AS avg_resolution_hours,
  median(CASE WHEN {sel} AND is_resolved THEN resolution_hours END) AS median_resolution_hours,
  max(CASE WHEN {sel} THEN target_hours END) AS target_hours,
  {_pct(f"count_if({sel} AND is_resolved AND {MEETS})", f"count_if({sel} AND is_resolved)")} AS percent_meeting_target
FROM enr HAVING count_if({sel}) > 0""",
            ("percent_of_total", "resolution_rate", "avg_resolution_hours", "median_resolution_hours", "percent_meeting_target")),
        "type_detail_categories": _sql(_counts_sql("performance_category", f"{sel} AND performance_category IS NOT NULL")),
        "type_detail_zips": _sql(_counts_sql("ZIP_CODE", f"{sel} AND ZIP_CODE IS NOT NULL") + f" ORDER BY count DESC, ZIP_CODE LIMIT {K.TOP_ZIPS_PER_TYPE}"),
        "type_detail_months": _sql(f"SELECT strftime(CREATED_DATE, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS count FROM enr WHERE {sel} AND CREATED_DATE IS NOT NULL GROUP BY ALL"),
        "top_zips": _sql(_counts_sql("ZIP_CODE", "ZIP_CODE IS NOT NULL") + f" ORDER BY count DESC, ZIP_CODE LIMIT {K.TOP_ZIPS}"),
        "zip_performance": _sql(f"""SELECT ZIP_CODE, avg_performance_ratio, percent_meeting_target FROM (
  SELECT ZIP_CODE, count(*) AS c, count_if(is_resolved) AS r, avg(CASE WHEN is_resolved THEN performance_ratio END) AS avg_performance_ratio,
    {_pct(f"count_if({MEETS} AND is_resolved)", "count_if(is_resolved)")} AS percent_meeting_target
  FROM enr WHERE ZIP_CODE IS NOT NULL GROUP BY ZIP_CODE ORDER BY c DESC, ZIP_CODE LIMIT {K.TOP_ZIPS}) WHERE r > 0""",
            ("avg_performance_ratio", "percent_meeting_target")),
        "top_types_by_zip": _sql(_top_in_top_sql("ZIP_CODE", "SR_TYPE", K.TOP_ZIPS, K.TOP_TYPES_PER_ZIP)),
        "month_of_year_volume": _sql("SELECT CAST(month(CREATED_DATE) AS INTEGER) AS month, CAST(count(*) AS BIGINT) AS count FROM enr WHERE CREATED_DATE IS NOT NULL GROUP BY ALL"),
        "season_volume": _sql(f""", s AS (SELECT {_SEASON} AS season FROM enr WHERE CREATED_DATE IS NOT NULL),
seasons AS (SELECT * FROM (VALUES ('Winter'), ('Spring'), ('Summer'), ('Fall')) t(season))
--
SELECT seasons.season AS season, CAST(count(s.season) AS BIGINT) AS count FROM seasons LEFT JOIN s ON s.season = seasons.season GROUP BY seasons.season"""),
        "top_types_by_season": _sql(f""", s AS (SELECT {_SEASON} AS season, SR_TYPE FROM enr WHERE CREATED_DATE IS NOT NULL),
pairs AS (SELECT season, SR_TYPE, count(*) AS c FROM s WHERE SR_TYPE IS NOT NULL AND season IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY c DESC, SR_TYPE ASC NULLS FIRST) AS r FROM pairs)
--
SELECT season, SR_TYPE, CAST(c AS BIGINT) AS count, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= {K.TOP_TYPES_PER_SEASON}"""),
        "season_performance": _sql(f"""SELECT {_SEASON} AS season, avg(performance_ratio) AS avg_performance_ratio,
  {_pct(f"count_if({MEETS})", "count(*)")} AS percent_meeting_target
FROM enr WHERE is_resolved AND CREATED_DATE IS NOT NULL GROUP BY ALL""", ("avg_performance_ratio", "percent_meeting_target")),
        "compare_priority": _sql(_compare_sql("PRIORITY", None), _CMP_DOUBLES),
        "compare_type": _sql(_compare_sql("SR_TYPE", K.TOP_TYPES), _CMP_DOUBLES),
        "compare_zip": _sql(_compare_sql("ZIP_CODE", K.TOP_ZIPS), _CMP_DOUBLES),
        "compare_zip_types": _sql(_top_in_top_sql("ZIP_CODE", "SR_TYPE", K.TOP_ZIPS, K.TOP_TYPES_PER_COMPARED_ZIP)),
        "compare_method": _sql(_compare_sql("METHOD_RECEIVED", None), _CMP_DOUBLES),
        "dataset_shape": _sql(f"SELECT CAST(count(*) AS BIGINT) AS rows, {len(_ENR_COLS)} AS columns, '{','.join(_ENR_COLS)}' AS column_list FROM enr"),
        "numeric_profile": _sql(""", st AS (SELECT * FROM (SELECT CAST(SR_ID AS DOUBLE) AS SR_ID, latitude, longitude, resolution_hours,
  hours_since_creation, CAST(target_hours AS DOUBLE) AS target_hours, performance_ratio FROM enr)
  UNPIVOT INCLUDE NULLS (value FOR column_name IN (SR_ID, latitude, longitude, resolution_hours, hours_since_creation,
  target_hours, performance_ratio)))
--
SELECT column_name, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max FROM st GROUP BY column_name""",
            ("mean", "median", "min", "max")),
        "categorical_profile": _sql(f""", st AS (SELECT * FROM (SELECT SR_TYPE, SR_PRIORITY, METHOD_RAW, STATUS, ZIP_CODE FROM enr)
  UNPIVOT INCLUDE NULLS (value FOR column_name IN (SR_TYPE, SR_PRIORITY, METHOD_RAW, STATUS, ZIP_CODE))),
pairs AS (SELECT column_name, value, count(*) AS c FROM st WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY c DESC, value ASC NULLS FIRST) AS r FROM pairs)
--
SELECT column_name, value, CAST(c AS BIGINT) AS count, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= {K.PROFILE_TOP_VALUES}"""),
        # report tables
        "priority_distribution": _sql("SELECT PRIORITY AS Priority, CAST(count(*) AS BIGINT) AS Count FROM enr WHERE PRIORITY IS NOT NULL GROUP BY ALL"),
        "priority_by_type": _sql(f""", pairs AS (SELECT SR_TYPE, PRIORITY, count(*) AS c FROM enr WHERE SR_TYPE IS NOT NULL AND PRIORITY IS NOT NULL GROUP BY ALL),
top AS (SELECT SR_TYPE FROM pairs GROUP BY SR_TYPE ORDER BY sum(c) DESC, SR_TYPE ASC LIMIT {K.CROSSTAB_TYPES}),
prios AS (SELECT DISTINCT PRIORITY FROM pairs WHERE SR_TYPE IN (SELECT SR_TYPE FROM top)),
grid AS (SELECT top.SR_TYPE, prios.PRIORITY FROM top CROSS JOIN prios)
--
SELECT grid.SR_TYPE, grid.PRIORITY AS Priority, CAST(COALESCE(pairs.c, 0) AS BIGINT) AS Count
FROM grid LEFT JOIN pairs ON grid.SR_TYPE = pairs.SR_TYPE AND grid.PRIORITY = pairs.PRIORITY"""),
        "method_distribution": _sql("SELECT METHOD_RECEIVED AS Method, CAST(count(*) AS BIGINT) AS Count FROM enr WHERE METHOD_RECEIVED IS NOT NULL GROUP BY ALL"),
        "performance_by_method": _sql(f"""SELECT METHOD_RECEIVED AS Method, avg(performance_ratio) AS mean_performance_ratio,
  median(performance_ratio) AS median_performance_ratio, CAST(count(performance_ratio) AS BIGINT) AS Count
FROM enr GROUP BY METHOD_RECEIVED HAVING count(performance_ratio) > {K.MIN_METHOD_COUNT}""",
            ("mean_performance_ratio", "median_performance_ratio")),
        "priority_performance": _sql(f"""SELECT PRIORITY, avg(performance_ratio) AS avg_performance, median(performance_ratio) AS median_performance,
  avg(resolution_hours) AS avg_resolution_hours, median(resolution_hours) AS median_resolution_hours, CAST(count(*) AS BIGINT) AS count,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met_pct, round({_pct(f"count_if({MEETS})", "count(*)")}, 1) AS performance_score
FROM enr GROUP BY PRIORITY""",
            ("avg_performance", "median_performance", "avg_resolution_hours", "median_resolution_hours", "target_met_pct", "performance_score")),
        "type_priority_grid": _sql(f""", top AS ({top_types.format(k=K.GRID_TYPES)}),
prios AS (SELECT * FROM {_PRIO_VALUES}),
agg AS (SELECT SR_TYPE, PRIORITY, avg(performance_ratio) AS avg_perf, median(performance_ratio) AS median_perf,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met, count(performance_ratio) AS c
  FROM enr WHERE SR_TYPE IN (SELECT SR_TYPE FROM top) GROUP BY ALL)
--
SELECT top.SR_TYPE, prios.PRIORITY, agg.avg_perf, agg.median_perf, agg.target_met, CAST(COALESCE(agg.c, 0) AS BIGINT) AS count
FROM top CROSS JOIN prios LEFT JOIN agg ON agg.SR_TYPE = top.SR_TYPE AND agg.PRIORITY = prios.PRIORITY""",
            ("avg_perf", "median_perf", "target_met")),
        "method_priority_share": _sql(f""", agg AS (SELECT METHOD_RECEIVED, count(*) AS n, count_if(PRIORITY = 'HIGH') AS h, count_if(PRIORITY = 'MEDIUM') AS m,
  count_if(PRIORITY = 'NORMAL') AS nm, count_if(PRIORITY = 'LOW') AS l FROM enr
  WHERE METHOD_RECEIVED IS NOT NULL AND PRIORITY IS NOT NULL GROUP BY ALL)
--
SELECT METHOD_RECEIVED, 'HIGH' AS PRIORITY, {_pct("h", "n")} AS Percentage FROM agg
UNION ALL SELECT METHOD_RECEIVED, 'MEDIUM', {_pct("m", "n")} FROM agg
UNION ALL SELECT METHOD_RECEIVED, 'NORMAL', {_pct("nm", "n")} FROM agg
UNION ALL SELECT METHOD_RECEIVED, 'LOW', {_pct("l", "n")} FROM agg""", ("Percentage",)),
        "method_priority_met": _sql(f"""SELECT METHOD_RECEIVED, PRIORITY, {_pct(f"count_if({MEETS})", "count(*)")} AS Percent_Meeting_Target
FROM enr WHERE is_resolved AND METHOD_RECEIVED IS NOT NULL AND PRIORITY IS NOT NULL GROUP BY ALL""", ("Percent_Meeting_Target",)),
        "monthly_table": _sql(f"""SELECT strftime(date_trunc('month', CREATED_DATE), '%b %Y') AS month, CAST(count(*) AS BIGINT) AS request_count,
  {_pct(f"count_if({MEETS})", "count(*)")} AS target_met_pct, avg(resolution_hours) AS avg_resolution_hours,
  {_pct("count_if(PRIORITY = 'HIGH')", "count(*)")} AS high_priority_pct
FROM enr WHERE CREATED_DATE IS NOT NULL GROUP BY date_trunc('month', CREATED_DATE)""",
            ("target_met_pct", "avg_resolution_hours", "high_priority_pct")),
        "top_types": _sql(_counts_sql("SR_TYPE", "SR_TYPE IS NOT NULL") + f" ORDER BY count DESC, SR_TYPE LIMIT {K.TOP_TYPES}"),
    }
