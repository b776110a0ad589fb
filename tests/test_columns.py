"""Edge rows for the per-row rules (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from servicepulse import constants as K
from servicepulse.functions import columns as C
from servicepulse.operators.standardise import drop_empty_rows, standardise
from servicepulse.operators.resolution import with_resolution
from servicepulse.operators.classify import classify
from servicepulse.roles import resolve_roles


def _map(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"raw {dtype}")
    return [r.out for r in df.select(fn(F.col("raw")).alias("out")).collect()]


def test_canon_priority(spark):
    raw = ["1", "2", "3", "4", "5", "high", "URGENT", "critical", " HIGH", "x", None, "emergency", "Medium", "low"]
    want = ["HIGH", "MEDIUM", "NORMAL", "LOW", "LOW", "HIGH", "HIGH", "HIGH", "NORMAL", "NORMAL", "NORMAL", "HIGH", "MEDIUM", "LOW"]
    assert _map(spark, raw, C.canon_priority) == want


def test_canon_priority_integer_column(spark):
    # integers stay integers in Spark: 1 -> '1' -> HIGH
    assert _map(spark, [1, 4, None], C.canon_priority, "int") == ["HIGH", "LOW", "NORMAL"]


def test_infer_priority(spark):
    df = spark.createDataFrame(
        [("yes", None), ("N", "1"), ("no", None), ("TRUE", "no"), ("y", "n"), ("0", "false")],
        "IS_EMERGENCY string, URGENT_FLAG string",
    )
    out = standardise(df).select(K.PRIORITY_COL).collect()
    assert [r[0] for r in out] == ["HIGH", "HIGH", "NORMAL", "HIGH", "HIGH", "NORMAL"]


def test_drop_all_empty_rows(spark):
    df = spark.createDataFrame([("yes", None), (None, None), (None, "1")], "IS_EMERGENCY string, URGENT_FLAG string")
    assert standardise(df).count() == 3 and standardise(drop_empty_rows(df)).count() == 2


def test_canon_method(spark):
    cases = {
        "EMAIL": "OTHER", "WEBMAIL": "WEB", "WHATSAPP": "MOBILE APP", "SMARTPHONE APP": "PHONE",
        "IN PERSON": "UNKNOWN", "WALK IN": "UNKNOWN", "COUNTER": "WALK-IN", "ANOTHER": "OTHER", None: "UNKNOWN",
        "phone": "PHONE", "Mobile": "MOBILE APP", "walkin": "WALK-IN", "In-Person": "WALK-IN", "fax": "OTHER",
        "Twitter": "UNKNOWN", "e-mail": "OTHER", "": "UNKNOWN",
    }
    assert _map(spark, list(cases), C.canon_method) == list(cases.values())


def test_canon_method_keep_email(spark):
    assert _map(spark, ["EMAIL", "MAIL"], lambda c: C.canon_method(c, keep_email=True)) == ["EMAIL", "OTHER"]


def test_target_hours_ordered_substring(spark):
    raw = ["Trash near Pothole", "Street sign", "TRAFFIC SIGNAL", "sidewalk crack", "water leak", None, "Noise", "graffiti"]
    assert _map(spark, raw, C.target_hours) == [72, 120, 24, 336, 24, 120, 120, 168]


def test_coordinates_strict_box(spark):
    rows = [("25.0", "-80.5"), ("26.5", "-80.5"), ("25.5", "-81.0"), ("25.5", "-80.0"), ("25.5", "-80.5"),
            ("bad", "-80.5"), (None, "-80.5"), ("NaN", "-80.5"), ("25.000001", "-80.999999")]
    df = spark.createDataFrame(rows, "latitude string, longitude string")
    out = standardise(df).select("latitude", K.VALID_COORDS_COL).collect()
    assert [r[1] for r in out] == [False, False, False, False, True, False, False, False, True]
    assert out[7][0] is None  # NaN becomes NULL, never NaN


def test_dates_and_resolution(spark):
    rows = [
        ("junk", "2024-01-02 00:00:00"),
        ("2024-01-01T05:00:00+05:00", "2024-01-01T07:30:00"),
        ("2024-01-03 00:00:00", "2024-01-02 00:00:00"),
        ("2024-01-01 00:00:00", None),
        (None, "2024-01-01 00:00:00"),
        ("2024-01-01", None),
        ("01/15/2024 10:30:00 AM", "01/15/2024 04:30:00 PM"),
    ]
    df = spark.createDataFrame(rows, "CREATED_DATE string, CLOSED_DATE string")
    out = with_resolution(standardise(df), as_of="2024-01-11 00:00:00").collect()
    assert out[0].CREATED_DATE is None and out[0][K.HOURS_COL] is None and out[0][K.RESOLVED_COL]
    assert out[1].CREATED_DATE == dt.datetime(2024, 1, 1, 5, 0) and out[1][K.HOURS_COL] == 2.5
    assert out[2][K.HOURS_COL] == -24.0 and out[2][K.RESOLVED_COL]
    assert out[3][K.HOURS_COL] == 240.0 and not out[3][K.RESOLVED_COL] and out[3][K.AGE_COL] == 240.0
    assert out[4][K.HOURS_COL] is None and out[4][K.RESOLVED_COL]
    assert out[5][K.HOURS_COL] == 240.0 and not out[5][K.RESOLVED_COL]
    assert out[6][K.HOURS_COL] == 6.0


def test_us_style_dates_padded_or_not(spark):
    from servicepulse.operators.standardise import coerce_timestamp
    from pyspark.sql import types as T
    vals = ["01/15/2024 10:30:00 AM", "1/5/2024 3:04:00 PM", "1/5/2024", "12/31/2023 23:59", "2024/1/5 07:00:00", "junk"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.t for r in df.select(coerce_timestamp(F.col("s"), T.StringType()).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 15, 10, 30), dt.datetime(2024, 1, 5, 15, 4), dt.datetime(2024, 1, 5),
                   dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 1, 5, 7, 0), None]


def test_missing_date_columns(spark):
    df = spark.createDataFrame([(1,)], "x int")
    out = with_resolution(df)
    assert K.AGE_COL not in out.columns
    r = out.collect()[0]
    assert r[K.HOURS_COL] is None and r[K.RESOLVED_COL] is False


@pytest.mark.parametrize(
    "hours,target,resolved,want",
    [
        (5.0, 10, True, "Excellent"), (5.0001, 10, True, "Good"), (9.0, 10, True, "Good"),
        (9.0001, 10, True, "On Target"), (11.0, 10, True, "On Target"), (11.0001, 10, True, "Delayed"),
        (20.0, 10, True, "Delayed"), (20.001, 10, True, "Severely Delayed"), (None, 10, True, "Unknown"),
        (-5.0, 10, True, "Excellent"), (9.0, 10, False, "In Progress (Within Target)"),
        (9.0001, 10, False, "In Progress (Exceeding Target)"), (None, 10, False, "Unknown"),
        (-10.0, 10, False, "In Progress (Within Target)"),
    ],
)
def test_category_bounds(spark, hours, target, resolved, want):
    df = spark.createDataFrame([(hours, target, resolved)], "h double, t int, r boolean")
    got = df.select(C.performance_category(F.col("h") / F.col("t"), F.col("r")).alias("c")).first().c
    assert got == want


def test_seasons(spark):
    assert _map(spark, [1, 3, 4, 6, 7, 9, 10, 12, None], C.season, "int") == [
        "Winter", "Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", None]


def test_role_names():
    r = resolve_roles(["OPEN_DATE", "RESOLUTION_DATE", "SR_CATEGORY", "Priority", "resource_id", "STATUS_X", "ZIPCODE"])
    assert r.created == "OPEN_DATE" and r.closed == "RESOLUTION_DATE"
    assert r.request_type == "SR_CATEGORY" and r.priority == "Priority"
    assert r.method == "resource_id"  # 'source' keyword
    assert r.status == "STATUS_X" and r.zip == "ZIPCODE"
    r2 = resolve_roles(["REQUEST_TYPE", "ticket_created_date", "date_closed"])
    assert r2.request_type == "REQUEST_TYPE" and r2.created == "ticket_created_date" and r2.closed == "date_closed"
    assert resolve_roles(["a"]).request_type is None


def test_clashing_names_kept(spark):
    df = spark.createDataFrame([("2",)], "Priority string")
    out = standardise(df)
    assert "raw_Priority" in out.columns and out.first()[K.PRIORITY_COL] == "MEDIUM"


def test_type_fill_and_classify_without_type(spark):
    df = spark.createDataFrame([(None, "2024-01-01", None)], "SR_TYPE string, CREATED_DATE string, CLOSED_DATE string")
    r = classify(with_resolution(standardise(df), as_of="2024-01-02")).first()
    assert r.SR_TYPE == "UNKNOWN" and r[K.TARGET_COL] == 120
    df2 = spark.createDataFrame([(1,)], "x int")
    r2 = classify(with_resolution(df2)).first()
    assert r2.SR_TYPE == "UNKNOWN" and r2[K.CATEGORY_COL] == "Unknown"


def test_dst_gap_wall_clock_kept(spark):
    """Zone-less arithmetic and parsing ignore the session zone, including a
    local midnight that does not exist there (Sao Paulo, 1999-10-03)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        from servicepulse.operators.standardise import coerce_timestamp
        from pyspark.sql import types as T
        df = spark.createDataFrame([("10/03/1999 12:00:00 AM", "1999-10-04 00:00:00")], "a string, b string")
        a = coerce_timestamp(F.col("a"), T.StringType())
        b = coerce_timestamp(F.col("b"), T.StringType())
        r = df.select(a.alias("a"), C.hours_between(a, b).alias("h"), C.ntz_to_epoch_millis(a).alias("ms")).first()
        assert r.a == dt.datetime(1999, 10, 3, 0, 0) and r.h == 24.0 and r.ms == 938908800000
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_shapes_keep_every_text_that_a_format_parses(spark):
    """The guarded parse of each format equals the plain one, on texts of all formats and their mutations."""
    import random

    from servicepulse.operators.standardise import DEFAULT_DATE_FORMATS

    rng = random.Random(3)
    texts = ["1/5/2024 3:07:09 pm", "12/31/1999 23:59", "1-5-2024 3:07 AM", "2024/1/5 15:07:00", "2024-1-5 3:07 PM", "Jan 5, 2024 3:07 pm", "JAN 5, 2024", "january 5, 2024",
             "5 Jan 2024", "05-jan-2024 15:07:09", "5-Jan-2024", "2024-01-05T15:07:00.123", "20240105", "soon", "", " 1/5/2024", "1/5/2024 ", "１/5/2024", "+1/5/2024", "0001/0005/2024", "1/5/+12024"]
    for t in list(texts):
        for _ in range(12):
            i = rng.randrange(len(t) + 1)
            texts.append(t[:i] + rng.choice(["", " ", "/", "-", "0", "9", "a", "M", ",", "."]) + t[i + rng.randrange(2):])
    formats = [*DEFAULT_DATE_FORMATS, "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "d 'o''clock' MMMM yyyy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    col = F.col("t")
    got = df.select(*[c.cast("string").alias(f"g{i}") for i, c in enumerate(C.parse_by_shape(col, formats))], *[C.parse_ntz(col, f).cast("string").alias(f"w{i}") for i, f in enumerate(formats)]).collect()
    hits = 0
    for r in got:
        for i in range(len(formats)):
            assert r[f"g{i}"] == r[f"w{i}"]
            hits += r[f"g{i}"] is not None
    assert hits > 30
