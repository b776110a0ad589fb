"""CSV and feature-collection sources."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicepulse import constants as K
from servicepulse.operators.classify import enrich
from servicepulse.session import scratch_path

from request_paths import local_dir
from servicepulse.sources import csv_tables, feature_json, files
from servicepulse.sources.csv_tables import load_csv


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_feature_collection(spark):
    base = local_dir(scratch_path(spark, "features-test"))
    doc = {"features": [
        {"attributes": {"SR_TYPE": "Pothole", "CREATED_DATE": 1704067200000, "CLOSED_DATE": 1704153600000, "ZIP": "33101"},
         "geometry": {"x": -80.5, "y": 25.7}},
        {"attributes": {"SR_TYPE": "Graffiti", "CREATED_DATE": 1704067200000, "CLOSED_DATE": None, "ZIP": None}},
    ]}
    _write(os.path.join(base, "page1.json"), json.dumps(doc, indent=2))
    df = files.read_features(spark, base)
    assert set(df.columns) == {"SR_TYPE", "CREATED_DATE", "CLOSED_DATE", "ZIP", "longitude", "latitude"}
    e = enrich(df, as_of="2024-01-03 00:00:00").orderBy("SR_TYPE").collect()
    assert e[0].SR_TYPE == "Graffiti" and e[0].longitude is None and not e[0][K.VALID_COORDS_COL]
    assert e[0][K.HOURS_COL] == 48.0  # epoch millis read as dates, open ticket aged
    assert e[1][K.HOURS_COL] == 24.0 and e[1][K.VALID_COORDS_COL]


def test_csv_directory_reads_all_files(spark):
    base = local_dir(scratch_path(spark, "csv-test"))
    _write(os.path.join(base, "a.csv"), "SR_TYPE,CREATED_DATE\nTrash,2024-01-01\n")
    _write(os.path.join(base, "b.csv"), "SR_TYPE,CREATED_DATE\nTree,2024-01-02\nTree,\n")
    _write(os.path.join(base, "notes.txt"), "ignored")
    df = files.read_csv_dir(spark, base)
    assert df.count() == 3 and df.where(F.col("CREATED_DATE").isNull()).count() == 1


def test_limit_records_is_stable(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    assert [r.x for r in files.limit_records(df, 3).collect()] == [0, 1, 2]


def _csv_folder(spark, name, parts):
    base = local_dir(scratch_path(spark, name))
    for f, text in parts.items():
        _write(os.path.join(base, f), text)
    return base


def test_csv_directory_of_different_headers(spark):
    base = _csv_folder(spark, "csv-headers", {
        "a.csv": "SR_ID,STATUS,ZIP\n1,OPEN,33101\n2,CLOSED,\n",
        "b.csv": "\nzip,SR_ID,Status,EXTRA\n33102,3,OPEN,x\n",
        "c.csv": '"EXTRA","SR_ID"\n"y, z",4\n',
        "d.csv": "",
    })
    df = files.read_csv_dir(spark, base)
    assert df.columns == ["SR_ID", "STATUS", "ZIP", "EXTRA"]
    assert dict(df.dtypes) == {"SR_ID": "int", "STATUS": "string", "ZIP": "int", "EXTRA": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, "OPEN", 33101, None), (2, "CLOSED", None, None), (3, "OPEN", 33102, "x"), (4, None, None, "y, z")]


def test_csv_types_of_all_values_in_one_read(spark):
    head = "whole,long,wide,real,flag,day,late,time,empty,,Dup,dup"
    lines = [f"{i},{i},{i},{i}.5,true,2024-01-{i + 1:02d},{i},2024-01-01T00:00:00.000Z,,q,1,2" for i in range(28)]
    lines.append("-5,9999999999,123456789012345678901234567890,1e3,FALSE,2024-02-29,n/a,x,,q,1,b")
    base = _csv_folder(spark, "csv-types", {"t.csv": "\n".join([head, *lines]) + "\n"})
    table = load_csv(spark, base)
    assert table.types == {
        "whole": "int", "long": "bigint", "wide": "decimal(38,0)", "real": "double", "flag": "boolean", "day": "date", "late": "string", "time": "string",
        "empty": "string", "_c9": "string", "Dup10": "int", "dup11": "string"}
    assert table.conflicts() == {"late": 28, "dup11": 28}
    assert {r["column_name"] for r in table.report().where("conflict").collect()} == {"late", "dup11"}
    os.remove(os.path.join(base, "t.csv"))  # all of it has been read
    last = table.rows.where("late = 'n/a'").first()
    assert (last["whole"], last["long"], str(last["wide"]), last["real"], last["flag"], str(last["day"])) == (-5, 9999999999, "123456789012345678901234567890", 1000.0, False, "2024-02-29")
    assert table.rows.agg(F.sum("whole")).first()[0] == sum(range(28)) - 5 and table.filled["empty"] == 0


def test_csv_kinds_of_odd_values(spark):
    """Each value by the plain meaning of its kind; text that only resembles another kind stays text."""
    t = csv_tables
    want = {
        None: None, "": t.TEXT, "5": t.INT, "+5": t.INT, "-2147483648": t.INT, "2147483648": t.LONG, "9" * 25: t.WIDE, "9" * 39: t.DOUBLE, "5\n": t.INT, "5\r\n": t.INT,
        ".5": t.DOUBLE, "5.": t.DOUBLE, "-.5e-3": t.DOUBLE, "1E+400": t.DOUBLE, "1.5.2": t.TEXT, "+": t.TEXT, ".": t.TEXT, " 5": t.TEXT, "1d": t.TEXT, "3,4": t.TEXT, "/": t.TEXT,
        "NaN": t.DOUBLE, "nan": t.TEXT, "Inf": t.DOUBLE, "-Infinity": t.DOUBLE, "+Inf": t.TEXT, "tRUE": t.BOOL, "False": t.BOOL, "true\n": t.TEXT, "t": t.TEXT,
        "2024-02-29": t.DATE, "2024-02-30": t.TEXT, "2024-01-01\n": t.DATE, "2024-01-01T00:00:00": t.TEXT, "10:30": t.TEXT, "-2024-01-01": t.TEXT, "\u0661\u0662": t.TEXT, "\U0001f600": t.TEXT}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    assert {r.v: r.k for r in df.select("v", t.kind_of(F.col("v")).alias("k")).collect()} == want


def test_csv_kinds_do_not_write_their_patterns_out_for_every_column(spark):
    """A plan as long as the columns are many makes a method that the JVM does not compile."""
    found = {}
    for n in (2, 40):
        df = spark.createDataFrame([tuple(str(i) for i in range(n)), tuple("x" for _ in range(n))], ", ".join(f"c{i} string" for i in range(n)))
        kinds = csv_tables._kinds(df)
        found[n] = kinds._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike")
        assert sorted(map(tuple, kinds.collect())) == [(i, csv_tables.INT | csv_tables.TEXT, 2, 1) for i in range(n)]
    assert found[2] == found[40] > 0


def test_csv_of_the_same_arguments_is_not_read_again(spark, monkeypatch):
    base = _csv_folder(spark, "csv-reuse", {"a.csv": "k,v\n1,x\n2,y\n"})
    first = load_csv(spark, base, "*.csv")
    assert first.rows.count() == 2
    writes = []
    monkeypatch.setattr(csv_tables, "_write", lambda *a, w=csv_tables._write: (writes.append(1), w(*a))[1])
    again = load_csv(spark, base, "*.csv")
    assert not writes and again.types == first.types and sorted(again.rows.collect()) == sorted(first.rows.collect())
    load_csv(spark, base, "*.csv", sep=";")
    assert len(writes) == 1
    _write(os.path.join(base, "a.csv"), "k,v\n1,x\n2,y\n3,late\n")
    assert load_csv(spark, base, "*.csv").rows.count() == 3 and len(writes) == 2
    _write(os.path.join(base, "b.csv"), "v,k\nz,text\n")
    assert load_csv(spark, base, "*.csv").types == {"k": "string", "v": "string"} and len(writes) == 3


def test_csv_without_any_header(spark):
    with pytest.raises(ValueError):
        load_csv(spark, _csv_folder(spark, "csv-none", {"a.csv": "", "b.csv": "\n"}))
    only = load_csv(spark, _csv_folder(spark, "csv-head", {"a.csv": "x,y\n"}))
    assert only.rows.count() == 0 and only.types == {"x": "string", "y": "string"}


NASTY = ['{"attributes": "fake"}', '}}]]', '"features": [{', 'back\\slash', 'q"uote', "line\nbreak", "é漢😀", "\\", '\\"}', ""]


def _nasty_document(n, seed=0):
    """A document with other arrays of objects before and after, nested values, and strings that look like structure."""
    import random

    rng = random.Random(seed)
    feature = lambda i: {
        "attributes": {"SR_ID": i, "note": rng.choice(NASTY), "tags": {"a": [{"b": rng.choice(NASTY)}, [1, 2]]}},
        "geometry": {"x": i / 8, "y": -i / 8}}
    return {"fields": [{"attributes": {"SR_ID": -1}}, [{"features": [{"attributes": {"SR_ID": -2}}]}]], "features}": [{"attributes": {"SR_ID": -3}}], "name": "x}y",
            "features": [feature(i) for i in range(n)], "more": {"features": [{"attributes": {"SR_ID": -4}}]}, "last": [{"attributes": {"SR_ID": -5}}]}


@pytest.mark.parametrize("layout", ["compact", "pretty", "lines", "pages"])
@pytest.mark.parametrize("size", [97, 1500, 10_000_000])
def test_features_of_one_document_are_read_by_ranges(spark, layout, size):
    docs = [_nasty_document(n, n) for n in ([60] if layout in ("compact", "pretty") else [20, 0, 15, 1])]
    want = sorted(((f["attributes"]["SR_ID"], f["attributes"]["note"], f["attributes"]["tags"]["a"][0]["b"], f["geometry"]["x"]) for d in docs for f in d["features"]), key=str)
    if layout == "pages":
        parts = {f"p{i}.json": json.dumps(d, indent=1, ensure_ascii=bool(i % 2)) for i, d in enumerate(docs)}
    else:
        parts = {"all.json": "\n".join(json.dumps(d, indent=2 if layout == "pretty" else None, ensure_ascii=False) for d in docs) + "\n"}
    base = _csv_folder(spark, "feature-ranges", parts)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        texts = [json.loads(r.value) for r in feature_json.feature_texts(spark, base).collect()]
        if size < 1000:
            assert spark.read.option("lineSep", "}").text(base).rdd.getNumPartitions() > 20  # ranges smaller than an element
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(((t["attributes"]["SR_ID"], t["attributes"]["note"], t["attributes"]["tags"]["a"][0]["b"], t["geometry"]["x"]) for t in texts), key=str) == want


def test_features_without_any_need_a_schema(spark):
    base = _csv_folder(spark, "feature-none", {"a.json": '{"features": [], "fields": [{"a": 1}]}'})
    with pytest.raises(ValueError):
        files.read_features(spark, base)
    schema = T.StructType.fromDDL("features array<struct<attributes: struct<SR_ID: long>>>")
    assert files.read_features(spark, base, schema).collect() == []
    base = _csv_folder(spark, "feature-some", {"a.json": '{"features": [null, {"attributes": {"SR_ID": 7, "z": 1}}, 5]}'})
    assert [tuple(r) for r in files.read_features(spark, base, schema).collect()] == [(7,)]


def test_feature_pages_are_put_together_where_the_rows_are(spark):
    """Pages need no shuffle: 1000 consecutive features each, whatever the batches."""
    from __spark_entry__ import _pages

    values = [f'{{"attributes":{{"SR_ID":{i}}}}}' for i in range(2345)]
    batches = [pa.RecordBatch.from_pydict({"value": values[lo:hi]}) for lo, hi in ((0, 700), (700, 700), (700, 2100), (2100, 2345))]
    pages = [json.loads(v)["features"] for b in _pages(iter(batches)) for v in b.column("value").to_pylist()]
    assert [len(p) for p in pages] == [1000, 1000, 345] and [f["attributes"]["SR_ID"] for p in pages for f in p] == list(range(2345))


def test_feature_records_carry_no_paths(spark, monkeypatch):
    """Records are a few bytes long, so what stands beside each is a number; texts are written compressed."""
    base = _csv_folder(spark, "feature files ü", {f"a b{i}.json": json.dumps({"features": [{"attributes": {"SR_ID": i, "t": "x\r\ny"}}] * 3}, indent=1) for i in range(3)})
    sent = []
    monkeypatch.setattr(feature_json, "map_arrow", lambda df, fn, schema, m=feature_json.map_arrow: (sent.append(dict(df.dtypes)), m(df, fn, schema))[1])
    rows = feature_json.read_split_features(spark, base)
    assert sorted(r[0] for r in rows.select("attributes.SR_ID").collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and {r[0] for r in rows.select("attributes.t").collect()} == {"x\r\ny"}
    assert len(sent) == 2 and all("string" not in s.values() for s in sent)
    assert all(f.endswith(".gz") for f in rows.inputFiles())
