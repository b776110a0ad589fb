"""File sources: CSV (file or directory) and feature-collection JSON.

Reads are plain ``spark.read`` calls, so a directory of files is read in
parallel and Parquet-style pruning applies wherever the format allows.
"""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators.topk import first_rows
from .csv_tables import load_csv
from .feature_json import read_split_features


def read_csv(
    spark: SparkSession,
    path: Union[str, Sequence[str]],
    schema: Optional[Union[T.StructType, str]] = None,
    sampling_ratio: float = 1.0,
    **options: str,
) -> DataFrame:
    """CSV with a header row; blank fields read as NULL.

    Without ``schema`` every file is read by its own header and once only: see
    ``csv_tables.load_csv``, which also reports columns of mixed values.  Dates with a time are kept as text (as pandas
    does), so the date coercion parses them without the session time zone.  With a ``schema`` (by
    position, for files of one header) nothing is inferred; a ``sampling_ratio`` below 1 infers from a sample by
    Spark's own rules, and later values that do not fit are NULL.
    """
    if schema is None and sampling_ratio >= 1.0:
        glob = options.pop("pathGlobFilter", None)
        return load_csv(spark, path, glob, **options).rows
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is None:
        inferred = reader.option("inferSchema", "true").option("samplingRatio", str(sampling_ratio)).csv(path).schema
        schema = T.StructType([
            T.StructField(f.name, T.StringType(), True) if isinstance(f.dataType, T.TimestampType) else f
            for f in inferred.fields
        ])
    return reader.schema(schema).csv(path)


def read_csv_dir(spark: SparkSession, directory: str, **kw) -> DataFrame:
    """All ``*.csv`` files of a directory, columns by name: files may order or have them differently."""
    return read_csv(spark, directory, pathGlobFilter="*.csv", **kw)


def flatten_features(doc: DataFrame) -> DataFrame:
    """One row per element of ``features``: the ``attributes`` fields plus
    ``longitude``/``latitude`` from ``geometry.x``/``geometry.y`` when the
    documents carry a geometry."""
    return _flat(doc.select(F.explode("features").alias("f")), doc.schema["features"].dataType.elementType)


def _flat(feats: DataFrame, ftype: T.StructType) -> DataFrame:
    """The columns of elements ``f`` of type ``ftype``."""
    names = ftype.fieldNames()
    cols = [F.col("f.attributes.*")] if "attributes" in names else []
    if "geometry" in names:
        geo = ftype["geometry"].dataType
        gnames = geo.fieldNames() if isinstance(geo, T.StructType) else []
        if "x" in gnames:
            cols.append(F.col("f.geometry.x").cast("double").alias("longitude"))
        if "y" in gnames:
            cols.append(F.col("f.geometry.y").cast("double").alias("latitude"))
    return feats.select(*cols)


def read_features(
    spark: SparkSession, path: Union[str, Sequence[str]], schema: Optional[T.StructType] = None, multi_line: Optional[bool] = None
) -> DataFrame:
    """Feature-collection JSON documents; ``schema`` is that of a document.

    By default documents are cut at the borders of their elements and read by many tasks, whether they come as
    one large document, as page files or one per line (see ``feature_json``).  ``multi_line`` leaves the reading to Spark's JSON
    source: true for one document per file, each parsed whole by one task; false for one document per line.
    """
    if multi_line is None:
        element = schema["features"].dataType.elementType if schema is not None else None
        rows = read_split_features(spark, path, element)
        if not rows.columns:
            raise ValueError(f"no features in {path}; pass a schema to read documents without any")
        return _flat(rows.select(F.struct("*").alias("f")), rows.schema)
    reader = spark.read.option("multiLine", "true" if multi_line else "false")
    if schema is not None:
        reader = reader.schema(schema)
    return flatten_features(reader.json(path))


def limit_records(df: DataFrame, n: int = K.DEFAULT_RECORD_LIMIT, order_by: Optional[Sequence[str]] = None) -> DataFrame:
    """First ``n`` records; with ``order_by`` (all columns by default) the
    choice is stable.  Bounded per task for every ``n`` (``topk.first_rows``)."""
    keys = list(order_by) if order_by is not None else list(df.columns)
    if not keys:
        return df.limit(n)
    return first_rows(df, keys, n)
