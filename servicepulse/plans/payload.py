"""JSON encoding of result tables (the payload of an insight request).

Each row becomes one JSON object (JSON Lines); missing values are written
as ``null`` (never the invalid bare ``NaN``), timestamps as text.  Encoding
is a per-row native expression: no row is collected to the driver and no
group is gathered into one task.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clean(df: DataFrame, decimals: Optional[int] = None) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
            c = c if decimals is None else c.try_cast(T.DecimalType(38, decimals))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def to_json_lines(df: DataFrame, name: str = "json", decimals: Optional[int] = None) -> DataFrame:
    """One JSON text per row, nulls kept as ``null``; with ``decimals``
    fractional numbers are written with that many fixed decimals."""
    clean = _clean(df, decimals)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]), {"ignoreNullFields": "false"}).alias(name))


def count_map(long: DataFrame, key: str, name_col: str, count_col: str = "count", out: str = "counts") -> DataFrame:
    """Nested form of a (key, name, count) table: one row per key with a
    ``{name: count}`` map, as the summary payload nests category counts
    inside each request type.  Each map gathers the distinct names of one
    key (e.g. the eight categories), never raw rows."""
    entries = F.collect_list(F.struct(F.col(f"`{name_col}`").cast("string").alias("k"), F.col(f"`{count_col}`").alias("v")))
    return long.where(F.col(f"`{name_col}`").isNotNull()).groupBy(key).agg(F.map_from_entries(entries).alias(out))


def payload(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, json) rows for a dict of result tables."""
    parts = [to_json_lines(df).select(F.lit(section).alias("section"), "json") for section, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
