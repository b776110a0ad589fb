"""Standardise a raw ticket table: dates, priority, method, coordinates and
missing request types.

Every step is a per-row native expression over the resolved column roles;
the transform is two projections, which fuse into the scan's whole-stage-codegen
stage, never shuffle, and let column pruning reach the scan.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import columns as C
from ..roles import Roles, frame_roles, mark_roles

# Formats tried, in order, for text date columns after the plain ISO cast.
# Single-letter fields accept both padded and unpadded values (1/5 and 01/05).
DEFAULT_DATE_FORMATS: tuple[str, ...] = (
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy h:mm a",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M-d-yyyy h:mm:ss a",
    "M-d-yyyy h:mm a",
    "M-d-yyyy H:mm:ss",
    "M-d-yyyy H:mm",
    "M-d-yyyy",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "yyyy/M/d",
    "yyyy-M-d h:mm:ss a",
    "yyyy-M-d h:mm a",
    "yyyy-M-d H:mm",
    "MMM d, yyyy h:mm a",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy H:mm:ss",
    "d-MMM-yyyy",
)


def rename_clashing(df: DataFrame, names: Sequence[str] = K.ADDED_COLUMNS) -> DataFrame:
    """Rename inputs whose name equals an added column case-insensitively.

    Spark resolves names case-insensitively, so an input ``Priority`` would be
    silently replaced by the added ``PRIORITY``; keep it as ``raw_Priority``.
    """
    targets = {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in targets:
            df = df.withColumnRenamed(c, f"raw_{c}")
    return df


def coerce_timestamp(c: Column, dtype: T.DataType, formats: Sequence[str] = DEFAULT_DATE_FORMATS, epoch_millis: bool = False) -> Column:
    """Parse a column to a zone-less timestamp; unparsable values become NULL.

    * timestamp_ntz: unchanged;  timestamp / date: cast (wall clock kept);
    * text: ISO cast (an explicit offset is dropped, the written wall clock
      kept), then each format in ``formats``;
    * numbers: epoch milliseconds when ``epoch_millis`` (feature JSON dates; a
      fraction of a millisecond is cut off, NaN and out-of-range are NULL),
      otherwise left alone.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        parsed = [c.try_cast("timestamp_ntz")]
        parsed += C.parse_by_shape(c, formats)
        return F.coalesce(*parsed)
    if isinstance(dtype, (T.LongType, T.IntegerType)) and epoch_millis:
        return C.epoch_millis_to_ntz(c)
    if isinstance(dtype, (T.ShortType, T.ByteType, T.FloatType, T.DoubleType, T.DecimalType)) and epoch_millis:
        return C.epoch_millis_to_ntz(F.when(F.abs(c.cast("double")) < 2.0**53, c).try_cast("long"))
    return c


def coerce_dates(df: DataFrame, roles: Optional[Roles] = None, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Coerce every date/time-named column to ``timestamp_ntz``.

    Only text, date and timestamp columns are rewritten, plus numeric columns
    holding the created/closed role (read as epoch milliseconds); other
    numeric ``*time*`` columns (durations) are left alone.
    """
    roles = roles or frame_roles(df)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    role_dates = {roles.created, roles.closed}
    out = []
    for name in df.columns:
        col = C.qcol(name)
        if name in roles.date_columns:
            dt = types[name]
            conv = coerce_timestamp(col, dt, formats, epoch_millis=name in role_dates)
            if conv is not col:
                col = conv.alias(name)
        out.append(col)
    return df.select(*out)


def priority_column(roles: Roles, mapping: Optional[dict] = None) -> Column:
    """Canonical PRIORITY from the first priority column, else from flags."""
    if roles.priority is not None:
        return C.canon_priority(C.qcol(roles.priority), mapping)
    return C.canon_priority(C.infer_priority([C.qcol(c) for c in roles.emergency_flags]), mapping)


def method_column(roles: Roles, keep_email: bool = False) -> Column:
    if roles.method is None:
        return F.lit(K.UNKNOWN_METHOD)
    return C.canon_method(C.qcol(roles.method), keep_email=keep_email)


def drop_empty_rows(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Drop rows whose ``columns`` (default: all) are all NULL.

    A step of its own, for input that has such rows: it must read every column
    it tests, so it is not part of :func:`standardise`.
    """
    names = list(df.columns if columns is None else columns)
    return df.na.drop(how="all", subset=names) if names else df


def standardise(
    df: DataFrame,
    *,
    keep_email: bool = False,
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    box=None,
    priority_map: Optional[dict] = None,
    **role_overrides: Optional[str],
) -> DataFrame:
    """Full standardisation step.

    Adds ``PRIORITY``, ``METHOD_RECEIVED`` and (when both coordinate columns
    exist) ``has_valid_coords``; coerces date columns and coordinates; fills a
    missing request type with ``UNKNOWN``.  ``role_overrides`` (created=...,
    request_type=..., ...) name the column of a role; later steps and reports
    find them again.
    """
    renamed = {c: f"raw_{c}" for c in df.columns if c.lower() in {n.lower() for n in K.ADDED_COLUMNS}}
    df = rename_clashing(df)
    given = {k: renamed.get(v, v) for k, v in role_overrides.items() if v is not None}
    roles = frame_roles(df, **given)
    df = coerce_dates(df, roles, date_formats)

    coords = roles.latitude is not None and roles.longitude is not None
    out = []
    for name in df.columns:
        col = C.qcol(name)
        if coords and name in (roles.latitude, roles.longitude):
            col = C.to_double(col).alias(name)
        elif name == roles.request_type and roles.request_type is not None:
            col = F.coalesce(col.cast("string"), F.lit(K.UNKNOWN_TYPE)).alias(name)
        out.append(col)
    out.append(priority_column(roles, priority_map).alias(K.PRIORITY_COL))
    out.append(method_column(roles, keep_email).alias(K.METHOD_COL))
    df = df.select(*out)
    if coords:
        # A second projection over the converted coordinates: each text
        # value is parsed once per row, not once per comparison.
        lat, lon = C.qcol(roles.latitude), C.qcol(roles.longitude)
        df = df.withColumn(K.VALID_COORDS_COL, C.valid_coords(lat, lon, box))
    return mark_roles(df, roles, given)
