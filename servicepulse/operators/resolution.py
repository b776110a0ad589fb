"""Resolution time: hours from created to closed, open tickets aged to
``as_of``.  One projection, no shuffle."""

from __future__ import annotations

import datetime as _dt
from typing import Optional, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..roles import frame_roles
from .standardise import coerce_timestamp

AsOf = Union[None, str, _dt.datetime, Column]


def as_of_column(as_of: AsOf, df: Optional[DataFrame] = None) -> Column:
    """Reference instant as a zone-less timestamp; default: the local now.

    The clock is read once, here: every job over the frame sees the same
    instant.  Only a stream takes the time of each micro-batch.
    """
    if as_of is None:
        if df is None or df.isStreaming:
            return F.localtimestamp()
        as_of = df.sparkSession.sql("SELECT CAST(localtimestamp() AS STRING)").first()[0]
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def with_resolution(df: DataFrame, as_of: AsOf = None, created: Optional[str] = None, closed: Optional[str] = None) -> DataFrame:
    """Add ``resolution_hours``, ``is_resolved`` and ``hours_since_creation``.

    Open tickets (closed date missing) get their age at ``as_of`` as
    resolution time.  Without both date columns: hours NULL, resolved False,
    and no age column.
    """
    roles = frame_roles(df, created=created, closed=closed)
    if roles.created is None or roles.closed is None:
        return df.withColumns({K.HOURS_COL: F.lit(None).cast("double"), K.RESOLVED_COL: F.lit(False)})
    types = {f.name: f.dataType for f in df.schema.fields}
    created_c = coerce_timestamp(C.qcol(roles.created), types[roles.created], epoch_millis=True)
    closed_c = coerce_timestamp(C.qcol(roles.closed), types[roles.closed], epoch_millis=True)
    now = as_of_column(as_of, df)
    resolved = closed_c.isNotNull()
    # Age first, in its own projection, so the open-ticket branch reuses it
    # instead of repeating the date arithmetic.
    df = df.withColumn(K.AGE_COL, C.hours_between(created_c, now))
    hours = F.when(resolved, C.hours_between(created_c, closed_c)).otherwise(F.col(K.AGE_COL))
    out = df.withColumns({K.HOURS_COL: hours, K.RESOLVED_COL: resolved})
    cols = [c for c in out.columns if c != K.AGE_COL]
    # Column order as before: ..., resolution_hours, is_resolved, hours_since_creation.
    return out.select(*[C.qcol(c) for c in cols], F.col(K.AGE_COL))


def ticket_age(df: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Only the age of every ticket at ``as_of`` (hours, may be negative)."""
    roles = frame_roles(df)
    roles.require("created")
    types = {f.name: f.dataType for f in df.schema.fields}
    created_c = coerce_timestamp(C.qcol(roles.created), types[roles.created], epoch_millis=True)
    return df.withColumn(K.AGE_COL, C.hours_between(created_c, as_of_column(as_of, df)))
