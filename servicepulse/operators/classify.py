"""Targets and performance classification, and the full enrichment."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..roles import frame_roles
from .resolution import AsOf, with_resolution
from .standardise import standardise


def type_column_name(df: DataFrame, override: Optional[str] = None) -> str:
    """Request-type column of ``df`` (the broad keyword rule), or the default."""
    return override or frame_roles(df).request_type or K.DEFAULT_TYPE_COL


def classify(df: DataFrame, targets=None, request_type: Optional[str] = None) -> DataFrame:
    """Add ``target_hours``, ``performance_ratio``, ``performance_category``.

    Without a request-type column a constant ``SR_TYPE='UNKNOWN'`` is added.
    """
    tcol = type_column_name(df, request_type)
    if tcol not in df.columns:
        df = df.withColumn(tcol, F.lit(K.UNKNOWN_TYPE))
    target = C.target_hours(C.qcol(tcol), targets)
    ratio = F.col(K.HOURS_COL) / F.col(K.TARGET_COL)
    return df.withColumn(K.TARGET_COL, target).withColumns(
        {K.RATIO_COL: ratio, K.CATEGORY_COL: C.performance_category(ratio, F.col(K.RESOLVED_COL))}
    )


def enrich(df: DataFrame, as_of: AsOf = None, *, standardised: bool = False, targets=None, **std_options) -> DataFrame:
    """Standardise (unless already done), add resolution time, classify.

    Role overrides among ``std_options`` hold for all steps and for the reports
    over the result.
    """
    if not standardised:
        df = standardise(df, **std_options)
    return classify(with_resolution(df, as_of), targets)
