"""Shared aggregate-column builders.

All of them are plain declarative aggregates (partial aggregation on the map
side, fixed-size buffers), so a hot group never gathers its rows in one task.
The reference semantics they encode:

* "meets target" is ``ratio <= 1.1``; a missing ratio counts as *not met*
  but stays in the denominator;
* means skip missing values;
* "resolved only" variants look at rows with ``is_resolved``.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def meets(ratio: Column) -> Column:
    """True when the ratio meets the target, False otherwise (never NULL)."""
    return F.coalesce(ratio <= F.lit(K.MEETS_TARGET_RATIO), F.lit(False))


def rows_where(cond: Optional[Column]) -> Column:
    """Number of rows satisfying ``cond`` (all rows when None)."""
    if cond is None:
        return F.count(F.lit(1))
    return F.count_if(F.coalesce(cond, F.lit(False)))


def avg_where(value: Column, cond: Optional[Column] = None) -> Column:
    return F.avg(value if cond is None else F.when(cond, value))


def met_count(ratio: Column, cond: Optional[Column] = None) -> Column:
    hit = meets(ratio) if cond is None else (meets(ratio) & F.coalesce(cond, F.lit(False)))
    return F.count_if(hit)


def pct(numer: Column, denom: Column) -> Column:
    """``numer / denom * 100`` as double; NULL when the denominator is 0."""
    return F.when(denom > 0, numer.cast("double") / denom.cast("double") * F.lit(100.0))


def met_pct(ratio: Column, cond: Optional[Column] = None, empty_value: Optional[float] = None) -> Column:
    """Percentage of rows (optionally restricted by ``cond``) meeting target.

    ``empty_value`` replaces the result when no row qualifies (the reference
    uses 0 for some reports and leaves the key out for others).
    """
    out = pct(met_count(ratio, cond), rows_where(cond))
    return out if empty_value is None else F.coalesce(out, F.lit(float(empty_value)))


def rate(cond: Column) -> Column:
    """Percentage of all rows of the group where ``cond`` holds."""
    return pct(F.count_if(F.coalesce(cond, F.lit(False))), F.count(F.lit(1)))
