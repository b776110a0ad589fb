"""Column builders: every per-row rule as a native Catalyst expression.

Nothing here is a Python UDF; each function returns a ``Column`` that stays
inside whole-stage code generation.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def qcol(name: str) -> Column:
    """Column by name, back-quoted so names like ``model-year`` work."""
    return F.col(f"`{name}`")


def as_text(c: Column) -> Column:
    return c.cast("string")


def canon_priority(raw: Column, mapping: Optional[dict] = None) -> Column:
    """Upper-case, exact map to HIGH/MEDIUM/NORMAL/LOW; anything else NORMAL.

    No trimming: `` HIGH`` stays unmapped, as in the reference behaviour.
    """
    mapping = mapping or K.PRIORITY_MAP
    u = F.upper(as_text(raw))
    # One lookup in a literal map (compact generated code) instead of a CASE.
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, u), F.lit(K.DEFAULT_PRIORITY))


def infer_priority(flags: Sequence[Column]) -> Column:
    """HIGH if any emergency/urgent flag reads YES/Y/TRUE/1, else NORMAL."""
    if not flags:
        return F.lit(K.DEFAULT_PRIORITY)
    hits = [F.coalesce(F.upper(as_text(c)).isin(*K.EMERGENCY_TRUE_VALUES), F.lit(False)) for c in flags]
    return F.when(reduce(lambda a, b: a | b, hits), F.lit("HIGH")).otherwise(F.lit(K.DEFAULT_PRIORITY))


def _settled_label(label: str, after: int, rules, keep_email: bool) -> str:
    """Label left after the rules following position ``after`` re-test it.

    The mapping is applied as a sequence of overwrites, so a label assigned
    by one rule is matched again by every later rule.  This folds that over
    the fixed rule list (constants only, no data).
    """
    cur = label
    for key, lab in rules[after + 1:]:
        if keep_email and cur == "EMAIL":
            break
        if key in cur:
            cur = lab
    return cur


def canon_method(raw: Column, keep_email: bool = False, rules=None) -> Column:
    """Canonical intake method from ordered substring rules.

    The first rule whose key is contained in the upper-cased text assigns
    the label; later rules then re-test that label, which turns EMAIL into
    OTHER (the MAIL rule).  ``keep_email`` keeps EMAIL.  Text no rule
    matches, and NULL, ends as UNKNOWN.
    """
    rules = tuple(rules or K.METHOD_MAP)
    u = F.upper(as_text(raw))
    labels = sorted({lab for _, lab in rules})
    expr = None
    for i, (key, label) in enumerate(rules):
        out = F.lit(_settled_label(label, i, rules, keep_email))
        expr = F.when(u.contains(key), out) if expr is None else expr.when(u.contains(key), out)
    fallback = F.when(u.isin(*labels), u).otherwise(F.lit(K.UNKNOWN_METHOD))
    # coalesce makes the result provably non-null for the optimizer.
    return F.coalesce(expr.otherwise(fallback), F.lit(K.UNKNOWN_METHOD))


def to_double(c: Column) -> Column:
    """Numeric coercion; unparsable text and NaN become NULL."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def valid_coords(lat: Column, lon: Column, box=None) -> Column:
    """Strict bounding-box test; missing coordinates give False, never NULL."""
    lat_min, lat_max, lon_min, lon_max = box or (K.LAT_MIN, K.LAT_MAX, K.LON_MIN, K.LON_MAX)
    inside = (lat > lat_min) & (lat < lat_max) & (lon > lon_min) & (lon < lon_max)
    return F.coalesce(inside, F.lit(False))


def micros_between(start: Column, end: Column) -> Column:
    """Exact microseconds from ``start`` to ``end``.

    Zone-less timestamps are subtracted as an interval (wall-clock
    arithmetic): ``timestamp_diff`` would pass through the session time zone
    and lose an hour across a DST gap.
    """
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(1000000)).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours from ``start`` to ``end`` (negative when end < start)."""
    return micros_between(start, end) / F.lit(3.6e9)


def target_hours(request_type: Column, targets=None, default: int = K.DEFAULT_TARGET_HOURS) -> Column:
    """Target hours by ordered substring match on the upper-cased type."""
    targets = targets or K.RESOLUTION_TARGETS
    u = F.coalesce(F.upper(as_text(request_type)), F.lit(""))
    expr = None
    for key, hours in targets:
        cond = u.contains(key)
        expr = F.when(cond, F.lit(int(hours))) if expr is None else expr.when(cond, F.lit(int(hours)))
    return expr.otherwise(F.lit(int(default))) if expr is not None else F.lit(int(default))


def performance_category(ratio: Column, resolved: Column) -> Column:
    """Performance label; open tickets get the two In-Progress labels."""
    return (
        F.when(ratio.isNull(), F.lit(K.CATEGORY_UNKNOWN))
        .when(~resolved & (ratio <= K.RATIO_GOOD), F.lit(K.CATEGORY_OPEN_WITHIN))
        .when(~resolved, F.lit(K.CATEGORY_OPEN_EXCEEDING))
        .when(ratio <= K.RATIO_EXCELLENT, F.lit(K.CATEGORY_EXCELLENT))
        .when(ratio <= K.RATIO_GOOD, F.lit(K.CATEGORY_GOOD))
        .when(ratio <= K.RATIO_ON_TARGET, F.lit(K.CATEGORY_ON_TARGET))
        .when(ratio <= K.RATIO_DELAYED, F.lit(K.CATEGORY_DELAYED))
        .otherwise(F.lit(K.CATEGORY_SEVERE))
    )


def priority_rank(priority: Column) -> Column:
    """Ordinal rank HIGH=0 < MEDIUM < NORMAL < LOW; anything else last."""
    expr = None
    for i, p in enumerate(K.PRIORITY_ORDER):
        expr = F.when(priority == F.lit(p), F.lit(i)) if expr is None else expr.when(priority == F.lit(p), F.lit(i))
    return expr.otherwise(F.lit(len(K.PRIORITY_ORDER)))


def season(month: Column) -> Column:
    """Season label from a month number 1..12 (calendar quarters)."""
    w, sp, su, fa = K.SEASONS
    return (
        F.when(month.between(1, 3), F.lit(w))
        .when(month.between(4, 6), F.lit(sp))
        .when(month.between(7, 9), F.lit(su))
        .when(month.between(10, 12), F.lit(fa))
    )


def season_rank(season_col: Column) -> Column:
    expr = None
    for i, s in enumerate(K.SEASONS):
        expr = F.when(season_col == F.lit(s), F.lit(i)) if expr is None else expr.when(season_col == F.lit(s), F.lit(i))
    return expr.otherwise(F.lit(len(K.SEASONS)))


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_millis_to_ntz(ms: Column) -> Column:
    """Epoch milliseconds as a zone-less timestamp (UTC wall clock), by
    timestamp arithmetic -- independent of the session time zone."""
    return F.timestamp_add("MILLISECOND", ms.cast("long"), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def parse_ntz(text: Column, fmt: str) -> Column:
    """Parse text with a datetime pattern into a zone-less timestamp, NULL
    when it does not parse.  The text is read with an explicit +0000 offset
    and rebuilt by wall-clock arithmetic from the epoch, so local times that
    do not exist in the session time zone (DST gaps) are kept as written."""
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(fmt + " Z"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def format_shape(fmt: str) -> str:
    """Regular expression that every text of a datetime pattern matches: which
    fields are digits or letters, and what stands between them."""
    out = []
    for part in re.finditer(r"'(?:[^']|'')*'|([A-Za-z])\1*|.", fmt):
        text, letter = part.group(0), part.group(1)
        if text[0] == "'":
            out.append(re.escape(text[1:-1].replace("''", "'") or "'"))
        elif letter is None:
            out.append({"[": "(?:", "]": ")?"}.get(text) or re.escape(text))
        elif letter in "XxZzVO":
            out.append(".+")
        elif letter in "aBGE" or letter in "MLQq" and len(text) >= 3:
            out.append(r"[\p{L}. ]+")
        else:
            out.append(r"[+-]?\d+")
    return "(?iu)^" + "".join(out) + "$"


def parse_by_shape(text: Column, formats: Sequence[str]) -> list[Column]:
    """``parse_ntz`` of each format, in order, tried only on texts of its shape
    (a try that fails costs an exception; a shape that fails does not)."""
    return [F.when(text.rlike(format_shape(fmt)), parse_ntz(text, fmt)) for fmt in formats]


def ntz_to_epoch_millis(ts: Column) -> Column:
    """Inverse of ``epoch_millis_to_ntz`` (zone-independent)."""
    micros = micros_between(F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts)
    return F.floor(micros.cast("decimal(20,0)") / F.lit(1000)).cast("long")


def month_label(ts: Column) -> Column:
    """Calendar month of a timestamp as ``yyyy-MM`` (NULL stays NULL).
    Formatted from the date, so the session time zone plays no part."""
    return F.date_format(ts.cast("date"), "yyyy-MM")


def month_start(ts: Column) -> Column:
    """First instant of the month, zone-less (via the date, zone-independent)."""
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def goal_status(met_pct: Column) -> Column:
    return F.when(met_pct >= K.GOAL_MET_PCT, F.lit(K.GOAL_MEETING)).otherwise(F.lit(K.GOAL_NOT_MEETING))
