"""Column-role resolution (which input column plays which part).

Roles are found by case-insensitive keywords in the column names, first match
in column order, then an exact-name fallback list.  This is plain Python over
``df.columns``: it never triggers a Spark job.

Overridden roles are written into the metadata of their columns (``mark_roles``),
so every later step finds them again with ``frame_roles``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Iterable, Optional, Sequence

from pyspark.sql import DataFrame

# --- fixed values: exact-name fallbacks tried when the keyword rule misses.
CREATED_FALLBACKS = ("CREATED_DATE", "CREATION_DATE", "OPEN_DATE", "CREATEDATE", "SR_CREATE_DATE", "CreateDate")
CLOSED_FALLBACKS = ("CLOSED_DATE", "CLOSURE_DATE", "RESOLUTION_DATE", "CLOSEDATE", "SR_CLOSED_DATE", "CloseDate")
TYPE_FALLBACKS = ("SR_TYPE", "SERVICE_TYPE", "REQUEST_TYPE", "CASE_TYPE", "ISSUETYPE", "Category")


@dataclass(frozen=True)
class Roles:
    """Input column chosen for each role (``None`` when absent)."""

    date_columns: tuple[str, ...] = ()
    priority: Optional[str] = None
    emergency_flags: tuple[str, ...] = ()
    method: Optional[str] = None
    created: Optional[str] = None
    closed: Optional[str] = None
    request_type: Optional[str] = None
    status: Optional[str] = None
    zip: Optional[str] = None
    latitude: Optional[str] = None
    longitude: Optional[str] = None
    extra: dict = field(default_factory=dict)

    def require(self, *names: str) -> None:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise ValueError(f"required column role(s) not found: {', '.join(missing)}")


def _first(columns: Sequence[str], pred) -> Optional[str]:
    return next((c for c in columns if pred(c.lower())), None)


def _fallback(columns: Sequence[str], names: Iterable[str]) -> Optional[str]:
    present = set(columns)
    return next((n for n in names if n in present), None)


def resolve_roles(columns: Sequence[str], **overrides: Optional[str]) -> Roles:
    """Resolve roles from column names; keyword arguments override a role."""
    cols = list(columns)
    roles = Roles(
        date_columns=tuple(c for c in cols if "date" in c.lower() or "time" in c.lower()),
        priority=_first(cols, lambda c: "priority" in c),
        emergency_flags=tuple(c for c in cols if "emergency" in c.lower() or "urgent" in c.lower()),
        method=_first(cols, lambda c: "method" in c or "source" in c or "channel" in c),
        created=_first(cols, lambda c: "creat" in c and "date" in c) or _fallback(cols, CREATED_FALLBACKS),
        closed=_first(cols, lambda c: ("clos" in c or "resolv" in c or "complet" in c) and "date" in c)
        or _fallback(cols, CLOSED_FALLBACKS),
        request_type=_first(cols, lambda c: ("type" in c or "category" in c or "issue" in c) and "sr" in c)
        or _fallback(cols, TYPE_FALLBACKS),
        status=_first(cols, lambda c: "status" in c),
        zip=_first(cols, lambda c: "zip" in c),
        latitude="latitude" if "latitude" in cols else None,
        longitude="longitude" if "longitude" in cols else None,
    )
    unknown = set(overrides) - SINGLE_ROLES
    if unknown:
        raise ValueError(f"unknown column role(s): {', '.join(sorted(unknown))}")
    known = {k: v for k, v in overrides.items() if v is not None}
    absent = sorted(v for v in known.values() if v not in cols)
    if absent:
        raise ValueError(f"column(s) given for a role do not exist: {', '.join(absent)}")
    if not known:
        return roles
    # A date column given by name is a date column whatever it is called.
    dates = [known[r] for r in ("created", "closed") if r in known]
    return replace(roles, **known, date_columns=tuple(dict.fromkeys([*roles.date_columns, *dates])))


#: Roles that one column plays; these can be overridden.
SINGLE_ROLES = frozenset(("priority", "method", "created", "closed", "request_type", "status", "zip", "latitude", "longitude"))
_ROLE_KEY = "servicepulse.roles"


def mark_roles(df: DataFrame, roles: Roles, overrides: Iterable[str]) -> DataFrame:
    """Note the overridden roles in the metadata of their columns."""
    noted: dict[str, list[str]] = {}
    for role in overrides:
        if getattr(roles, role) is not None:
            noted.setdefault(getattr(roles, role), []).append(role)
    for name, played in noted.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, _ROLE_KEY: sorted(played)})
    return df


def frame_roles(df: DataFrame, **overrides: Optional[str]) -> Roles:
    """Roles of a frame: the given ones, else those noted by ``mark_roles``, else by name."""
    noted = {role: f.name for f in df.schema.fields for role in f.metadata.get(_ROLE_KEY, [])}
    given = {k: v for k, v in overrides.items() if v is not None}
    return resolve_roles(df.columns, **{**noted, **given})
