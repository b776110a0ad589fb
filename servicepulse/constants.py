"""Fixed values the results depend on.

Everything in this module must equal the values of the application whose
behaviour this library reproduces; change them only through the override
parameters of the functions that use them.
"""

from __future__ import annotations

# --- fixed values: resolution targets in hours, matched as ordered substrings
# of the upper-cased request type; the first match wins, otherwise DEFAULT.
RESOLUTION_TARGETS: tuple[tuple[str, int], ...] = (
    ("POTHOLE", 72),
    ("STREETLIGHT", 120),
    ("TRAFFIC SIGNAL", 24),
    ("GRAFFITI", 168),
    ("TRASH", 48),
    ("WATER LEAK", 24),
    ("DRAINAGE", 72),
    ("SIDEWALK", 336),
    ("TREE", 120),
)
DEFAULT_TARGET_HOURS = 120

# --- fixed values: priority text (after upper-casing) -> canonical priority;
# anything else, missing included, is NORMAL.
PRIORITY_MAP: dict[str, str] = {
    "1": "HIGH",
    "2": "MEDIUM",
    "3": "NORMAL",
    "4": "LOW",
    "5": "LOW",
    "HIGH": "HIGH",
    "MEDIUM": "MEDIUM",
    "NORMAL": "NORMAL",
    "LOW": "LOW",
    "URGENT": "HIGH",
    "EMERGENCY": "HIGH",
    "CRITICAL": "HIGH",
}
DEFAULT_PRIORITY = "NORMAL"

# --- fixed values: canonical priority order, HIGH first.
PRIORITY_ORDER: tuple[str, ...] = ("HIGH", "MEDIUM", "NORMAL", "LOW")

# --- fixed values: emergency-flag texts (upper-cased) that make a ticket HIGH.
EMERGENCY_TRUE_VALUES: tuple[str, ...] = ("YES", "Y", "TRUE", "1")

# --- fixed values: method substring map, applied in this order, each match
# overwriting the previous label; values outside the label set become UNKNOWN.
METHOD_MAP: tuple[tuple[str, str], ...] = (
    ("PHONE", "PHONE"),
    ("WEB", "WEB"),
    ("APP", "MOBILE APP"),
    ("MOBILE", "MOBILE APP"),
    ("MOBILE APP", "MOBILE APP"),
    ("EMAIL", "EMAIL"),
    ("WALK-IN", "WALK-IN"),
    ("WALKIN", "WALK-IN"),
    ("IN-PERSON", "WALK-IN"),
    ("COUNTER", "WALK-IN"),
    ("FAX", "OTHER"),
    ("MAIL", "OTHER"),
    ("OTHER", "OTHER"),
)
UNKNOWN_METHOD = "UNKNOWN"

# --- fixed values: performance-ratio thresholds and labels.
RATIO_EXCELLENT = 0.5
RATIO_GOOD = 0.9
RATIO_ON_TARGET = 1.1
RATIO_DELAYED = 2.0
CATEGORY_EXCELLENT = "Excellent"
CATEGORY_GOOD = "Good"
CATEGORY_ON_TARGET = "On Target"
CATEGORY_DELAYED = "Delayed"
CATEGORY_SEVERE = "Severely Delayed"
CATEGORY_UNKNOWN = "Unknown"
CATEGORY_OPEN_WITHIN = "In Progress (Within Target)"
CATEGORY_OPEN_EXCEEDING = "In Progress (Exceeding Target)"

# "Meets target" is ratio <= 1.1; goal status threshold on met percentage.
MEETS_TARGET_RATIO = RATIO_ON_TARGET
GOAL_MET_PCT = 80.0
GOAL_MEETING = "Meeting Goal"
GOAL_NOT_MEETING = "Not Meeting Goal"

# --- fixed values: bounding box for valid coordinates (strict inequalities).
LAT_MIN, LAT_MAX = 25.0, 26.5
LON_MIN, LON_MAX = -81.0, -80.0

# --- fixed values: seasons by calendar month (1-3, 4-6, 7-9, 10-12).
SEASONS: tuple[str, ...] = ("Winter", "Spring", "Summer", "Fall")

# --- fixed values: default sizes of the reports.
TOP_TYPES = 10
TOP_ZIPS = 10
TOP_TYPES_PER_ZIP = 5
TOP_ZIPS_PER_TYPE = 5
TOP_TYPES_PER_SEASON = 5
TOP_TYPES_PER_COMPARED_ZIP = 3
CROSSTAB_TYPES = 8
GRID_TYPES = 5
MIN_METHOD_COUNT = 10
MAP_SAMPLE_SIZE = 5000
MAP_SAMPLE_SEED = 42
DEFAULT_RECORD_LIMIT = 1000
PROFILE_NUMERIC_COLUMNS = 10
PROFILE_CATEGORICAL_COLUMNS = 5
PROFILE_TOP_VALUES = 5
PREVIEW_ROWS = 5

# Names of the columns the pipeline adds.
PRIORITY_COL = "PRIORITY"
METHOD_COL = "METHOD_RECEIVED"
VALID_COORDS_COL = "has_valid_coords"
HOURS_COL = "resolution_hours"
RESOLVED_COL = "is_resolved"
AGE_COL = "hours_since_creation"
TARGET_COL = "target_hours"
RATIO_COL = "performance_ratio"
CATEGORY_COL = "performance_category"
DEFAULT_TYPE_COL = "SR_TYPE"
UNKNOWN_TYPE = "UNKNOWN"

ADDED_COLUMNS: tuple[str, ...] = (
    PRIORITY_COL,
    METHOD_COL,
    VALID_COORDS_COL,
    HOURS_COL,
    RESOLVED_COL,
    AGE_COL,
    TARGET_COL,
    RATIO_COL,
    CATEGORY_COL,
)
