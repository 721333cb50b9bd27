"""Scalar trip operators as Catalyst expressions.

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions``, so they compile into whole-stage codegen, fold into
scan filters and never leave the JVM.  ``ridelens.functions.sql`` exposes the
same logic to ``spark.sql`` as SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the original analysis for identical results).
# ---------------------------------------------------------------------------
# Gender codes: 1 -> "Male", 2 -> "Female", anything else (null included) -> "Unknown".
GENDER_MALE = "Male"
GENDER_FEMALE = "Female"
GENDER_UNKNOWN = "Unknown"
# Time-of-day bands by hour: Late Night = 22..23 and 0..4, Morning = 5..11,
# Afternoon = 12..17, Evening = 18..21.
BAND_LATE_NIGHT = "Late Night"
BAND_MORNING = "Morning"
BAND_AFTERNOON = "Afternoon"
BAND_EVENING = "Evening"
TIME_BANDS = [BAND_MORNING, BAND_AFTERNOON, BAND_EVENING, BAND_LATE_NIGHT]
# Age bands: (upper bound inclusive, label); ages above 72 fall in "73 to 80".
AGE_BANDS = [
    (24, "16 to 24"),
    (32, "25 to 32"),
    (40, "33 to 40"),
    (48, "41 to 48"),
    (56, "49 to 56"),
    (64, "57 to 64"),
    (72, "65 to 72"),
]
AGE_BAND_LAST = "73 to 80"
# Day numbers as returned by dayofweek(): 1 = Sunday ... 7 = Saturday.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEKEND = "Weekend"
WEEKDAY = "Weekday"
# User types.
SUBSCRIBER = "Subscriber"
CUSTOMER = "Customer"
# Mean Earth radius used by the great-circle distance.
EARTH_RADIUS_KM = 6371
# Cohort rules (seconds / years).
CUSTOMER_MIN_SECONDS = 120
CUSTOMER_MAX_SECONDS = 60 * 30
SUBSCRIBER_MAX_SECONDS = 60 * 45
MAX_AGE = 65
DEFAULT_AS_OF_YEAR = 2018
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_gender(code) -> Column:
    """Gender code -> label; null-safe (null -> 'Unknown')."""
    code = _c(code)
    return (
        F.when(code == 1, F.lit(GENDER_MALE))
        .when(code == 2, F.lit(GENDER_FEMALE))
        .otherwise(F.lit(GENDER_UNKNOWN))
    )


def time_band(hour) -> Column:
    """Hour of day (0-23) -> band label; null hour -> null."""
    h = _c(hour)
    return (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when((h >= 22) | (h < 5), F.lit(BAND_LATE_NIGHT))
        .when(h < 12, F.lit(BAND_MORNING))
        .when(h < 18, F.lit(BAND_AFTERNOON))
        .otherwise(F.lit(BAND_EVENING))
    )


def age_band(age) -> Column:
    """Age -> 8-year band label; null age -> null."""
    a = _c(age)
    expr = F.when(a.isNull(), F.lit(None).cast("string"))
    for upper, label in AGE_BANDS:
        expr = expr.when(a <= upper, F.lit(label))
    return expr.otherwise(F.lit(AGE_BAND_LAST))


def day_name(day_number) -> Column:
    """dayofweek() number -> day name (1 Sunday ... 7 Saturday); null -> null."""
    d = _c(day_number)
    expr = F.when(d.isNull(), F.lit(None).cast("string"))
    for i, name in enumerate(DAY_NAMES[:-1], start=1):
        expr = expr.when(d == i, F.lit(name))
    return expr.otherwise(F.lit(DAY_NAMES[-1]))


def day_type(name) -> Column:
    """Day name -> 'Weekend' for Saturday/Sunday, else 'Weekday'; null -> null."""
    n = _c(name)
    return F.when(n.isin(DAY_NAMES[0], DAY_NAMES[6]), F.lit(WEEKEND)).when(n.isNotNull(), F.lit(WEEKDAY))


def day_type_of(ts) -> Column:
    """Weekday/Weekend directly from a timestamp (same result as day_type(day_name(dayofweek)))."""
    t = _c(ts)
    return F.when(F.dayofweek(t).isin(1, 7), F.lit(WEEKEND)).when(t.isNotNull(), F.lit(WEEKDAY))


def rider_age(birth_year, as_of_year: int = DEFAULT_AS_OF_YEAR) -> Column:
    """Age in years at ``as_of_year`` (a parameter, not the wall clock)."""
    return (F.lit(int(as_of_year)) - _c(birth_year)).cast("int")


def haversine_km(lat1, lon1, lat2, lon2, legacy: bool = False) -> Column:
    """Great-circle distance in km (radius 6371).

    Coordinate deltas are taken in the input type (float32 for trip files) and then
    widened, as the original computation does.  ``legacy=True`` reproduces the
    original scripts' variant that passes latitudes in *degrees* to ``cos``; the
    default is the standard formula.
    """
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    if legacy:
        cos_part = F.cos(lat1.cast("double")) * F.cos(lat2.cast("double"))
    else:
        cos_part = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    a = F.pow(F.sin(dlat / 2), 2) + cos_part * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def hours(seconds) -> Column:
    """Seconds -> hours as double (integer divisor keeps it a double division)."""
    return _c(seconds) / F.lit(60 * 60)


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 (ANSI mode would raise)."""
    return F.try_divide(_c(num), _c(den))


def strip_quotes(s) -> Column:
    """Remove one pair of surrounding double quotes left in raw text fields."""
    return F.regexp_replace(_c(s), r'^"(.*)"$', "$1")


def parse_raw_time(s) -> Column:
    """Quoted/unquoted 'yyyy-MM-dd HH:mm:ss[.ffff]' text -> TIMESTAMP_NTZ.

    A plain cast to TIMESTAMP_NTZ is zone-independent and accepts up to six
    fractional digits; ``try_cast`` turns malformed text into null instead of
    failing the job (ANSI mode).
    """
    return strip_quotes(s).try_cast("timestamp_ntz")
