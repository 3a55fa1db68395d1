"""Text predicates and measures of cells, as Columns.

White space is what ``Character.isWhitespace`` knows: it includes the ASCII separators and most Unicode spaces, but not
the no-break spaces. Lengths are UTF-16 units. Patterns match whole values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
ASTRAL = r"[^\x{10000}-\x{10FFFF}]"

INTEGER = r"[-+]?\d+"
PADDED = r"[-+]?0\d+"
DECIMAL = r"[-+]?\d+[.,]\d+"
DATE_SHAPE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"
BOOLEAN = r"(?iu:true|false|yes|no|sim|nao|não)"
EMAIL_SHAPE = r"[^\s@]+@[^\s@]+"
LENGTH_BUCKETS = ((4, "1-4"), (8, "5-8"), (12, "9-12"), (20, "13-20"), (40, "21-40"), (80, "41-80"))


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def cell(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def blank(value: Column) -> Column:
    return matches(cell(value), f"[{SPACE}]*")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def utf16_length(value: Column) -> Column:
    """Code points, and one more for each beyond the basic plane."""
    wide = value.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.length(value) + F.when(wide, F.length(F.regexp_replace(value, ASTRAL, ""))).otherwise(0)


def physical_type(value: Column) -> Column:
    """The type a stripped, non-blank value votes for; dates by shape only, integers with leading zeros are text."""
    return (
        F.when(matches(value, BOOLEAN), "BOOLEAN")
        .when(matches(value, INTEGER) & ~matches(value, PADDED), "INTEGER")
        .when(matches(value, DECIMAL), "DECIMAL")
        .when(matches(value, DATE_SHAPE), "DATE")
        .otherwise("TEXT")
    )


def pattern_class(value: Column) -> Column:
    """The first of seven classes that a stripped, non-blank value matches."""
    return (
        F.when(matches(value, EMAIL_SHAPE), "EMAIL_LIKE")
        .when(matches(value, DATE_SHAPE), "DATE_LIKE")
        .when(matches(value, INTEGER), "INTEGER_LIKE")
        .when(matches(value, DECIMAL), "DECIMAL_LIKE")
        .when(matches(value, r"[\p{L}\d_-]+"), "ALPHANUMERIC")
        .when(matches(value, r"[\p{L}\s.'-]+"), "TEXT_WORDS")
        .otherwise("OTHER")
    )


def length_bucket(length: Column) -> Column:
    out = F.when(length <= LENGTH_BUCKETS[0][0], LENGTH_BUCKETS[0][1])
    for top, name in LENGTH_BUCKETS[1:]:
        out = out.when(length <= top, name)
    return out.otherwise("81+")


def number(value: Column) -> Column:
    """A finite double from a stripped value, comma as point; null for any other."""
    parsed = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(parsed) & (F.abs(parsed) != float("inf")), parsed)


def redact(value: Column) -> Column:
    return F.concat(F.lit("<redacted:length="), utf16_length(cell(value)).cast("string"), F.lit(">"))


def unit(value: Column) -> Column:
    """Clamped to 0 and 1; not finite gives 0."""
    v = F.nanvl(value.cast("double"), F.lit(0.0))
    return F.when(F.abs(v) == float("inf"), 0.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
