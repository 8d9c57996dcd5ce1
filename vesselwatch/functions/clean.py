"""Parsing and validation of raw text fields, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the input format.
NULL_MARKERS = ["", "unknown", "undefined", "n/a", "na", "none", "null"]
MOBILE_TYPES = ["Class A"]
PLACEHOLDER_MMSI = [0, 111111111, 123456789, 999999999]
ZERO_DEGREES = 1e-6


#: White space as it is stripped from either end of a field.
WHITE = " \t\n\r\x0b\x0c"
#: A decimal number without a type suffix, white space around it; possessive, so that a field is read once.
_NUMBER = r"^\s*+[+-]?(?:(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?\d++)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*+$"
_TIME = r"^\s*+(\d{1,2})/(\d{1,2})/(?!0000)(\d{4})\s+(\d{1,2}:\d{1,2}(?::\d{1,2})?)\s*+$"


def trimmed(c: Column) -> Column:
    """Without white space at either end; null if nothing is left."""
    return F.nullif(F.btrim(c, F.lit(WHITE)), F.lit(""))


def present(c: Column) -> Column:
    """Trimmed text; empty for the markers of a missing value."""
    text = F.btrim(c, F.lit(WHITE))
    return F.when(F.lower(text).isin(NULL_MARKERS), "").otherwise(text)


def parse_time(c: Column) -> Column:
    """Day-first date with hours and minutes, seconds optional; null if it can't be read.

    One pass turns it into the year-first form that a cast reads without exceptions; what has no slash was
    in another form, what still has one doesn't cast.
    """
    return F.when(c.contains("/"), F.regexp_replace(c, _TIME, "$3-$2-$1 $4").try_cast("timestamp"))


def parse_float(c: Column) -> Column:
    """A double (nan and inf too); null if it can't be read. Type suffixes are not part of a number."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def parse_int(c: Column) -> Column:
    """A long from the text of a whole number, also written like 123.0 or 1e5."""
    number = parse_float(c)
    return F.coalesce(c.try_cast("long"), F.when(F.abs(number) < 9e18, F.when(number.try_cast("long") == number, number.try_cast("long"))))


def valid_mobile_type(c: Column) -> Column:
    return F.coalesce(c.isin(MOBILE_TYPES) | F.btrim(c, F.lit(WHITE)).isin(MOBILE_TYPES), F.lit(False))


def valid_mmsi(c: Column) -> Column:
    """Nine digits, no placeholder, not one digit only (a multiple of 111111111)."""
    return F.coalesce(c.between(100_000_000, 999_999_999) & (c % 111_111_111 != 0) & ~c.isin(PLACEHOLDER_MMSI), F.lit(False))


def valid_latitude(c: Column) -> Column:
    return F.coalesce(c.between(-90.0, 90.0), F.lit(False))


def valid_longitude(c: Column) -> Column:
    return F.coalesce(c.between(-180.0, 180.0), F.lit(False))


def at_origin(lat: Column, lon: Column) -> Column:
    """Both coordinates are zero as far as a receiver can tell."""
    return (F.abs(lat) < ZERO_DEGREES) & (F.abs(lon) < ZERO_DEGREES)
