"""Date parsing, ages and duration texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean year lengths of the two age rules, and the reference day of the second.
JULIAN_YEAR_DAYS = 365.25
GREGORIAN_YEAR_DAYS = 365.2425
AGE_REFERENCE_DAY = "2020-01-01"


def parse_mdy(text: Column) -> Column:
    """month/day/year text to date; anything that is no such date gives NULL."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")


def whole_years(days: Column, year_days: float) -> Column:
    return F.floor(days / F.lit(year_days)).cast("int")


def age_at(event: Column, birth: Column) -> Column:
    """Whole years of 365.25 days between birth and event."""
    return whole_years(F.datediff(event, birth), JULIAN_YEAR_DAYS)


def age_on_reference_day(birth: Column) -> Column:
    """Whole years of 365.2425 days between birth and 2020-01-01, cut towards zero."""
    days = F.datediff(F.to_date(F.lit(AGE_REFERENCE_DAY)), birth)
    return (days / F.lit(GREGORIAN_YEAR_DAYS)).cast("int")


def minutes_from_duration(text: Column) -> Column:
    """'h:m:s' (or 'm:s') text to minutes; a bare number is taken as seconds."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return seconds / 60
