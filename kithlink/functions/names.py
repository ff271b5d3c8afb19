"""Name parsing and generational suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing name, and the suffixes that mark a generation.
MISSING_NAMES = ("", "NA", "NULL", "NAN")
SUFFIXES = ("JR", "SR", "II", "III", "IV", "V")
SUFFIX_PATTERN = " (" + "|".join(SUFFIXES) + ")$"
LETTERS_PATTERN = "([A-Za-z ]+)"


def word_and_rest(text: Column) -> tuple[Column, Column]:
    """Text before the first blank, and all text after it ('' when there is no blank)."""
    parts = F.split(text, " ", 2)
    return parts.getItem(0), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def parse_full_name(name: Column) -> dict[str, Column]:
    """'LAST FIRST MIDDLE ..' as three columns; absent parts are ''."""
    last, rest = word_and_rest(name)
    first, middle = word_and_rest(rest)
    return {"first_name": first, "last_name": last, "middle_name": middle}


def letters_only(text: Column) -> Column:
    """First run of letters and blanks, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, LETTERS_PATTERN, 1), F.lit(""))


def lineage(text: Column) -> Column:
    """Suffix that follows a blank at the end of the text, else NULL."""
    return F.nullif(F.regexp_extract(text, SUFFIX_PATTERN, 1), F.lit(""))


def without_lineage(text: Column) -> Column:
    """Text with the generational suffix taken off and blanks trimmed."""
    return F.trim(F.regexp_replace(text, SUFFIX_PATTERN, ""))


def is_present_name(name: Column) -> Column:
    return name.isNotNull() & ~name.isin(*MISSING_NAMES)
