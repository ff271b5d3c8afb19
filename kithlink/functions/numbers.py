"""Rounding, ratios and NaN handling that agree across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as Python and numpy do."""
    return F.bround(value, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL when there is nothing to divide by."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def share(flag: Column, among: Column | None = None) -> Column:
    """Mean of a boolean over the rows where `among` holds; NULL over no rows."""
    value = flag.cast("double")
    return F.avg(value if among is None else F.when(among, value))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in float columns read from outside; SQL knows only NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def f1(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)
