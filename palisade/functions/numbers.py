"""Numeric clean-up used at the edges of the library."""

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """Cast to double; NaN and infinities become NULL."""
    number = value.try_cast("double")
    infinite = (number == F.lit(float("inf"))) | (number == F.lit(float("-inf")))
    return F.when(F.isnan(number) | infinite, None).otherwise(number)


def clip(value: Column, low, high) -> Column:
    """Keep NULL; otherwise force the value between the two bounds."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def count_if(condition: Column) -> Column:
    """Number of rows where the condition holds (NULL counts as no)."""
    return F.count(F.when(condition, True))


def row_hash(*columns) -> Column:
    """Stable text id from key columns, so that a replay gives the same id."""
    values = [c if isinstance(c, Column) else F.col(c) for c in columns]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in values]), 256)
