"""Quality class of single values, chosen by the column's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .timeseries import BAD, GOOD, UNUSUAL

# Unusual numbers and strings (a logger's overflow mark, and nothing).
UNUSUAL_NUMBERS = (7999, -7999)
UNUSUAL_STRINGS = ("", "7999", "-7999")


def basic_quality(column: Column, kind: T.DataType, numbers=UNUSUAL_NUMBERS, strings=UNUSUAL_STRINGS, strict_compat: bool = False) -> Column:
    """GOOD, UNUSUAL or BAD. Null is BAD; so is every type that is no text, number, truth value or time.

    Decimals count as numbers; with strict_compat they are BAD.
    """
    if isinstance(kind, T.StringType):
        blank = column.rlike(r"\A\s+\z")
        rest = F.when(F.lower(column) == "nan", BAD).when(blank | column.isin(*strings), UNUSUAL).otherwise(GOOD)
    elif isinstance(kind, T.BooleanType):
        rest = F.lit(GOOD)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        infinite = F.isnan(column) | (F.abs(column) == float("inf"))
        rest = F.when(infinite, BAD).when(column.isin(*numbers), UNUSUAL).otherwise(GOOD)
    elif isinstance(kind, T.NumericType) and not (strict_compat and isinstance(kind, T.DecimalType)):
        rest = F.when(column.isin(*numbers), UNUSUAL).otherwise(GOOD)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        rest = F.lit(GOOD)
    else:
        return F.lit(BAD)
    return F.when(column.isNull(), BAD).otherwise(rest)


def with_quality(df: DataFrame, *columns: str) -> DataFrame:
    """Adds <column>_quality for each column."""
    return df.withColumns({f"{c}_quality": basic_quality(F.col(c), df.schema[c].dataType) for c in columns})
