"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a declared list that is sent to every executor at most; a longer one is joined as the optimizer sees fit.
DECLARED_ROWS = 10_000


def small(df: DataFrame, rows: int = DECLARED_ROWS) -> DataFrame:
    """df to be broadcast if it has no more than so many rows; counting stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
