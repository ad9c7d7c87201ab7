"""One notion of "missing": NULL, and NaN in floating columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        # One reference to the column: an expression behind it is then computed once.
        return F.nanvl(c.cast("double"), F.lit(None).cast("double")).isNull()
    return c.isNull()


def missing_share(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Percentage of the row's columns that are missing."""
    columns = columns or df.columns
    flags = [is_missing(df, c).cast("int") for c in columns]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total / F.lit(float(len(columns))) * F.lit(100.0)
