"""One row per key out of a table that stores several versions of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """``key`` and ``columns`` of the row with the greatest ``version`` of each key.

    One shuffle on the key. Rows that tie in ``version`` are ordered by the
    other columns, so the result is the same each time. A NULL version is older
    than any other. A row with a NULL key names no record and is left out. Columns not asked for are never
    read. An empty table gives an empty one.
    """
    rest = [c for c in columns if c not in (key, version)]
    order = [F.col(version).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in rest)]
    newer = F.lag(key).over(Window.partitionBy(key).orderBy(*order))
    # lag instead of row_number() = 1: the latter would also sort before the shuffle, where few rows go away
    kept = df.select(key, version, *rest).where(F.col(key).isNotNull()).withColumn("__newer", newer)
    return kept.where(F.col("__newer").isNull()).select(key, *columns if key not in columns else rest)
