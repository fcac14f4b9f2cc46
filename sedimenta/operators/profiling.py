"""Exploratory summaries of columns and periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows and mean label per value of ``key``."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text; a double that holds a whole number is written without the point, NaN is missing."""
    text, kind = F.col(column).cast("string"), dict(df.dtypes)[column]
    if kind in ("double", "float"):
        whole = (F.col(column) == F.floor(F.col(column))) & (F.abs(F.col(column)) < 9e18)
        return F.when(whole, F.col(column).cast("long").cast("string")).when(~F.isnan(column), text)
    return text


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``column_name`` and ``value`` as text, one row for each row and column; absent columns are skipped."""
    there = [c for c in columns if c in df.columns]
    parts = [x for c in there for x in (F.lit(c), as_text(df, c))]
    return df.select(*keep, F.stack(F.lit(len(there)), *parts).alias("column_name", "value"))


def cardinality_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, missing share, largest, single and median group of each column.

    One pass: column-value counts, then counts of counts. The share of the
    largest group is of all rows, that of single values is of distinct values.
    """
    counts = unpivot(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    known = F.when(there, F.col("n"))
    each = counts.groupBy("column_name").agg(
        F.count(known).alias("n_unique"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("n_missing"),
        F.coalesce(F.max(known), F.lit(0)).alias("largest_group"),
        F.count(F.when(there & (F.col("n") == 1), 1)).alias("n_singleton"),
        F.coalesce(F.percentile(known, 0.5), F.lit(0.0)).alias("median_group_size"),
    )
    return each.select(
        "column_name",
        "n_unique",
        (F.col("n_missing") / F.col("n_rows")).alias("pct_missing"),
        "largest_group",
        (F.col("largest_group") / F.col("n_rows")).alias("pct_in_largest"),
        "n_singleton",
        F.coalesce(F.try_divide(F.col("n_singleton"), F.col("n_unique")), F.lit(0.0)).alias("pct_singleton"),
        "median_group_size",
    ).orderBy(F.col("n_unique").desc(), "column_name")  # one row per column


def coverage_across_periods(df: DataFrame, columns: Sequence[str], period: str, train: str, targets: Sequence[str]) -> DataFrame:
    """Per column and target period: present rows, distinct values, and the share of both that the training period has.

    Works on column-period-value counts, so a frequent value is one row. A
    column that is all missing in a period has no row for it.
    """
    counts = unpivot(df, columns, [period]).where(F.col("value").isNotNull()).groupBy("column_name", period, "value").agg(F.count("*").alias("n"))
    seen = counts.where(F.col(period) == train).select("column_name", "value", F.lit(1).alias("seen"))
    joined = counts.where(F.col(period).isin(list(targets))).join(seen, ["column_name", "value"], "left")
    return joined.groupBy("column_name", period).agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_unique"),
        (F.sum(F.when(F.col("seen") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("pct_rows_covered"),
        (F.count("seen") / F.count("*")).alias("pct_values_covered"),
    )


def missing_pattern_groups(df: DataFrame, columns: Sequence[str], key: str, least: int = 2) -> DataFrame:
    """Groups of columns that are missing in exactly the same rows: ``columns``, sorted and joined by commas, and their number.

    A column's pattern is the count and the exclusive or of two hashes of the
    keys of its missing rows, from one pass without a shuffle of rows. ``key``
    must be unique; patterns that differ are told apart but for a chance of
    about 2**-128.
    """
    aggs = []
    for c in columns:
        gone = F.col(c).isNull()
        aggs += [F.count(F.when(gone, 1)).alias(f"n_{c}"), F.bit_xor(F.when(gone, F.xxhash64(key)).otherwise(0)).alias(f"x_{c}"), F.bit_xor(F.when(gone, F.xxhash64(key, F.lit(1))).otherwise(0)).alias(f"y_{c}")]
    parts = [x for c in columns for x in (F.lit(c), F.col(f"n_{c}"), F.col(f"x_{c}"), F.col(f"y_{c}"))]
    long = df.agg(*aggs).select(F.stack(F.lit(len(columns)), *parts).alias("column_name", "n_missing", "x", "y"))
    groups = long.groupBy("n_missing", "x", "y").agg(F.sort_array(F.collect_list("column_name")).alias("c"))
    return groups.where(F.size("c") >= least).select(F.array_join("c", ",").alias("columns"), F.size("c").cast("long").alias("n_columns"), "n_missing").orderBy(F.col("n_columns").desc(), "columns")  # one row per group
