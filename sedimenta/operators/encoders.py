"""Encoders that are fitted on training rows and applied to all. Fitted state is a small table, one row per value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.ordering import dense_codes
from sedimenta.operators.skew import lookup


def amount_features(amount: Column) -> dict[str, Column]:
    """``amt_log`` = ln(1 + x), NULL for -1 and below, and ``amt_decimal``, the part after the point."""
    return {"amt_log": F.log1p(amount), "amt_decimal": amount - F.floor(amount)}


def fit_frequency(train: DataFrame, column: str) -> DataFrame:
    """Training rows of each value."""
    return train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(f"freq_{column}"))


def apply_frequency(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """``freq_{column}``; 0 for an unseen or NULL value."""
    joined = lookup(df, fitted, [column])
    return joined.withColumn(f"freq_{column}", F.coalesce(F.col(f"freq_{column}"), F.lit(0)))


def fit_group_stats(train: DataFrame, column: str, value: str, stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Mean and sample deviation of ``value`` per entity in training rows."""
    made = {"mean": F.avg(value), "std": F.stddev_samp(value)}
    return train.where(F.col(column).isNotNull()).groupBy(column).agg(*[made[s].alias(f"{value}_{column}_{s}") for s in stats])


def apply_group_stats(df: DataFrame, fitted: DataFrame, column: str, value: str) -> DataFrame:
    """The statistics of each row's entity and ``value`` over the mean; NULL for an unseen entity."""
    joined = lookup(df, fitted, [column])
    mean = f"{value}_{column}_mean"
    return joined.withColumn(f"{value}_{column}_ratio", F.try_divide(F.col(value), F.col(mean))) if mean in fitted.columns else joined


def fit_label_codes(train: DataFrame, column: str) -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct training values."""
    return dense_codes(train, column, f"le_{column}")


def apply_label_codes(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """``le_{column}``; -1 for an unseen or NULL value."""
    joined = lookup(df, fitted, [column])
    return joined.withColumn(f"le_{column}", F.coalesce(F.col(f"le_{column}"), F.lit(-1)))
