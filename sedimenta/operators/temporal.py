"""Time features and the split by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import domain as D

SPLITS = ("train", "gap", "val", "test")


def add_time_features(df: DataFrame, seconds: str) -> DataFrame:
    """``day``, ``week``, ``hour`` and ``dayofweek``; the hour isn't shifted by the origin, the weekday is relative."""
    day = D.day_of(F.col(seconds))
    return df.withColumns({"day": day, "week": D.week_of(day), "hour": D.hour_of(F.col(seconds)), "dayofweek": D.weekday_of(day)})


def split_of(day: Column, train_end: int, gap: int, val_end: int) -> Column:
    return F.when(day <= train_end, "train").when(day <= train_end + gap, "gap").when(day <= val_end, "val").when(day.isNotNull(), "test")


def temporal_split(df: DataFrame, day: str, train_end: int = 118, gap: int = 7, val_end: int = 150) -> DataFrame:
    """``df`` with ``split``; ValueError unless train_end < train_end + gap < val_end < the last day. A NULL day has no split."""
    last = df.agg(F.max(day)).first()[0]
    if last is None or not train_end < train_end + gap < val_end < last:
        raise ValueError(f"bounds {train_end}, {gap}, {val_end} don't fit the last day {last}")
    return df.withColumn("split", split_of(F.col(day), train_end, gap, val_end))


def split_masks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The key and one boolean for each split."""
    return df.select(key, *[(F.col(split) == s).alias(f"is_{s}") for s in SPLITS])


def split_from_masks(masks: DataFrame, key: str) -> DataFrame:
    """The key and ``split``, the first mask that is true."""
    return masks.select(key, F.coalesce(*[F.when(F.col(f"is_{s}"), s) for s in SPLITS]).alias("split"))


def split_summary(df: DataFrame, day: str, label: str, split: str = "split") -> DataFrame:
    """Rows, share, first and last day and label rate of each split."""
    n = df.count()
    each = df.groupBy(split).agg(F.count("*").alias("n"), F.min(day).alias("day_min"), F.max(day).alias("day_max"), F.avg(label).alias("rate"))
    return each.withColumn("pct", F.col("n") / max(1, n))
