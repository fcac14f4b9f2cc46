"""The feature matrix: blocks of columns by configuration, encoders fitted on training rows, put together by key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.encoders import amount_features
from sedimenta.operators.ordering import running_totals
from sedimenta.operators.profiling import as_text
from sedimenta.operators.relational import EXACT_BLOCKS, raw_block
from sedimenta.operators.skew import lookup_columns


@dataclass(frozen=True)
class MatrixConfig:
    """Which columns each block has; ``None`` for V and id takes all columns with the prefix. Columns that a table lacks are skipped."""

    # The columns of the blocks.
    label_encode: tuple[str, ...] = (
        "ProductCD", "card4", "card6", "DeviceType", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "id_12", "id_15", "id_16", "id_23", "id_27",
        "id_28", "id_29", "id_30", "id_31", "id_33", "id_34", "id_35", "id_36", "id_37", "id_38",
    )
    frequency_encode: tuple[str, ...] = ("card1", "card2", "card3", "card5", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo", "id_30", "id_31")
    value: str = "TransactionAmt"
    groups: tuple[str, ...] = ("card1", "card4", "addr1")
    stats: tuple[str, ...] = ("mean", "std")
    raw: tuple[tuple[str, tuple[str, ...] | None], ...] = (("base", EXACT_BLOCKS["base"]), ("D", EXACT_BLOCKS["D"]), ("C", EXACT_BLOCKS["C"]), ("V", None), ("id_", None))
    time: tuple[str, ...] = ("hour", "dayofweek")
    amount: tuple[str, ...] = ("amt_log", "amt_decimal")

    def raw_columns(self, stored: Sequence[str]) -> list[str]:
        return [c for prefix, wanted in self.raw for c in raw_block(stored, wanted, prefix, self.label_encode)]

    def needed(self, stored: Sequence[str]) -> list[str]:
        """Stored columns that the matrix is made of."""
        wanted = {*self.label_encode, *self.frequency_encode, *self.groups, self.value, *self.raw_columns(stored)}
        return [c for c in stored if c in wanted]


def fit_dictionary(train: DataFrame, config: MatrixConfig) -> DataFrame:
    """Of each column's values in training rows: how many rows, place among the sorted values, mean and deviation of the amount.

    One aggregation for all columns: the table is unpivoted and counted before
    the shuffle; places come from one global order of the counts.
    """
    columns = [c for c in dict.fromkeys([*config.label_encode, *config.frequency_encode, *config.groups]) if c in train.columns]
    parts = [x for c in columns for x in (F.lit(c), as_text(train, c))]
    long = train.select(F.col(config.value).alias("__v"), F.stack(F.lit(len(columns)), *parts).alias("column_name", "value")).where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"))
    placed = running_totals(counts, [F.col("column_name").asc(), F.col("value").asc()], {"__upto": F.lit(1)})
    starts = placed.groupBy("column_name").agg(F.min("__upto").alias("__first"))
    return placed.join(F.broadcast(starts), "column_name").select("column_name", "value", "n", (F.col("__upto") - F.col("__first")).cast("long").alias("code"), "mean", "std")


def feature_matrix(df: DataFrame, key: str, meta: Sequence[str], train: Column, config: MatrixConfig = MatrixConfig()) -> DataFrame:
    """``key``, ``meta`` and the features of ``df``, which has the columns ``hour`` and ``dayofweek`` beside the stored ones.

    Label codes are -1 and frequencies 0 for a value that training lacks or
    that is missing; the amount's statistics are NULL there. ``key`` is unique.
    """
    there = set(df.columns)
    labels, frequencies, groups = ([c for c in cs if c in there] for cs in (config.label_encode, config.frequency_encode, config.groups))
    columns = dict.fromkeys([*labels, *frequencies, *groups])
    found = lookup_columns(df, key, {c: c for c in columns}, fit_dictionary(df.where(train), config), ["n", "code", "mean", "std"])
    value = F.col(config.value)
    derived = [F.col(c) for c in config.time] + [c.alias(n) for n, c in amount_features(value).items() if n in config.amount]
    encoded = [F.coalesce(f"code~{c}", F.lit(-1)).alias(f"le_{c}") for c in labels] + [F.coalesce(f"n~{c}", F.lit(0)).alias(f"freq_{c}") for c in frequencies]
    for c in groups:
        encoded += [F.col(f"{s}~{c}").alias(f"{config.value}_{c}_{s}") for s in config.stats]
        if "mean" in config.stats:
            encoded.append(F.try_divide(value, F.col(f"mean~{c}")).alias(f"{config.value}_{c}_ratio"))
    return df.join(found, key).select(key, *meta, *derived, *encoded, *config.raw_columns([c for c in df.columns if c not in config.time]))
