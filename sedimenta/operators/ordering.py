"""Global order without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut_lineage


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the totals of ``sums`` over all rows up to each one in ``order``.

    Rows are cut into ranges of the order, each range adds up its own rows, and
    what comes before a range is one number per range. The ranges are written
    to the checkpoint folder, so a range's number means the same rows when a
    lost executor's work is done again. ``order`` should be unique; rows that
    tie in it get their totals in no defined order among themselves. An empty
    table stays empty.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    each = ranged.groupBy("__p").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    before = each.select("__p", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    added = own.join(F.broadcast(before), "__p")
    return added.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def dense_codes(values: DataFrame, value: str, code: str = "code", start: int = 0) -> DataFrame:
    """Distinct non-NULL values with consecutive codes in sorted order from ``start``."""
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct()
    numbered = running_totals(distinct, [F.col(value).asc()], {code: F.lit(1)})
    return numbered.select(value, (F.col(code) - 1 + start).cast("long").alias(code))
