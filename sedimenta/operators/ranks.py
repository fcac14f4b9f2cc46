"""Average ranks and rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.ordering import running_totals


def average_ranks(counted: DataFrame, group: str, value: str, n: str, rank: str) -> DataFrame:
    """``group``, ``value`` and ``rank``, the mean place of the value's rows in its group, from 1.

    ``counted`` has ``n`` rows of a value; values may be repeated.
    """
    counts = counted.groupBy(group, value).agg(F.sum(n).alias("__n"))
    ordered = running_totals(counts, [F.col(group).asc(), F.col(value).asc()], {"__upto": F.col("__n")})
    first = ordered.groupBy(group).agg(F.min(F.col("__upto") - F.col("__n")).alias("__start"))
    place = F.col("__upto") - F.col("__start") - (F.col("__n") - 1) / 2
    return ordered.join(first, group).select(group, value, place.alias(rank))


def spearman(long: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` in each group, over the rows that have both; NULL if either is constant.

    Equal pairs are counted first, so a frequent pair is one row.
    """
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = long.where(known).groupBy(group, x, y).agg(F.count("*").alias("__w"))
    both = rows.join(average_ranks(rows, group, x, "__w", "__rx"), [group, x]).join(average_ranks(rows, group, y, "__w", "__ry"), [group, y])
    w, a, b = F.col("__w"), F.col("__rx"), F.col("__ry")
    s = both.groupBy(group).agg(F.sum(w).alias("n"), *[F.sum(t).alias(k) for k, t in {"a": w * a, "b": w * b, "aa": w * a * a, "bb": w * b * b, "ab": w * a * b}.items()])
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    return s.select(group, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)).alias("spearman"), "n")
