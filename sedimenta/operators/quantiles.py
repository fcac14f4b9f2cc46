"""Exact quantiles and bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.ordering import running_totals


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` evenly spaced numbers, both ends included; rounded as multiples of the step are."""
    step = (high - low) / (n - 1)
    return [*(low + i * step for i in range(n - 1)), high]


def exact_quantiles(long: DataFrame, feature: str, value: str, fractions: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles with linear interpolation of each feature's finite values.

    Distinct values with counts are ordered over all ranges at once; only the
    values next to a quantile come to the driver, two per feature and fraction.
    Features without values are absent.
    """
    finite = long.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    counts = finite.groupBy(F.col(feature).alias("f"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    sizes = sorted((r[0], r[1]) for r in counts.groupBy("f").agg(F.sum("n")).collect())
    wanted, start = [], 0
    for f, n in sizes:
        places = sorted({k for q in fractions for k in (math.floor((n - 1) * q), math.ceil((n - 1) * q))})
        wanted.append((f, start, [start + k for k in places]))
        start += n
    if not wanted:
        return {}
    side = long.sparkSession.createDataFrame(wanted, "f string, first long, ks array<long>")
    ordered = running_totals(counts, [F.col("f").asc(), F.col("v").asc()], {"upto": F.col("n")})
    hit = F.filter("ks", lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))
    found = ordered.join(F.broadcast(side), "f").select("f", "v", "first", F.explode(hit).alias("k")).collect()
    at = {(r["f"], r["k"] - r["first"]): r["v"] for r in found}
    out = {}
    for f, n in sizes:
        out[f] = []
        for q in fractions:
            place = (n - 1) * q
            low, high = at[f, math.floor(place)], at[f, math.ceil(place)]
            out[f].append(low + (high - low) * (place - math.floor(place)))
    return out


def quantiles(df: DataFrame, value: str, fractions: Sequence[float]) -> list[float]:
    """Exact quantiles of one column; empty without values."""
    return exact_quantiles(df.select(F.lit("x").alias("f"), F.col(value).cast("double").alias("v")), "f", "v", fractions).get("x", [])


def bin_of(value: Column, inner: Sequence[float]) -> Column:
    """How many inner edges are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in inner]), lambda e: e <= value)) if inner else F.lit(0)


def edges_of(df: DataFrame, value: str, n_bins: int) -> list[float]:
    """Distinct quantile edges of ``n_bins`` bins."""
    return sorted(set(quantiles(df, value, linspace(0.0, 1.0, n_bins + 1))))
