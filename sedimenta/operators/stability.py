"""Stability of distributions between two samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.quantiles import bin_of, edges_of, exact_quantiles, linspace

FLOOR = 1e-6


def psi_verdict(psi: Column, stable: float = 0.10, warning: float = 0.25) -> Column:
    # The three verdicts' texts.
    return F.when(psi < stable, "stabil").when(psi < warning, "perlu perhatian").otherwise("bermasalah")


def psi_detail(expected: DataFrame, actual: DataFrame, value: str, n_bins: int = 10) -> DataFrame:
    """Shares of both samples and contribution of each quantile bin of ``expected``; bins without rows included."""
    edges = edges_of(expected, value, n_bins)
    inner = edges[1:-1]
    both = expected.select(F.col(value).alias("v"), F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(F.col(value).alias("v"), F.lit(0).alias("e"), F.lit(1).alias("a")))
    counts = both.where(F.col("v").isNotNull()).groupBy(bin_of(F.col("v"), inner).alias("bin")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    spine = expected.sparkSession.createDataFrame([(i, x) for i, x in enumerate([edges[0], *inner] if edges else [])], "bin int, bin_min double")
    dense = spine.join(counts, "bin", "left").select("bin", "bin_min", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    n_e, n_a = counts.agg(F.sum("e"), F.sum("a")).first()
    e, a = F.greatest(F.col("e") / float(n_e or 1), F.lit(FLOOR)), F.greatest(F.col("a") / float(n_a or 1), F.lit(FLOOR))
    return dense.select("bin", "bin_min", e.alias("expected_pct"), a.alias("actual_pct"), ((a - e) * F.log(a / e)).alias("psi_contribution"))


def population_stability_index(expected: DataFrame, actual: DataFrame, value: str, n_bins: int = 10) -> DataFrame:
    """One row, ``psi``; 0 if the expected sample has fewer than three distinct edges."""
    detail = psi_detail(expected, actual, value, n_bins)
    few = F.when(F.count("*") < 2, F.lit(0.0))
    return detail.agg(F.coalesce(few, F.sum("psi_contribution")).alias("psi"))


def characteristic_stability(df: DataFrame, sample: str, expected: str, actual: str, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Index, verdict, means and change of each feature between two samples of one table.

    All features at once: unpivoted, with each feature's own edges; features
    with fewer than ``n_bins`` finite values in either sample have no row.
    """
    parts = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    long = df.where(F.col(sample).isin(expected, actual)).select(sample, F.stack(F.lit(len(features)), *parts).alias("feature", "v"))
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    cut = exact_quantiles(long.where(F.col(sample) == expected), "feature", "v", linspace(0.0, 1.0, n_bins + 1))
    inner = {f: sorted(set(q))[1:-1] for f, q in cut.items()}
    side = df.sparkSession.createDataFrame([(f, x) for f, x in inner.items()], "feature string, inner array<double>")
    binned = long.join(F.broadcast(side), "feature").withColumn("bin", F.size(F.filter("inner", lambda x: x <= F.col("v"))))
    is_e = F.col(sample) == expected
    counts = binned.groupBy("feature", "bin").agg(*[F.sum(F.when(c, x).otherwise(0)).alias(n) for n, c, x in (("e", is_e, F.lit(1)), ("a", ~is_e, F.lit(1)), ("se", is_e, F.col("v")), ("sa", ~is_e, F.col("v")))])
    spine = df.sparkSession.createDataFrame([(f, b) for f, x in inner.items() for b in range(len(x) + 1)], "feature string, bin int")
    dense = spine.join(counts, ["feature", "bin"], "left").fillna(0, ["e", "a", "se", "sa"])
    totals = dense.groupBy("feature").agg(*[F.sum(c).alias(f"t{c}") for c in ("e", "a", "se", "sa")], F.count("*").alias("bins"))
    joined = dense.join(totals.where((F.col("te") >= n_bins) & (F.col("ta") >= n_bins)), "feature")
    e, a = F.greatest(F.col("e") / F.col("te"), F.lit(FLOOR)), F.greatest(F.col("a") / F.col("ta"), F.lit(FLOOR))
    made = joined.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.first("bins").alias("bins"), *[F.first(c).alias(c) for c in ("te", "ta", "tse", "tsa")])
    csi = F.when(F.col("bins") < 2, F.lit(0.0)).otherwise(F.col("psi"))
    mean_e, mean_a = F.col("tse") / F.col("te"), F.col("tsa") / F.col("ta")
    return made.select("feature", csi.alias("csi"), psi_verdict(csi).alias("verdict"), mean_e.alias("mean_expected"), mean_a.alias("mean_actual"), ((mean_a - mean_e) / (F.abs(mean_e) + FLOOR)).alias("pct_change")).orderBy(F.col("csi").desc(), "feature")  # one row per feature
