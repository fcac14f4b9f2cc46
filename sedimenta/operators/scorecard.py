"""Probabilities as points, and tables by band of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.quantiles import bin_of, edges_of


def probability_to_score(p: Column, pdo: float = 20.0, anchor_score: float = 600.0, anchor_odds: float = 50.0, low: float = 300.0, high: float = 850.0) -> Column:
    """Points that grow by ``pdo`` when the odds of a good outcome double; ``anchor_score`` at odds of ``anchor_odds`` to 1."""
    factor = pdo / math.log(2.0)
    clipped = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    points = F.lit(anchor_score - factor * math.log(anchor_odds)) + F.lit(factor) * F.log((1 - clipped) / clipped)
    return F.least(F.greatest(points, F.lit(low)), F.lit(high))


def score_bands(df: DataFrame, score: str, label: str, n_bands: int = 10, ascending: bool = True) -> DataFrame:
    """Rows, label rate and running shares per quantile band of the score.

    Equal quantiles are one edge; if all scores are equal there is one band,
    number 0.
    """
    edges = edges_of(df, score, n_bands)
    known = df.where(F.col(score).isNotNull())
    bands = known.groupBy(bin_of(F.col(score), edges[1:-1]).alias("band")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n_fraud"), F.avg(label).alias("fraud_rate"), F.min(score).alias("score_min"), F.max(score).alias("score_max")
    )
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # as many rows as bands
    upto = Window.orderBy(F.col("band").asc() if ascending else F.col("band").desc()).rowsBetween(Window.unboundedPreceding, 0)
    shares = bands.withColumn("pct_population", F.col("n") / F.sum("n").over(all_rows))
    return shares.withColumns({"cum_pct_population": F.sum("n").over(upto) / F.sum("n").over(all_rows), "cum_pct_fraud": F.try_divide(F.sum("n_fraud").over(upto), F.sum("n_fraud").over(all_rows))})
