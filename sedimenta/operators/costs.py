"""Costs of a threshold: one pass over the rows for all thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.quantiles import bin_of, linspace, quantiles


def threshold_table(df: DataFrame, label: str, score: str, amount: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: rows and positives at or above it, and the amount of positives below.

    Rows are added up between neighbouring thresholds; the totals above and
    below are sums over at most as many rows as there are thresholds.
    """
    positive = F.col(label) == 1
    each = df.where(F.col(score).isNotNull()).groupBy(bin_of(F.col(score), thresholds).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, F.col(amount)).otherwise(0)).alias("amt")
    )
    spine = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate([float("-inf"), *thresholds])], "bin int, threshold double")
    dense = spine.join(each, "bin", "left").select("bin", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "pos", "amt")])
    above = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = dense.select(
        "bin", "threshold",
        F.sum("n").over(above).alias("n_flagged"), F.sum("pos").over(above).alias("caught"), F.coalesce(F.sum("amt").over(below), F.lit(0)).alias("missed_amount"),
        F.sum("n").over(every).alias("n_all"), F.sum("pos").over(every).alias("pos_all"), F.sum("amt").over(every).alias("amt_all"),
    )
    return out.where("bin > 0").drop("bin")


def cost_curve(df: DataFrame, label: str, score: str, amount: str, costs: Sequence[float], n_thresholds: int = 200) -> DataFrame:
    """Costs at quantile thresholds for each cost of a false positive."""
    thresholds = sorted(set(quantiles(df, score, linspace(0.0, 1.0, n_thresholds))))
    table = threshold_table(df, label, score, amount, thresholds)
    fp = (F.col("n_flagged") - F.col("caught")) * F.col("cost_fp")
    return table.withColumn("cost_fp", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).select(
        "cost_fp", "threshold", (F.col("n_flagged") / F.col("n_all")).alias("review_rate"), "n_flagged", F.col("caught").alias("fraud_caught"), F.try_divide("caught", "pos_all").alias("recall"),
        F.col("missed_amount").alias("fn_cost"), fp.alias("fp_cost"), (F.col("missed_amount") + fp).alias("total_cost"), (F.col("amt_all") - F.col("missed_amount")).alias("fraud_value_saved"), F.col("amt_all").alias("no_model"),
    )


def sensitivity(curve: DataFrame, days_in_period: int = 31) -> DataFrame:
    """The cheapest threshold of each scenario, the lowest if several are, and what it saves."""
    cheapest = F.row_number().over(Window.partitionBy("cost_fp").orderBy("total_cost", "threshold"))
    best = curve.withColumn("__i", cheapest).where("__i = 1")
    saved = F.col("no_model") - F.col("total_cost")
    return best.select(
        "cost_fp", F.col("threshold").alias("optimal_threshold"), "review_rate", "recall", "total_cost", "fn_cost", "fp_cost",
        saved.alias("savings_vs_no_model"), (saved * 30.0 / days_in_period).alias("savings_per_month"), F.try_divide(saved, F.col("no_model")).alias("pct_cost_reduction"),
    )


def simulate(sample: DataFrame, label: str, points: str, amount: str, weight: str, thresholds: Sequence[float], cost_fp: float) -> DataFrame:
    """For each threshold, what a review of all rows with points at or below it finds and costs.

    A row without label 1 stands for ``weight`` rows, a positive for itself.
    Rows are added up between neighbouring thresholds first.
    """
    cuts = sorted({float(t) for t in thresholds})
    positive = F.col(label) == 1
    over = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t < F.col(points)))
    zero = F.lit(0).cast("long")
    each = sample.where(F.col(points).isNotNull()).groupBy(over.alias("bin")).agg(
        F.sum(F.when(~positive, F.col(weight)).otherwise(0.0)).alias("good"), F.sum(F.when(positive, 1).otherwise(0)).alias("bad"), F.sum(F.when(positive, F.col(amount)).otherwise(zero)).alias("amt")
    )
    spine = sample.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*cuts, float("inf")])], "bin int, threshold double")
    dense = spine.join(each, "bin", "left").select("bin", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad", "amt")])
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per threshold
    after = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = dense.select(
        "bin", "threshold", F.sum("good").over(upto).alias("good"), F.sum("bad").over(upto).alias("bad"), F.coalesce(F.sum("amt").over(after), zero).alias("fn_cost"),
        (F.sum("good").over(every) + F.sum("bad").over(every)).alias("rows"), F.sum("bad").over(every).alias("all_bad"),
    )
    reviewed, fp = F.col("good") + F.col("bad"), F.col("good") * cost_fp
    return sums.where(F.col("bin") < len(cuts)).select(
        "threshold", F.try_divide(reviewed, F.col("rows")).alias("review_rate"), F.try_divide("bad", "all_bad").alias("recall"), F.try_divide(F.col("bad"), reviewed).alias("precision"),
        "fn_cost", fp.alias("fp_cost"), (F.col("fn_cost") + fp).alias("total_cost"),
    )
