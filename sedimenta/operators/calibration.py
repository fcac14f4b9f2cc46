"""Calibration of probabilities."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.quantiles import bin_of, linspace


def reliability_curve(df: DataFrame, label: str, p: str, n_bins: int = 20) -> DataFrame:
    """Rows, mean probability and label rate of each equal-width bin that has rows."""
    inner = linspace(0.0, 1.0, n_bins + 1)[1:-1]
    known = df.where(F.col(p).isNotNull())
    return known.groupBy(bin_of(F.col(p), inner).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(label).alias("actual_rate"))


def calibration_summary(df: DataFrame, label: str, p: str, n_bins: int = 20) -> DataFrame:
    """One row: expected calibration error, Brier score, mean probability, label rate and their difference."""
    inner = linspace(0.0, 1.0, n_bins + 1)[1:-1]
    known = df.where(F.col(p).isNotNull())
    off = F.col(p) - F.col(label)
    bins = known.groupBy(bin_of(F.col(p), inner).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(label).alias("y"), F.sum(off * off).alias("b"))
    n = F.sum("n")
    return bins.agg((F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"), (F.sum("b") / n).alias("brier"), (F.sum("p") / n).alias("mean_predicted"), (F.sum("y") / n).alias("actual_rate"), ((F.sum("p") - F.sum("y")) / n).alias("bias"))


def fit_isotonic(df: DataFrame, label: str, p: str) -> IsotonicRegressionModel:
    """Monotone calibrator; equal probabilities are pooled before the fit."""
    pooled = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.avg(label).alias("y"), F.count("*").cast("double").alias("w"))
    data = VectorAssembler(inputCols=[p], outputCol="x").transform(pooled)
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(data)


def apply_isotonic(model: IsotonicRegressionModel, df: DataFrame, p: str, out: str) -> DataFrame:
    """``out``: interpolated between the fitted points, constant beyond them."""
    made = model.setFeaturesCol("__x").setPredictionCol(out).transform(VectorAssembler(inputCols=[p], outputCol="__x").transform(df))
    return made.drop("__x")
