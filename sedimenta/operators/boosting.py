"""Boosted trees on feature tables, stopped with patience, and exact attributions of their predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import cut_lineage, ship_package

#: What a missing value becomes: below every number that a feature can hold in earnest.
FILL = -1e300


@dataclass(frozen=True)
class BoostConfig:
    """``rounds`` at most; those after ``patience`` rounds without a lower validation loss don't count. ``columns``: share of features each node looks at; ``rows``: share of rows each tree sees."""

    rounds: int = 40
    patience: int = 10
    depth: int = 4
    step: float = 0.2
    columns: float = 0.7
    rows: float = 0.8
    bins: int = 64
    seed: int = 42


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``x``: the features as a vector; NULL, NaN and infinite values as a number below all others."""
    number = {f: F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features}
    filled = df.select("*", *[F.coalesce(F.when(F.abs(v) < -FILL, v), F.lit(FILL)).alias(f"__x_{f}") for f, v in number.items()])
    return VectorAssembler(inputCols=[f"__x_{f}" for f in features], outputCol="x").transform(filled).drop(*[f"__x_{f}" for f in features])


def best_round(losses: Sequence[float], patience: int) -> int:
    """Trees to keep: up to the lowest loss before ``patience`` rounds in a row fail to lower it."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_boosted(df: DataFrame, features: Sequence[str], label: str, validation: str, positive_weight: float = 1.0, config: BoostConfig = BoostConfig()) -> GBTClassificationModel:
    """Trees fitted on the rows where ``validation`` is false; kept are those up to the lowest loss on the others.

    Positives count ``positive_weight`` times in training. Without validation
    rows all trees are kept.
    """
    data = cut_lineage(assemble(df, features).select("x", F.col(label).cast("double").alias("y"), F.col(validation).alias("v"), F.when(F.col(label) == 1, positive_weight).otherwise(1.0).alias("w")))
    strategy = "all" if config.columns >= 1 else str(config.columns)
    trees = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="w", maxIter=config.rounds, maxDepth=config.depth, stepSize=config.step, maxBins=config.bins, featureSubsetStrategy=strategy, subsamplingRate=config.rows, seed=config.seed
    ).fit(data.where("not v"))
    held = data.where("v").select("x", F.col("y"), "w")
    if held.isEmpty():
        return trees
    return first_trees(trees, best_round(trees.evaluateEachIteration(held), config.patience))


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model with its first ``n`` trees only."""
    gateway, java = SparkContext._active_spark_context._gateway, model._java_obj
    kind = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    n = min(n, model.getNumTrees)
    kept, weights = gateway.new_array(kind, n), gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], model.treeWeights)):
        kept[i], weights[i] = tree, weight
    made = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, weights, model.numFeatures, 2)
    out = GBTClassificationModel(made)
    for name in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        out._set(**{name: model.getOrDefault(name)})
    out._transfer_params_to_java()
    return out


def save_model(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def predict(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
    made = model.transform(assemble(df, features))
    return made.withColumn(out, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Leaf:
    """A leaf's value, and for each feature on its path the interval that leads here and the share of training rows that it lets pass."""

    value: float
    features: tuple[int, ...]
    above: tuple[float, ...]
    upto: tuple[float, ...]
    share: tuple[float, ...]


def leaves(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of all trees, values times the tree's weight; bounded by trees and depth."""
    found: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:  # noqa: ANN001
        if node.subtreeDepth() == 0:
            order = tuple(path)
            found.append(Leaf(weight * node.prediction(), order, *(tuple(path[f][i] for f in order) for i in range(3))))
            return
        rows = node.impurityStats().count()
        feature, at = node.split().featureIndex(), node.split().threshold()
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            walk(child, weight, {**path, feature: (*bounds, share * child.impurityStats().count() / rows)})

    for tree, weight in zip(model._java_obj.trees(), model.treeWeights):
        walk(tree.rootNode(), weight, {})
    return found


def attributions(x: np.ndarray, found: Sequence[Leaf], n_features: int) -> np.ndarray:
    """Shapley values of the margin, rows x features, with the path's shares for features left out (Lundberg et al. 2018).

    A leaf's value counts for a row by the product over its features of 1 or 0,
    or of the feature's share where it is left out. For each feature, the sum
    over all sets of the other features is taken by size: a polynomial's
    coefficients times the sizes' weights.
    """
    out = np.zeros((len(x), n_features))
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        inside = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high in zip(leaf.features, leaf.above, leaf.upto)]).astype(float)
        weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for i, f in enumerate(leaf.features):
            sets = np.zeros((d, len(x)))
            sets[0] = 1.0
            for j in range(d):
                if j != i:
                    sets[1:] = sets[1:] * leaf.share[j] + sets[:-1] * inside[j]
                    sets[0] *= leaf.share[j]
            out[:, f] += leaf.value * (inside[i] - leaf.share[i]) * (np.array(weight) @ sets)
    return out


def contributions(model: GBTClassificationModel, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``key``, each feature's part of the row's margin, and ``__base``, the margin's mean over the training rows; they add up to the margin.

    Arrow batches against the table of leaves, which is as large as the model.
    The probability is 1 / (1 + exp(-2 margin)).
    """
    ship_package(df.sparkSession)
    found = leaves(model)
    base = sum(leaf.value * math.prod(leaf.share) for leaf in found)
    shared = df.sparkSession.sparkContext.broadcast(found)
    names = list(features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = attributions(np.stack(frame["__x"].to_numpy()) if len(frame) else np.zeros((0, len(names))), shared.value, len(names))
            yield pd.DataFrame({key: frame[key], **{f: parts[:, i] for i, f in enumerate(names)}, "__base": base})

    kind = df.schema[key].dataType.simpleString()
    data = assemble(df, names).select(key, vector_to_array("x").alias("__x"))
    return data.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` double" for f in names) + ", __base double")
