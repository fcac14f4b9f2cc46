"""The evaluation of one model's scores as a whole: scorecard, costs, stability and calibration; and the documents a dashboard reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import calibration as C
from sedimenta.operators import costs as K
from sedimenta.operators import metrics as M
from sedimenta.operators import scorecard as S
from sedimenta.operators import stability as B
from sedimenta.operators.reporting import as_json, stratified_sample

# Costs of a false positive, and the keys of the metrics and of the models that are compared.
COSTS = (2.0, 5.0, 10.0, 25.0)
METRICS = ("auc", "ks", "pr_auc", "recall_at_1pct", "recall_at_5pct", "recall_at_10pct")
LIFTS = {"lift_b1": ("M2_graph_noC", "M1_baseline_noC"), "lift_b2": ("M4_graph_full", "M3_baseline_full"), "value_of_c": ("M3_baseline_full", "M1_baseline_noC")}


def _long(df: DataFrame, section: str, name: Column, metrics: Sequence[str]) -> DataFrame:
    parts = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.stack(F.lit(len(metrics)), *parts).alias("metric", "value"))


def evaluation_run(scored: DataFrame, key: str, label: str, p: str, amount: str, split: str = "split", features: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """``section``, ``name``, ``metric`` and ``value`` of every part, judged on the test period.

    The calibrator is fitted on the validation period only. ``amount`` is in
    whole cents. ``features`` (``split`` and ``columns``), if given, adds the
    columns' stability between training and test.
    """
    train, val, test = (scored.where(F.col(split) == s) for s in ("train", "val", "test"))
    points = test.withColumn("points", F.round(S.probability_to_score(F.col(p)), 6))
    money = test.withColumn("__amount", F.col(amount) / 100)
    means = points.groupBy(label).agg(F.avg("points").alias("mean_points"), F.count("*").alias("n"))
    curve = K.cost_curve(money, label, p, "__amount", COSTS)
    psi = B.population_stability_index(train, test, p)
    made = C.apply_isotonic(C.fit_isotonic(val, label, p), test, p, "__q")
    names = ["ece", "brier", "mean_predicted", "actual_rate", "bias"]
    parts = [
        _long(means, "scorecard", F.col(label), ["mean_points", "n"]),
        _long(S.score_bands(points, "points", label), "bands", F.col("band"), ["n", "n_fraud", "fraud_rate", "score_min", "score_max", "cum_pct_fraud"]),
        _long(M.evaluate(test, key, label, p), "ranking", F.lit("test"), ["auc", "ks", "pr_auc", "recall_at_1pct", "recall_at_5pct", "recall_at_10pct"]),
        _long(K.sensitivity(curve), "costs", F.col("cost_fp").cast("int"), ["optimal_threshold", "review_rate", "recall", "total_cost", "savings_per_month", "pct_cost_reduction"]),
        _long(psi, "stability", F.lit("score"), ["psi"]),
        _long(C.calibration_summary(made, label, p), "calibration", F.lit("raw"), names),
        _long(C.calibration_summary(made, label, "__q"), "calibration", F.lit("isotonic"), names),
        _long(M.evaluate(made, key, label, "__q", ()), "calibration", F.lit("isotonic"), ["auc"]),
    ]
    if features is not None:
        parts.append(_long(B.characteristic_stability(features, split, "train", "test", columns), "csi", F.col("feature"), ["csi"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fixed(value: Column, digits: int) -> Column:
    """A number with a fixed number of digits, halves away from zero."""
    return value.cast(f"decimal(20,{digits})")


def _field(rows: Column, name: str) -> Column:
    """One field of each struct of an array."""
    return F.transform(rows, lambda x: x[name]).alias(name)


def metrics_document(tested: DataFrame) -> DataFrame:
    """One ``document``: each tested model with its metrics of both periods, and the differences that the comparison is about.

    ``tested`` has ``name``, ``n_features`` and each metric with the prefixes
    ``val_`` and ``test_``; one row per model. A difference of models that
    aren't there is null.
    """
    both = {period: F.struct(*[_fixed(F.col(f"{period}_{m}"), 4).alias(m) for m in METRICS]).alias(period) for period in ("val", "test")}
    model = F.struct("name", "n_features", F.col("name").contains("graph").alias("has_graph"), F.col("name").contains("full").alias("has_c"), both["val"], both["test"])
    of = {n: {m: F.max(F.when(F.col("name") == n, F.col(f"test_{m}"))) for m in METRICS} for pair in LIFTS.values() for n in pair}
    lift = {k: {m: of[a][m] - of[b][m] for m in METRICS} for k, (a, b) in LIFTS.items()}
    lift["overlap"] = {m: lift["lift_b1"][m] - lift["lift_b2"][m] for m in METRICS}
    lifts = F.struct(*[F.struct(*[_fixed(x, 4).alias(m) for m, x in one.items()]).alias(k) for k, one in lift.items()])
    return as_json(tested.agg(F.array_sort(F.collect_list(model)).alias("models"), lifts.alias("lifts")))


def scoring_documents(test: DataFrame, key: str, label: str, p: str, amount: str, days: int = 31, most: int = 20_000) -> DataFrame:
    """``name`` and ``document``: gain curve, score bands, a weighted sample of scores, and costs; ``amount`` is in whole cents.

    The sample holds all positives and ``most`` rows at most; the curve has
    100 points and there are ten bands, so each document is bounded.
    """
    spark = test.sparkSession
    points = test.withColumn("points", F.round(S.probability_to_score(F.col(p)), 6))
    curve = M.gain_table(test, key, label, p)
    digits = {"review_rate": 4, "recall": 4, "lift": 3, "precision": 4}
    fixed = curve.select(F.col("review_rate").alias("at"), *[_fixed(F.col(c), d).alias(c) for c, d in digits.items()])
    lists = [_field(F.array_sort(F.collect_list(F.struct("at", c))), c) for c in digits]
    bands = S.score_bands(points, "points", label).select("band", "n", "n_fraud", _fixed(F.col("fraud_rate"), 5).alias("fraud_rate"), _fixed(F.col("score_min"), 1).alias("score_min"), _fixed(F.col("score_max"), 1).alias("score_max"), _fixed(F.col("cum_pct_fraud"), 4).alias("cum_pct_fraud"))
    sample = stratified_sample(points, key, label, most)
    n = test.count()
    drawn = sample.agg(
        F.struct(F.lit(n).alias("n_total_test"), F.count("*").alias("n_sampled"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_fraud_sampled"), _fixed(F.max(F.when(F.col(label) == 0, F.col("weight"))), 4).alias("good_weight")).alias("sampling"),
        F.array_sort(F.collect_list(F.struct(key, _fixed(F.col("points"), 1).alias("score"), _fixed(F.col(p), 5).alias("prob"), F.col(label).alias("label"), _fixed(F.col(amount) / 100, 2).alias("amount")))).alias("__x"),
    ).select("sampling", *[_field(F.col("__x"), c) for c in ("score", "prob", "label", "amount")])
    money = K.sensitivity(K.cost_curve(test.withColumn("__a", F.col(amount) / 100), label, p, "__a", COSTS), days)
    digits = {"cost_fp": 1, "optimal_threshold": 5, "review_rate": 4, "recall": 4, "total_cost": 2, "savings_per_month": 2, "pct_cost_reduction": 4}
    scenario = F.struct(*[_fixed(F.col(c), d).alias(c) for c, d in digits.items()])
    lost = test.agg(_fixed(F.coalesce(F.sum(F.when(F.col(label) == 1, F.col(amount))), F.lit(0)) / 100, 2).alias("baseline_cost"))
    priced = money.agg(F.lit(days).alias("days_in_period"), F.array_sort(F.collect_list(scenario)).alias("scenarios")).join(lost).select("baseline_cost", "days_in_period", "scenarios")
    documents: Mapping[str, DataFrame] = {
        "gain_curve": as_json(fixed.agg(*lists)), "score_bands": bands.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*bands.columns)))).alias("document")),
        "score_sample": as_json(drawn), "cost_sensitivity": as_json(priced),
    }
    out = spark.createDataFrame([], "name string, document string")
    for name, df in documents.items():
        out = out.unionByName(df.select(F.lit(name).alias("name"), "document"))
    return out
