"""Queries of models: training, weights, attributions, the ablation protocol, and the evaluation of scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators import boosting as X
from sedimenta.operators import evaluation_run as V
from sedimenta.operators import metrics as M
from sedimenta.operators import reporting as R
from sedimenta.operators.calibration import apply_isotonic, calibration_summary, fit_isotonic
from sedimenta.operators.quantiles import quantiles
from sedimenta.operators.relational import select_features
from sedimenta.plans.evaluation import _ISO, _PTS, _S, MODELS, _p, _psql, _summary, scored
from sedimenta.plans.evaluation import ORACLE as EVALUATION
from sedimenta.plans.graph_features import graph_table
from sedimenta.plans.tabular import SPLIT_SQL, matrix, rounded, split_tx
from sedimenta.plans.transactions import TX_SQL
from sedimenta.session import checkpoint_dir, cut_lineage

# The blocks of the four models, the feature on trial and the one it is measured against.
BASE = ("base", "derived", "label_encode", "frequency_encode", "aggregations", "D", "V", "id")
BLOCKS = {"M1_baseline_noC": BASE, "M2_graph_noC": (*BASE, "graph", "uid"), "M3_baseline_full": (*BASE, "C"), "M4_graph_full": (*BASE, "C", "graph", "uid")}
TWO_HOP, ONE_HOP = "graph_nb_fraud_rate_2hop", "graph_nb_fraud_rate_1hop"
#: What the queries train with; README has what it leaves of the reference's 3000 rounds at depth 7.
CONFIG = X.BoostConfig(rounds=40, patience=10, depth=4)


def _fitted(df: DataFrame, model: str, excluded: tuple[str, ...] = (), weight: float = 1.0) -> tuple[X.GBTClassificationModel, list[str]]:
    features = select_features(df.columns, BLOCKS[model], excluded)
    seen = df.where("split in ('train', 'val')").withColumn("is_val", F.col("split") == "val")
    return X.train_boosted(seen, features, "isFraud", "is_val", weight, CONFIG), features


def _scores(df: DataFrame, fitted: tuple[X.GBTClassificationModel, list[str]]) -> DataFrame:
    """Scores of a model; written, as the metrics read them several times."""
    made = X.predict(fitted[0], df, fitted[1])
    return cut_lineage(made.select("TransactionID", "isFraud", "split", D.cents(F.col("TransactionAmt")).alias("cents"), "p"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(matrix(spark, sf_dir))


def q_m1_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full tabular model: fitted on the training period, stopped on the validation period, judged on the test period."""
    df = _matrix(spark, sf_dir)
    fitted = _fitted(df, "M3_baseline_full")
    made = M.evaluate(_scores(df.where("split = 'test'"), fitted), "TransactionID", "isFraud", "p")
    return rounded(made.withColumns({"n_features": F.lit(len(fitted[1])), "trees": F.lit(fitted[0].getNumTrees)}))


def q_m3_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking and calibration on the validation period for three weights of positives."""
    df, out = _matrix(spark, sf_dir), None
    for w in (1.0, 5.0, 27.6):
        val = _scores(df.where("split = 'val'"), _fitted(df, "M3_baseline_full", weight=w))
        one = calibration_summary(val, "isFraud", "p").join(M.evaluate(val, "TransactionID", "isFraud", "p")).withColumn("positive_weight", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def q_m4_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the features of the full model: their mean absolute parts of the margin, on a seeded sample of validation rows."""
    df = _matrix(spark, sf_dir)
    return rounded(_importance(df, *_fitted(df, "M3_baseline_full")))


def _importance(df: DataFrame, model: X.GBTClassificationModel, features: list[str]) -> DataFrame:
    sample = cut_lineage(R.hash_sample(df.where("split = 'val'"), "TransactionID", 2000))
    return R.importance_table(X.contributions(model, sample, "TransactionID", features), features)


def q_r10_swarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a swarm of attributions is drawn from: value and part of the margin of the 20 weightiest features, for each sampled validation row."""
    df = _matrix(spark, sf_dir)
    model, features = _fitted(df, "M3_baseline_full")
    sample = cut_lineage(R.hash_sample(df.where("split = 'val'"), "TransactionID", 2000))
    parts = cut_lineage(X.contributions(model, sample, "TransactionID", features))
    top = [r["feature"] for r in R.importance_table(parts, features).where("place <= 20").collect()]
    both = sample.select("TransactionID", *[F.col(f).cast("double").alias(f"v_{f}") for f in top]).join(parts, "TransactionID")
    stacked = [x for f in top for x in (F.lit(f), F.col(f"v_{f}"), F.col(f))]
    return both.select("TransactionID", F.stack(F.lit(len(top)), *stacked).alias("feature", "value", "part"))


def q_e15_weight_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For two weights of positives: calibrated on the earlier half of the validation rows, judged on the later half, raw and calibrated."""
    df, out = _matrix(spark, sf_dir), None
    for w in (1.0, 5.0):
        val = _scores(df.where("split = 'val'"), _fitted(df, "M3_baseline_full", weight=w))
        middle = quantiles(val.withColumn("k", F.col("TransactionID").cast("double")), "k", [0.5])[0]
        late = cut_lineage(apply_isotonic(fit_isotonic(val.where(F.col("TransactionID") <= middle), "isFraud", "p"), val.where(F.col("TransactionID") > middle), "p", "q"))
        for name, c in (("raw", "p"), ("isotonic", "q")):
            one = M.evaluate(late, "TransactionID", "isFraud", c, ()).select("auc", "ks", "pr_auc").join(calibration_summary(late, "isFraud", c)).withColumns({"positive_weight": F.lit(w), "calibration": F.lit(name)})
            out = one if out is None else out.unionByName(one)
    return rounded(out)


def q_m6_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models, with and without graph features and counters.

    First the validation period: all four are fitted, and the attributions of
    the largest decide whether the two-hop rate goes; if so, the models that
    had it are fitted again without. Then the test period is opened once, for
    all four, and each is logged.
    """
    df = cut_lineage(matrix(spark, sf_dir).join(graph_table(spark, sf_dir).withColumnRenamed("tx", "TransactionID"), "TransactionID"))
    fitted = {m: _fitted(df, m) for m in BLOCKS}
    dropped = R.drop_feature(_importance(df, *fitted["M4_graph_full"]), TWO_HOP, ONE_HOP).first()["dropped"]
    if dropped:
        fitted |= {m: _fitted(df, m, (TWO_HOP,)) for m in BLOCKS if "graph" in BLOCKS[m]}
    path, log = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}", None
    for m, one in fitted.items():
        scores = _scores(df.where("split in ('val', 'test')"), one)
        val, test = ({k: v for k, v in M.evaluate(scores.where(F.col("split") == s), "TransactionID", "isFraud", "p").first().asDict().items()} for s in ("val", "test"))
        log = R.log_experiment(spark, path, m, "+".join(BLOCKS[m]), CONFIG.__dict__, val, test, len(one[1]), one[0].getNumTrees, 1.0, f"two-hop rate {'dropped' if dropped else 'kept'}")
    return rounded(R.tested_experiments(log).drop("timestamp"))


def q_r12_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation of a stand-in score."""
    return rounded(V.evaluation_run(scored(spark, sf_dir), "TransactionID", "isFraud", "p", "cents"))


def q_r12_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation of the full tabular model, with the stability of its first 20 features."""
    df = _matrix(spark, sf_dir)
    fitted = _fitted(df, "M3_baseline_full")
    return rounded(V.evaluation_run(_scores(df.where("split <> 'gap'"), fitted), "TransactionID", "isFraud", "p", "cents", features=df, columns=fitted[1][:20]))


def q_r1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document of four stand-in models."""
    base, tested = cut_lineage(split_tx(spark, sf_dir, "isFraud").where("split in ('val', 'test')")), None
    for name in MODELS:
        scores = base.select("TransactionID", "isFraud", "split", _p(name).alias("p"))
        one = spark.createDataFrame([(name, len(name))], "name string, n_features long")
        for s in ("val", "test"):
            made = M.evaluate(scores.where(F.col("split") == s), "TransactionID", "isFraud", "p")
            one = one.join(made.select(*[F.col(m).alias(f"{s}_{m}") for m in V.METRICS]))
        tested = one if tested is None else tested.unionByName(one)
    return V.metrics_document(tested)


def q_r2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain curve, bands, sample and costs of a stand-in score as documents; the sample has 400 rows at most."""
    return V.scoring_documents(scored(spark, sf_dir).where("split = 'test'"), "TransactionID", "isFraud", "p", "cents", most=400)


def q_r2_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents of the full tabular model."""
    df = _matrix(spark, sf_dir)
    return V.scoring_documents(_scores(df.where("split = 'test'"), _fitted(df, "M3_baseline_full")), "TransactionID", "isFraud", "p", "cents")


QUERIES = {n: q for n, q in list(globals().items()) if n.startswith("q_") and q.__module__ == __name__}

_TEST = f"WITH {TX_SQL}, s AS (SELECT TransactionID, isFraud, cents, {_psql()} AS p, {SPLIT_SQL} AS split FROM tx WHERE {SPLIT_SQL} = 'test')"
_DOLLARS = f"WITH {TX_SQL}, s AS (SELECT TransactionID, isFraud, cents / 100.0::DOUBLE AS cents, {_psql()} AS p, {SPLIT_SQL} AS split FROM tx WHERE {SPLIT_SQL} = 'test')"


def _part(section: str, name: str, metrics: list[str], sql: str) -> str:
    return f"SELECT '{section}' AS section, {name} AS name, unnest([{', '.join(repr(m) for m in metrics)}]) AS metric, unnest([{', '.join(f'{m}::DOUBLE' for m in metrics)}]) AS value FROM ({sql})"


_COSTED = EVALUATION["q_e8_sensitivity"].replace(_S, _DOLLARS).replace("[200.0::DOUBLE, 500, 1000, 2500]", "[2.0::DOUBLE, 5, 10, 25]").replace("miss::BIGINT AS fn_cost", "miss AS fn_cost")
_TESTED = _ISO.format(fit="split = 'val'", judge="split = 'test'")
_PSI_OF_P = EVALUATION["q_e9_psi"].replace(f"v AS (SELECT {SPLIT_SQL} AS split, cents::DOUBLE AS v FROM tx)", f"v AS (SELECT {SPLIT_SQL} AS split, {_psql()} AS v FROM tx)")
_CALIBRATED = ["ece", "brier", "mean_predicted", "actual_rate", "bias"]


def _document_sql() -> str:
    """The metrics document, put together as text; numbers have four digits."""
    number = lambda x: f"CAST(CAST({x} AS DECIMAL(20,4)) AS VARCHAR)"
    pair = lambda prefix: " || ',' || ".join(f"""'"{m}":' || {number(prefix.format(m))}""" for m in V.METRICS)
    models = f"""'{{"name":"' || v.model || '","n_features":' || length(v.model) || ',"has_graph":' || contains(v.model, 'graph') || ',"has_c":' || contains(v.model, 'full') || ',"val":{{' || {pair('v.{}')} || '}},"test":{{' || {pair('t.{}')} || '}}}}'"""
    get = lambda n, m: f"max({m}) FILTER (model = '{n}')"
    diffs = {k: {m: f"({get(a, m)} - {get(b, m)})" for m in V.METRICS} for k, (a, b) in V.LIFTS.items()}
    diffs["overlap"] = {m: f"({diffs['lift_b1'][m]} - {diffs['lift_b2'][m]})" for m in V.METRICS}
    lifts = " || ',' || ".join(f"""'"{k}":{{' || """ + " || ',' || ".join(f"""'"{m}":' || {number(x)}""" for m, x in one.items()) + " || '}'" for k, one in diffs.items())
    ms = " UNION ALL ".join(f"SELECT '{m}' AS model, {SPLIT_SQL} AS split, TransactionID, isFraud, {_psql(m)} AS p FROM tx" for m in MODELS)
    return f"""WITH {TX_SQL}, m AS (SELECT * FROM ({ms}) WHERE split IN ('val', 'test')), d AS (SELECT model, split, p, count(*) AS n, sum(isFraud) AS pos FROM m GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY model, split)::DOUBLE AS tn, sum(pos) OVER (PARTITION BY model, split)::DOUBLE AS tp FROM d WINDOW w AS (PARTITION BY model, split ORDER BY p DESC)),
      r AS (SELECT model, split, isFraud, row_number() OVER (PARTITION BY model, split ORDER BY p DESC, TransactionID) AS place FROM m),
      x AS (SELECT model, split, sum((n - pos) * (cp - pos / 2)) / any_value(tp * (tn - tp)) AS auc, greatest(max(cp / tp - (cn - cp) / (tn - tp)), 0) AS ks, sum(pos / tp * cp / cn) AS pr_auc, any_value(tn) AS tn, any_value(tp) AS tp FROM c GROUP BY ALL),
      h AS (SELECT x.model, x.split, {', '.join(f"sum(isFraud) FILTER (place <= greatest(1, ceil(x.tn * {k}::DOUBLE))) / any_value(x.tp) AS recall_at_{n}" for k, n in ((0.01, '1pct'), (0.05, '5pct'), (0.1, '10pct')))} FROM x JOIN r ON r.model = x.model AND r.split = x.split GROUP BY 1, 2),
      e AS (SELECT x.*, h.* EXCLUDE (model, split) FROM x JOIN h ON h.model = x.model AND h.split = x.split), o AS (SELECT string_agg({models}, ',' ORDER BY v.model) AS t FROM e v JOIN e t ON t.model = v.model WHERE v.split = 'val' AND t.split = 'test'),
      l AS (SELECT {lifts} AS t FROM e WHERE split = 'test') SELECT '{{"models":[' || o.t || '],"lifts":{{' || l.t || '}}}}' AS document FROM o, l"""


def _joined(order: str, **columns: int) -> str:
    """Lists of numbers with fixed digits, as the fields of a JSON object."""
    return " || ',' || ".join(f"""'"{c}":[' || string_agg(CAST(CAST({c} AS DECIMAL(20,{d})) AS VARCHAR), ',' ORDER BY {order}) || ']'""" for c, d in columns.items())


def _objects(order: str, **columns: int | None) -> str:
    """A list of JSON objects; None: a whole number."""
    fields = " || ',' || ".join(f"""'"{c}":' || """ + (f"{c}" if d is None else f"CAST(CAST({c} AS DECIMAL(20,{d})) AS VARCHAR)") for c, d in columns.items())
    return f"'[' || string_agg('{{' || {fields} || '}}', ',' ORDER BY {order}) || ']'"


def _finer(sql: str) -> str:
    """Over the test period, and rounded so late that fixed digits aren't rounded twice."""
    return sql.replace(_S, _TEST).replace(_PTS, "points_of_p").replace(", 6)", ", 12)").replace("points_of_p", _PTS)


_DOCUMENTS = f"""SELECT 'gain_curve' AS name, '{{' || {_joined('review_rate', review_rate=4, recall=4, lift=3, precision=4)} || '}}' AS document FROM ({_finer(EVALUATION['q_e6_gain'])})
  UNION ALL SELECT 'score_bands', {_objects('band', band=None, n=None, n_fraud=None, fraud_rate=5, score_min=1, score_max=1, cum_pct_fraud=4)} FROM ({_finer(EVALUATION['q_e5_bands'])})
  UNION ALL SELECT 'score_sample', '{{"sampling":{{"n_total_test":' || any_value(total) || ',"n_sampled":' || count(*) || ',"n_fraud_sampled":' || sum(isFraud) || ',"good_weight":' || coalesce(CAST(CAST(max(weight) FILTER (isFraud = 0) AS DECIMAL(20,4)) AS VARCHAR), 'null') || '}},' || {_joined('TransactionID', score=1, prob=5)} || ',"label":[' || string_agg(isFraud::VARCHAR, ',' ORDER BY TransactionID) || '],' || {_joined('TransactionID', amount=2)} || '}}'
    FROM ({_TEST}, b AS (SELECT count(*) AS total, count(*) FILTER (isFraud = 0) AS good, count(*) FILTER (isFraud = 1) AS bad FROM s), g AS (SELECT TransactionID, isFraud, p AS prob, {_PTS} AS score, cents / 100.0::DOUBLE AS amount, total, 1.0::DOUBLE AS weight FROM s, b WHERE isFraud = 1
      UNION ALL (SELECT TransactionID, isFraud, p, {_PTS}, cents / 100.0::DOUBLE, total, good / greatest(0, least(good, 400 - bad))::DOUBLE FROM s, b WHERE isFraud = 0 QUALIFY row_number() OVER (ORDER BY md5(TransactionID || '-42'), TransactionID) <= 400 - bad)) SELECT * FROM g)
  UNION ALL SELECT 'cost_sensitivity', '{{"baseline_cost":' || CAST(CAST((SELECT amt FROM base) AS DECIMAL(20,2)) AS VARCHAR) || ',"days_in_period":31,"scenarios":' || {_objects('cost_fp', cost_fp=1, optimal_threshold=5, review_rate=4, recall=4, total_cost=2, savings_per_month=2, pct_cost_reduction=4)} || '}}' FROM ({_finer(_COSTED)})"""
ORACLE = {
    "q_r2_documents": f"WITH base AS ({_TEST} SELECT sum(cents) FILTER (isFraud = 1) / 100.0::DOUBLE AS amt FROM s) {_DOCUMENTS}",
    "q_r1_metrics": _document_sql(),
    "q_r12_evaluation": " UNION ALL ".join([
        _part("scorecard", "isFraud::VARCHAR", ["mean_points", "n"], f"{_TEST} SELECT isFraud, round(avg({_PTS}), 6) AS mean_points, count(*) AS n FROM s GROUP BY 1"),
        _part("bands", "band::VARCHAR", ["n", "n_fraud", "fraud_rate", "score_min", "score_max", "cum_pct_fraud"], EVALUATION["q_e5_bands"].replace(_S, _TEST)),
        _part("ranking", "'test'", ["auc", "ks", "pr_auc", "recall_at_1pct", "recall_at_5pct", "recall_at_10pct"], EVALUATION["q_e4_evaluate"].replace(_S, _TEST)),
        _part("costs", "cost_fp::INTEGER::VARCHAR", ["optimal_threshold", "review_rate", "recall", "total_cost", "savings_per_month", "pct_cost_reduction"], _COSTED),
        _part("stability", "'score'", ["psi"], _PSI_OF_P),
        _part("calibration", "'raw'", _CALIBRATED, f"{_TESTED} {_summary('p', 'cal')}"),
        _part("calibration", "'isotonic'", _CALIBRATED, f"{_TESTED} {_summary('q', 'cal')}"),
        _part("calibration", "'isotonic'", ["auc"], f"{_TESTED}, dq AS (SELECT round(q, 12) AS q, count(*) AS n, sum(y) AS pos FROM cal GROUP BY 1), cq AS (SELECT *, sum(pos) OVER (ORDER BY q DESC) AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM dq) SELECT round(sum((n - pos) * (cp - pos / 2)) / any_value(tp::DOUBLE * (tn - tp)), 6) AS auc FROM cq"),
    ]),
}
