"""Queries of ranking metrics, scorecard, costs, stability and calibration.

The score is a stand-in with ties: arithmetic of key and label, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators import calibration as C
from sedimenta.operators import costs as K
from sedimenta.operators import metrics as M
from sedimenta.operators import quantiles as Q
from sedimenta.operators import scorecard as S
from sedimenta.operators import stability as B
from sedimenta.operators.reporting import stratified_sample
from sedimenta.plans.tabular import _REALS, SPLIT_SQL, rounded, split_tx, stored_columns
from sedimenta.plans.transactions import TX_SQL
from sedimenta.session import cut_lineage

# The names of the four models. Each stand-in has a step, and a weight of the label.
MODELS = {"M1_baseline_noC": (7919, 0.25), "M2_graph_noC": (6323, 0.15), "M3_baseline_full": (104729, 0.3), "M4_graph_full": (1299709, 0.2)}


def _p(model: str = "M1_baseline_noC") -> Column:
    step, weight = MODELS[model]
    return F.pmod(F.col("TransactionID") * step, F.lit(1000)).cast("double") / 1000 * 0.7 + F.lit(weight) * F.col("isFraud").cast("double") + 0.01


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "isFraud", "TransactionAmt")
    cents = D.cents(F.col("TransactionAmt"))
    return cut_lineage(df.select("TransactionID", "isFraud", "split", _p().alias("p"), cents.alias("cents")))


def q_e4_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.evaluate(scored(spark, sf_dir), "TransactionID", "isFraud", "p"))


def q_e6_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.gain_table(scored(spark, sf_dir), "TransactionID", "isFraud", "p"))


def q_p15_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("TransactionID", S.probability_to_score(F.col("p")).alias("points")))


def q_e5_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = scored(spark, sf_dir).withColumn("points", F.round(S.probability_to_score(F.col("p")), 6))
    return rounded(S.score_bands(points, "points", "isFraud"))


def q_e7_cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.cost_curve(scored(spark, sf_dir), "isFraud", "p", "cents", [500.0]).drop("no_model"))


def q_e8_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.sensitivity(K.cost_curve(scored(spark, sf_dir), "isFraud", "p", "cents", [200.0, 500.0, 1000.0, 2500.0])))


def q_a17_baseline_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.sum(F.when(F.col("isFraud") == 1, F.col("cents")).otherwise(0)).alias("baseline_cents"))


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = cut_lineage(split_tx(spark, sf_dir, "TransactionAmt").select("split", D.cents(F.col("TransactionAmt")).cast("double").alias("v")))
    return df.where("split = 'train'"), df.where("split = 'test'")


def q_e9_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    psi = B.population_stability_index(*_samples(spark, sf_dir), "v")
    return rounded(psi.select("psi", B.psi_verdict(F.col("psi")).alias("verdict")))


def q_e10_psi_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.psi_detail(*_samples(spark, sf_dir), "v"))


def q_e11_csi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored number but the label."""
    features = [c for c in stored_columns(spark, sf_dir, numbers_only=True) if c != "isFraud"]
    return rounded(B.characteristic_stability(split_tx(spark, sf_dir, *features), "split", "train", "test", features), 5)


def q_e12_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.calibration_summary(scored(spark, sf_dir), "isFraud", "p"))


def q_e13_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.reliability_curve(scored(spark, sf_dir), "isFraud", "p"))


def q_e14_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated on the validation period, applied to the test period."""
    df = scored(spark, sf_dir)
    model = C.fit_isotonic(df.where("split = 'val'"), "isFraud", "p")
    made = C.apply_isotonic(model, df.where("split = 'test'").select("TransactionID", "isFraud", "p"), "p", "calibrated")
    return rounded(C.calibration_summary(made, "isFraud", "calibrated"))


def q_e15_calibration_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated on the earlier half of the validation rows, judged on the later half, raw and calibrated."""
    df = cut_lineage(scored(spark, sf_dir).where("split = 'val'"))
    middle = Q.quantiles(df.withColumn("k", F.col("TransactionID").cast("double")), "k", [0.5])
    first, second = df.where(F.col("TransactionID") <= middle[0]), df.where(F.col("TransactionID") > middle[0])
    made = C.apply_isotonic(C.fit_isotonic(first, "isFraud", "p"), second, "p", "q")
    raw = C.calibration_summary(made, "isFraud", "p").withColumn("variant", F.lit("raw"))
    return rounded(raw.unionByName(C.calibration_summary(made, "isFraud", "q").withColumn("variant", F.lit("isotonic"))))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives of the test period and a sample of the others, 400 together, with points and ``weight``."""
    df = scored(spark, sf_dir).where("split = 'test'").select("TransactionID", "isFraud", "cents", F.round(S.probability_to_score(F.col("p")), 6).alias("points"))
    return stratified_sample(df, "TransactionID", "isFraud", 400)


def q_r6_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed share, recall, precision and costs, from a weighted sample, if points at or below 300, 302, ..., 780 are reviewed."""
    return rounded(K.simulate(_sample(spark, sf_dir), "isFraud", "points", "cents", "weight", range(300, 781, 2), 500.0))


def q_r7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold whose reviewed share is nearest to 5 %, the lowest of equals."""
    gap = F.abs(F.col("review_rate") - 0.05)
    return q_r6_simulate(spark, sf_dir).select("threshold", "review_rate", F.round(gap, 6).alias("gap")).orderBy("gap", "threshold").limit(1)


def q_r8_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class in 60 equal bins of the score."""
    inner = Q.linspace(0.0, 1.2, 61)[1:-1]
    return scored(spark, sf_dir).groupBy("isFraud", Q.bin_of(F.col("p"), inner).alias("bin")).agg(F.count("*").alias("n"))


def q_m7_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and KS of four models and the differences between them."""
    base = cut_lineage(split_tx(spark, sf_dir, "isFraud").where("split = 'test'"))
    each = None
    for name in MODELS:
        one = M.evaluate(base.select("TransactionID", "isFraud", _p(name).alias("p")), "TransactionID", "isFraud", "p", ()).select(F.lit(name).alias("model"), F.stack(F.lit(2), F.lit("auc"), F.col("auc"), F.lit("ks"), F.col("ks")).alias("metric", "value"))
        each = one if each is None else each.unionByName(one)
    wide = each.groupBy("metric").pivot("model", list(MODELS)).agg(F.first("value"))
    m1, m2, m3, m4 = (F.col(m) for m in MODELS)
    return rounded(wide.select("metric", *MODELS, (m2 - m1).alias("lift_b1"), (m4 - m3).alias("lift_b2"), (m3 - m1).alias("c_value"), ((m2 - m1) - (m4 - m3)).alias("overlap")))


QUERIES = {n: q for n, q in list(globals().items()) if n.startswith("q_") and q.__module__ == __name__}


def _psql(model: str = "M1_baseline_noC") -> str:
    step, weight = MODELS[model]
    return f"CAST((TransactionID * {step}) % 1000 AS DOUBLE) / 1000 * 0.7::DOUBLE + {weight}::DOUBLE * isFraud::DOUBLE + 0.01::DOUBLE"


_S = f"WITH {TX_SQL}, s AS (SELECT TransactionID, isFraud, cents, {_psql()} AS p, {SPLIT_SQL} AS split FROM tx)"
_D = ", d AS (SELECT p, count(*) AS n, sum(isFraud) AS pos FROM s GROUP BY p), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM d WINDOW w AS (ORDER BY p DESC)), t AS (SELECT count(*)::DOUBLE AS n, sum(isFraud)::DOUBLE AS pos FROM s), r AS (SELECT isFraud, row_number() OVER (ORDER BY p DESC, TransactionID) AS place FROM s)"
_PTS = "least(greatest(round(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * ln((1 - p) / p), 6), 300), 850)"


def _at(k: float, tag: str) -> str:
    hits = f"(SELECT sum(isFraud) FILTER (place <= greatest(1, ceil(t.n * {k}::DOUBLE))) FROM r)"
    top = f"greatest(1, ceil(t.n * {k}::DOUBLE))"
    return f"round({hits} / t.pos, 6) AS recall_at_{tag}, round({hits} / {top}, 6) AS precision_at_{tag}, round({hits} / {top} / (t.pos / t.n), 6) AS lift_at_{tag}"


def _quantile_list(n: int) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in Q.linspace(0.0, 1.0, n)) + "]"


def _list(xs: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"


_CURVE = f"""{_S}, q AS (SELECT DISTINCT unnest(quantile_cont(p, {_quantile_list(200)})) AS threshold FROM s), t AS (SELECT count(*) AS n, sum(isFraud) AS pos, sum(cents) FILTER (isFraud = 1) AS amt FROM s),
  d AS (SELECT p, count(*) AS n, sum(isFraud) AS pos, coalesce(sum(cents) FILTER (isFraud = 1), 0) AS amt FROM s GROUP BY p),
  cv AS (SELECT threshold, coalesce(sum(d.n) FILTER (p >= threshold), 0) AS f, coalesce(sum(d.pos) FILTER (p >= threshold), 0) AS c, coalesce(sum(d.amt) FILTER (p < threshold), 0) AS miss FROM q, d GROUP BY threshold)"""
_SIM = f"""{_S}, te AS (SELECT *, {_PTS} AS points FROM s WHERE split = 'test'), b AS (SELECT count(*) FILTER (isFraud = 0) AS good, count(*) FILTER (isFraud = 1) AS bad FROM te),
  g AS (SELECT isFraud, cents, points, 1.0::DOUBLE AS weight FROM te WHERE isFraud = 1 UNION ALL (SELECT isFraud, cents, points, good / greatest(0, least(good, 400 - bad))::DOUBLE FROM te, b WHERE isFraud = 0 QUALIFY row_number() OVER (ORDER BY md5(TransactionID || '-42'), TransactionID) <= 400 - bad)),
  th AS (SELECT CAST(unnest(range(300, 781, 2)) AS DOUBLE) AS threshold), t AS (SELECT sum(weight) AS n, sum(isFraud) AS pos FROM g),
  d AS (SELECT points, sum(weight) FILTER (isFraud = 0) AS good, sum(isFraud) AS pos, coalesce(sum(cents) FILTER (isFraud = 1), 0) AS amt FROM g GROUP BY points),
  m AS (SELECT threshold, coalesce(sum(d.good) FILTER (points <= threshold), 0) AS f, coalesce(sum(d.pos) FILTER (points <= threshold), 0) AS c, coalesce(sum(d.amt) FILTER (points > threshold), 0) AS miss FROM th, d GROUP BY threshold),
  sim AS (SELECT threshold, round((f + c) / t.n, 6) AS review_rate, round(c / t.pos, 6) AS recall, round(c / nullif(f + c, 0), 6) AS precision, CAST(miss AS BIGINT) AS fn_cost, round(f * 500, 6) AS fp_cost, round(miss + f * 500, 6) AS total_cost FROM m, t)"""
# isotonic regression: of the means of all runs of scores around one, the largest over beginnings of the smallest over ends; between scores a straight line
_ISO = f"""{_S}, fit AS (SELECT p, isFraud AS y FROM s WHERE {{fit}}), pool AS (SELECT row_number() OVER (ORDER BY p) AS i, p, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS w FROM fit GROUP BY p), pre AS (SELECT *, sum(y) OVER (ORDER BY i) AS sy, sum(w) OVER (ORDER BY i) AS sw FROM pool),
  pair AS (SELECT a.i AS a, b.i AS b, min((b.sy - a.sy + a.y) / (b.sw - a.sw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM pre a JOIN pre b ON b.i >= a.i), iso AS (SELECT p AS x, v FROM pool JOIN (SELECT b, max(m) AS v FROM pair GROUP BY b) q ON q.b = i),
  ap AS (SELECT isFraud AS y, p, lo.x AS x0, lo.v AS v0, hi.x AS x1, hi.v AS v1 FROM (SELECT * FROM s WHERE {{judge}}) j ASOF LEFT JOIN iso lo ON j.p >= lo.x ASOF LEFT JOIN iso hi ON j.p <= hi.x),
  cal AS (SELECT y, p, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 WHEN x1 > x0 THEN v0 + (v1 - v0) * (p - x0) / (x1 - x0) ELSE v0 END AS q FROM ap)"""


def _summary(value: str, source: str) -> str:
    return f"""SELECT round(sum(abs(p - y)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier, round(sum(p) / sum(n), 6) AS mean_predicted, round(sum(y) / sum(n), 6) AS actual_rate, round((sum(p) - sum(y)) / sum(n), 6) AS bias
      FROM (SELECT len(list_filter({_list(Q.linspace(0.0, 1.0, 21)[1:-1])}, lambda e: e <= {value})) AS bin, sum({value}) AS p, sum(y) AS y, sum(({value} - y) * ({value} - y)) AS b, count(*) AS n FROM {source} GROUP BY 1)"""


_PSI = f"""WITH {TX_SQL}, v AS (SELECT {SPLIT_SQL} AS split, cents::DOUBLE AS v FROM tx), q AS (SELECT list_sort(list_distinct(quantile_cont(v, {_quantile_list(11)}))) AS e FROM v WHERE split = 'train'),
  b AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, split FROM v, q WHERE split IN ('train', 'test')),
  k AS (SELECT unnest(range(len(e) - 1)) AS bin, unnest(e[1:len(e) - 1]) AS bin_min FROM q),
  det AS (SELECT k.bin, k.bin_min, greatest(count(*) FILTER (split = 'train') / (SELECT count(*) FROM b WHERE split = 'train'), 1e-6) AS e, greatest(count(*) FILTER (split = 'test') / (SELECT count(*) FROM b WHERE split = 'test'), 1e-6) AS a FROM k LEFT JOIN b ON b.bin = k.bin GROUP BY ALL)"""
_CAL = f"{_S}, b AS (SELECT len(list_filter({_list(Q.linspace(0.0, 1.0, 21)[1:-1])}, lambda e: e <= p)) AS bin, p, isFraud AS y FROM s)"
_CSI = " UNION ALL ".join(f"SELECT {SPLIT_SQL} AS split, '{c}' AS feature, {c}::DOUBLE AS v FROM tx" for c in ["card1", "has_identity", *_REALS])
ORACLE = {
    "q_e4_evaluate": f"""{_S}{_D} SELECT round((SELECT sum((n - pos) * (cp - pos / 2)) FROM c) / (t.pos * (t.n - t.pos)), 6) AS auc, (SELECT round(greatest(max(cp / (SELECT pos FROM t) - (cn - cp) / (SELECT n - pos FROM t)), 0), 6) FROM c) AS ks,
        round((SELECT sum(pos / (SELECT pos FROM t) * cp / cn) FROM c), 6) AS pr_auc, round(t.pos / t.n, 6) AS rate, t.n::BIGINT AS n, {_at(0.01, '1pct')}, {_at(0.05, '5pct')}, {_at(0.1, '10pct')} FROM t""",
    "q_e6_gain": f"""{_S}{_D}, g AS (SELECT unnest({_list([(i + 1) / 100 for i in range(100)])}) AS f), h AS (SELECT f, greatest(1, trunc(f * t.n)) AS k, t.pos AS pos FROM g, t), x AS (SELECT place, sum(isFraud) OVER (ORDER BY place) AS c FROM r)
        SELECT round(f, 6) AS review_rate, k::BIGINT AS n_reviewed, round(c / pos, 6) AS recall, round(c / k, 6) AS precision, round(c / pos / f, 6) AS lift FROM h JOIN x ON x.place = h.k""",
    "q_p15_points": f"{_S} SELECT TransactionID, {_PTS} AS points FROM s",
    "q_e5_bands": f"""{_S}, g AS (SELECT isFraud, {_PTS} AS points FROM s), q AS (SELECT list_sort(list_distinct(quantile_cont(points, {_quantile_list(11)}))) AS e FROM g),
        b AS (SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= points)) AS band, points, isFraud FROM g, q), a AS (SELECT band, count(*) AS n, sum(isFraud)::BIGINT AS n_fraud, round(avg(isFraud), 6) AS fraud_rate, round(min(points), 6) AS score_min, round(max(points), 6) AS score_max FROM b GROUP BY band)
        SELECT *, round(n / sum(n) OVER (), 6) AS pct_population, round(sum(n) OVER (ORDER BY band) / sum(n) OVER (), 6) AS cum_pct_population, round(sum(n_fraud) OVER (ORDER BY band) / sum(n_fraud) OVER (), 6) AS cum_pct_fraud FROM a""",
    "q_e7_cost_curve": f"{_CURVE} SELECT 500.0::DOUBLE AS cost_fp, round(threshold, 6) AS threshold, round(f / t.n, 6) AS review_rate, f::BIGINT AS n_flagged, c::BIGINT AS fraud_caught, round(c / t.pos, 6) AS recall, miss::BIGINT AS fn_cost, ((f - c) * 500)::DOUBLE AS fp_cost, (miss + (f - c) * 500)::DOUBLE AS total_cost, (t.amt - miss)::BIGINT AS fraud_value_saved FROM cv, t",
    "q_e8_sensitivity": f"""{_CURVE}, k AS (SELECT cost_fp, threshold, f, c, miss, (f - c) * cost_fp AS fp FROM cv, (SELECT unnest([200.0::DOUBLE, 500, 1000, 2500]) AS cost_fp)),
        o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY cost_fp ORDER BY miss + fp, threshold) = 1)
        SELECT cost_fp, round(threshold, 6) AS optimal_threshold, round(f / t.n, 6) AS review_rate, round(c / t.pos, 6) AS recall, round(miss + fp, 6) AS total_cost, miss::BIGINT AS fn_cost, round(fp, 6) AS fp_cost, round(t.amt - (miss + fp), 6) AS savings_vs_no_model, round((t.amt - (miss + fp)) * 30.0 / 31, 6) AS savings_per_month, round((t.amt - (miss + fp)) / t.amt, 6) AS pct_cost_reduction FROM o, t""",
    "q_a17_baseline_cost": f"{_S} SELECT CAST(sum(cents) FILTER (isFraud = 1) AS BIGINT) AS baseline_cents FROM s",
    "q_e9_psi": f"{_PSI}, x AS (SELECT CASE WHEN count(*) < 2 THEN 0 ELSE sum((a - e) * ln(a / e)) END AS psi FROM det) SELECT round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stabil' WHEN psi < 0.25 THEN 'perlu perhatian' ELSE 'bermasalah' END AS verdict FROM x",
    "q_e10_psi_detail": f"{_PSI} SELECT bin::INTEGER AS bin, round(bin_min, 6) AS bin_min, round(e, 6) AS expected_pct, round(a, 6) AS actual_pct, round((a - e) * ln(a / e), 6) AS psi_contribution FROM det",
    "q_e11_csi": f"""WITH {TX_SQL}, l AS ({_CSI}), v AS (SELECT * FROM l WHERE split IN ('train', 'test') AND v IS NOT NULL AND NOT isnan(v)), q AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {_quantile_list(11)}))) AS e FROM v WHERE split = 'train' GROUP BY feature),
        b AS (SELECT v.feature, len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, split FROM v JOIN q ON q.feature = v.feature), k AS (SELECT feature, unnest(range(greatest(len(e) - 1, 1))) AS bin, len(e) AS m FROM q),
        t AS (SELECT feature, count(*) FILTER (split = 'train') AS ne, count(*) FILTER (split = 'test') AS na, avg(v) FILTER (split = 'train') AS me, avg(v) FILTER (split = 'test') AS ma FROM v GROUP BY feature),
        sh AS (SELECT k.feature, k.bin, any_value(m) AS m, greatest(count(*) FILTER (split = 'train') / any_value(ne), 1e-6) AS e, greatest(count(*) FILTER (split = 'test') / any_value(na), 1e-6) AS a FROM k JOIN t ON t.feature = k.feature LEFT JOIN b ON b.feature = k.feature AND b.bin = k.bin GROUP BY k.feature, k.bin),
        x AS (SELECT feature, CASE WHEN any_value(m) < 3 THEN 0 ELSE sum((a - e) * ln(a / e)) END AS csi FROM sh GROUP BY feature)
        SELECT x.feature, round(csi, 5) AS csi, CASE WHEN csi < 0.1 THEN 'stabil' WHEN csi < 0.25 THEN 'perlu perhatian' ELSE 'bermasalah' END AS verdict, round(me, 5) AS mean_expected, round(ma, 5) AS mean_actual, round((ma - me) / (abs(me) + 1e-6), 5) AS pct_change FROM x JOIN t ON t.feature = x.feature WHERE ne >= 10 AND na >= 10""",
    "q_e12_calibration": f"{_CAL}, g AS (SELECT bin, sum(p) AS p, sum(y) AS y, sum((p - y) * (p - y)) AS b, count(*) AS n FROM b GROUP BY bin) SELECT round(sum(abs(p - y)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier, round(sum(p) / sum(n), 6) AS mean_predicted, round(sum(y) / sum(n), 6) AS actual_rate, round((sum(p) - sum(y)) / sum(n), 6) AS bias FROM g",
    "q_e13_reliability": f"{_CAL} SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS actual_rate FROM b GROUP BY bin",
    "q_e14_isotonic": _ISO.format(fit="split = 'val'", judge="split = 'test'") + " " + _summary("q", "cal"),
    "q_e15_calibration_halves": _ISO.format(fit="split = 'val' AND TransactionID <= (SELECT quantile_cont(TransactionID::DOUBLE, 0.5) FROM s WHERE split = 'val')", judge="split = 'val' AND TransactionID > (SELECT quantile_cont(TransactionID::DOUBLE, 0.5) FROM s WHERE split = 'val')") + f", o AS (SELECT 'raw' AS variant, * FROM ({_summary('p', 'cal')}) UNION ALL SELECT 'isotonic', * FROM ({_summary('q', 'cal')})) SELECT * FROM o",
    "q_r6_simulate": f"{_SIM} SELECT * FROM sim",
    "q_r7_nearest": f"{_SIM} SELECT threshold, review_rate, round(abs(review_rate - 0.05::DOUBLE), 6) AS gap FROM sim ORDER BY gap, threshold LIMIT 1",
    "q_r8_histogram": f"{_S} SELECT isFraud, len(list_filter({_list(Q.linspace(0.0, 1.2, 61)[1:-1])}, lambda e: e <= p))::INTEGER AS bin, count(*) AS n FROM s GROUP BY 1, 2",
    "q_m7_comparison": f"WITH {TX_SQL}, m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, isFraud, {_psql(m)} AS p FROM tx WHERE {SPLIT_SQL} = 'test'" for m in MODELS) + """),
        d AS (SELECT model, p, count(*) AS n, sum(isFraud) AS pos FROM m GROUP BY model, p), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM d WINDOW w AS (PARTITION BY model ORDER BY p DESC)), t AS (SELECT model, sum(n)::DOUBLE AS tn, sum(pos)::DOUBLE AS tp FROM d GROUP BY model),
        e AS (SELECT c.model, sum((n - pos) * (cp - pos / 2)) / any_value(tp * (tn - tp)) AS auc, greatest(max(cp / tp - (cn - cp) / (tn - tp)), 0) AS ks FROM c JOIN t ON t.model = c.model GROUP BY c.model),
        l AS (SELECT model, 'auc' AS metric, auc AS value FROM e UNION ALL SELECT model, 'ks', ks FROM e),
        w AS (SELECT metric, """ + ", ".join(f"max(value) FILTER (model = '{m}') AS {m}" for m in MODELS) + """ FROM l GROUP BY metric)
        SELECT metric, round(M1_baseline_noC, 6) AS M1_baseline_noC, round(M2_graph_noC, 6) AS M2_graph_noC, round(M3_baseline_full, 6) AS M3_baseline_full, round(M4_graph_full, 6) AS M4_graph_full,
        round(M2_graph_noC - M1_baseline_noC, 6) AS lift_b1, round(M4_graph_full - M3_baseline_full, 6) AS lift_b2, round(M3_baseline_full - M1_baseline_noC, 6) AS c_value, round((M2_graph_noC - M1_baseline_noC) - (M4_graph_full - M3_baseline_full), 6) AS overlap FROM w""",
}
