"""Ranking metrics, scorecard, costs, stability and calibration against NumPy on drawn scores with ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import calibration, costs, metrics, scorecard, stability


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(12)
    y = (rng.random(700) < 0.15).astype(int)
    score = np.round(np.clip(rng.normal(0.3 + 0.2 * y, 0.15), 0.01, 0.99), 2)  # many ties
    return y, score, rng.integers(100, 90_000, 700)


@pytest.fixture(scope="module")
def scored(spark, drawn):
    y, s, a = drawn
    return spark.createDataFrame([(i, int(y[i]), float(s[i]), int(a[i])) for i in range(700)] + [(900, 1, None, 5)], "k long, y int, s double, cents long").cache()


def test_ranking_metrics_equal_their_definitions(scored, drawn):
    y, s, _ = drawn
    r = metrics.evaluate(scored, "k", "y", "s", (0.004, 0.05, 0.1)).first()
    pos, neg = s[y == 1], s[y == 0]
    assert r.auc == pytest.approx(((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()))
    cuts = np.unique(s)[::-1]
    tpr, fpr = np.array([[(pos >= c).mean(), (neg >= c).mean()] for c in cuts]).T
    precision = np.array([y[s >= c].mean() for c in cuts])
    assert r.ks == pytest.approx((tpr - fpr).max()) and r.pr_auc == pytest.approx((np.diff(np.r_[0, tpr]) * precision).sum()) and r.n == 700
    order = np.lexsort((np.arange(700), -s))
    for k, name in ((0.004, "0.4pct"), (0.05, "5pct"), (0.1, "10pct")):
        top = y[order][: math.ceil(700 * k)]
        assert r[f"recall_at_{name}"] == pytest.approx(top.sum() / y.sum()) and r[f"lift_at_{name}"] == pytest.approx(top.mean() / y.mean())


def test_gain_table_with_ties(scored, drawn):
    y, s, _ = drawn
    got = {round(r.review_rate, 9): r for r in metrics.gain_table(scored, "k", "y", "s", 40).collect()}
    order = np.lexsort((np.arange(700), -s))
    for i in range(1, 41):
        n = max(1, int(i / 40 * 700))
        hits = y[order][:n].sum()
        r = got[round(i / 40, 9)]
        assert (r.n_reviewed, r.recall) == (n, pytest.approx(hits / y.sum())) and r.lift == pytest.approx(hits / y.sum() / (i / 40))


def test_metrics_at_the_ends(spark, scored):
    constant = metrics.evaluate(scored.where("s is not null").withColumn("s", F.lit(1.5)), "k", "y", "s").first()
    assert (constant.auc, constant.ks) == (0.5, 0.0) and constant.recall_at_10pct >= 0
    best = metrics.evaluate(scored.where("s is not null").withColumn("s", F.col("y") + F.lit(0.25)), "k", "y", "s").first()
    assert (best.auc, best.ks, best.pr_auc) == (1.0, 1.0, 1.0)
    only = metrics.evaluate(scored.where("y = 0"), "k", "y", "s").first()
    assert only.auc is None and only.recall_at_1pct is None and only.precision_at_1pct == 0
    assert metrics.gain_table(scored.limit(0), "k", "y", "s", 5).collect() == [] and metrics.evaluate(scored.limit(0), "k", "y", "s").first().n == 0
    assert metrics.metrics_line({"auc": 0.91239, "n": 7, "ks": None}) == "auc 0.9124 | n 7 | ks -"


def test_points_double_the_odds(spark):
    p = [0.2, 1 / 9, 1 / 17, 1.0, 0.0]
    shown = spark.createDataFrame([(x,) for x in p], "p double").select(scorecard.probability_to_score(F.col("p"), pdo=30.0, anchor_score=500.0, anchor_odds=4.0, low=200.0, high=640.0))
    # odds of 4, 8 and 16 to 1
    assert [r[0] for r in shown.collect()] == pytest.approx([500, 530, 560, 200, 640])


def test_bands(spark, scored, drawn):
    y, s, _ = drawn
    edges = np.unique(np.quantile(s, np.linspace(0, 1, 9)))
    band = np.digitize(s, edges[1:-1])
    got = scorecard.score_bands(scored, "s", "y", 8).orderBy("band").collect()
    assert [(r.band, r.n, r.n_fraud, r.score_min) for r in got] == [(b, (band == b).sum(), y[band == b].sum(), s[band == b].min()) for b in np.unique(band)]
    assert [r.cum_pct_fraud for r in got] == pytest.approx([y[band <= r.band].sum() / y.sum() for r in got])
    assert [(r.band, r.n) for r in scorecard.score_bands(scored.withColumn("s", F.lit(2.0)), "s", "y").collect()] == [(0, 701)]


def test_costs(scored, drawn):
    y, s, a = drawn
    curve = {(r.cost_fp, r.threshold): r for r in costs.cost_curve(scored.where("s is not null"), "y", "s", "cents", [150.0, 4000.0], 25).collect()}
    cuts = np.unique(np.quantile(s, np.linspace(0, 1, 25)))
    assert len(curve) == 2 * len(cuts)
    for (cost, t), r in curve.items():
        flagged = s >= cuts[np.argmin(abs(cuts - t))]
        assert (r.n_flagged, r.fn_cost) == (flagged.sum(), a[(y == 1) & ~flagged].sum()) and r.total_cost == pytest.approx(r.fn_cost + cost * (flagged & (y == 0)).sum())
    for r in costs.sensitivity(costs.cost_curve(scored.where("s is not null"), "y", "s", "cents", [150.0, 4000.0], 25), 20).collect():
        assert r.total_cost == min(c.total_cost for (cost, _), c in curve.items() if cost == r.cost_fp)
        assert r.savings_per_month == pytest.approx((a[y == 1].sum() - r.total_cost) * 1.5)


def test_stability(spark):
    rng = np.random.default_rng(7)
    base, other = rng.exponential(size=900), rng.exponential(1.3, size=500)
    make = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    e, a = (np.maximum(np.bincount(np.digitize(x, edges[1:-1]), minlength=10) / len(x), 1e-6) for x in (base, other))
    assert stability.population_stability_index(make(base), make(other), "v").first()[0] == pytest.approx(((a - e) * np.log(a / e)).sum())
    assert stability.population_stability_index(make(base), make(base), "v").first()[0] == 0 == stability.population_stability_index(make([3.0] * 4), make([5.0]), "v").first()[0]
    both = make(base).withColumn("w", F.lit(None).cast("double")).withColumn("p", F.lit("a")).union(make(other).withColumn("w", F.lit(1.0)).withColumn("p", F.lit("b")))
    got = stability.characteristic_stability(both, "p", "a", "b", ["v", "w"]).collect()
    assert [(r.feature, r.csi) for r in got] == [("v", pytest.approx(((a - e) * np.log(a / e)).sum()))] and got[0].mean_actual == pytest.approx(other.mean())


def test_calibration(spark, scored, drawn):
    y, s, _ = drawn
    r = calibration.calibration_summary(scored, "y", "s", 10).first()
    box = np.digitize(s, np.linspace(0, 1, 11)[1:-1])
    assert r.ece == pytest.approx(sum(abs(s[box == b].mean() - y[box == b].mean()) * (box == b).mean() for b in np.unique(box)))
    assert r.brier == pytest.approx(((s - y) ** 2).mean()) and r.bias == pytest.approx((s - y).mean())
    model = calibration.fit_isotonic(scored, "y", "s")
    value = np.unique(s)
    rate, weight = np.array([y[s == v].mean() for v in value]), np.array([(s == v).sum() for v in value])
    mean = lambda i, j: (rate[i : j + 1] * weight[i : j + 1]).sum() / weight[i : j + 1].sum()
    fitted = [max(min(mean(i, j) for j in range(k, len(value))) for i in range(k + 1)) for k in range(len(value))]
    probe = [0.0, *map(float, value[:: max(1, len(value) // 9)]), float(value[3] + value[4]) / 2, 1.0]
    got = calibration.apply_isotonic(model, spark.createDataFrame([(x,) for x in probe], "s double"), "s", "q").collect()
    assert [x.q for x in got] == pytest.approx(list(np.interp(probe, value, fitted)))
