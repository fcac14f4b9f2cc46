"""Queries of models on the smallest tables: what must hold whatever the trees are."""

import json
import os

import pytest

import __spark_entry__ as entry
from sedimenta.plans import models

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_final_model(spark):
    (r,) = run(spark, "q_m1_boosted")
    assert 0.4 < r.auc <= 1 and 1 <= r.trees <= models.CONFIG.rounds and r.n_features == 2 + 2 + 9 + 11 + 9 + 4 + 6 + 5 + 5


def test_heavier_positives_raise_the_probabilities(spark):
    r = {x.positive_weight: x for x in run(spark, "q_m3_weights")}
    assert set(r) == {1.0, 5.0, 27.6} and r[1.0].mean_predicted < r[5.0].mean_predicted < r[27.6].mean_predicted and len({x.actual_rate for x in r.values()}) == 1


def test_importance_of_every_feature(spark):
    rows = run(spark, "q_m4_contributions")
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1)) and min(r.mean_abs for r in rows) >= 0 < max(r.mean_abs for r in rows)
    assert {r.feature_group for r in rows} == {"C", "D", "V", "other"}


def test_weight_review_judges_both_variants(spark):
    rows = {(r.positive_weight, r.calibration): r for r in run(spark, "q_e15_weight_review")}
    assert set(rows) == {(w, c) for w in (1.0, 5.0) for c in ("raw", "isotonic")} and all(0 <= r.ece <= 1 and 0 <= r.brier <= 1 for r in rows.values())
    assert rows[5.0, "raw"].mean_predicted > rows[1.0, "raw"].mean_predicted


def test_ablation_logs_four_models_once(spark):
    rows = {r.name: r for r in run(spark, "q_m6_ablation")}
    assert set(rows) == set(models.BLOCKS) and len({r.notes for r in rows.values()}) == 1
    size = {n: r.n_features for n, r in rows.items()}
    graph = 7 + 4 + 3 + 1 + 1 + 1 + 1 + 1 + 7 + 6 - (rows["M4_graph_full"].notes == "two-hop rate dropped")
    assert size["M3_baseline_full"] - size["M1_baseline_noC"] == size["M4_graph_full"] - size["M2_graph_noC"] == 5
    assert size["M2_graph_noC"] - size["M1_baseline_noC"] == graph
    assert all(r.test_auc is not None and r.val_auc is not None and r.param_hash == rows["M1_baseline_noC"].param_hash for r in rows.values())


def test_evaluation_of_the_model(spark):
    rows = run(spark, "q_r12_of_model")
    assert {r.section for r in rows} == {"scorecard", "bands", "ranking", "costs", "stability", "calibration", "csi"}
    by = {(r.section, r.name, r.metric): r.value for r in rows}
    assert sum(v for (s, _, m), v in by.items() if s == "bands" and m == "n") == by["scorecard", "0", "n"] + by["scorecard", "1", "n"]
    assert by["calibration", "raw", "actual_rate"] == by["calibration", "isotonic", "actual_rate"]


def test_documents_of_the_model(spark):
    docs = {r.name: json.loads(r.document) for r in run(spark, "q_r2_of_model")}
    assert set(docs) == {"gain_curve", "score_bands", "score_sample", "cost_sensitivity"}
    sample, curve = docs["score_sample"], docs["gain_curve"]
    assert len({len(sample[k]) for k in ("score", "prob", "label", "amount")}) == 1 and sum(sample["label"]) == sample["sampling"]["n_fraud_sampled"]
    assert curve["review_rate"] == [round((i + 1) / 100, 4) for i in range(100)] and curve["recall"] == sorted(curve["recall"]) and curve["recall"][-1] == 1
    assert [s["cost_fp"] for s in docs["cost_sensitivity"]["scenarios"]] == [2, 5, 10, 25]
    assert sum(b["n"] for b in docs["score_bands"]) == sample["sampling"]["n_total_test"]
