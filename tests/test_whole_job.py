"""Queries over a table with groups of 25 rows and one of 5001, against brute force in Python."""

import math
import os
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

N, CAP = 5001, 5000
NODES = ["card1", "addr1", "DeviceInfo", "P_emaildomain", "R_emaildomain", "id_30", "id_31"]


@pytest.fixture(scope="module")
def data():
    """A domain that all rows have, which the cap leaves out; cards of 25 rows, devices of 30 that link cards, a few addresses."""
    rows = range(N)
    return pd.DataFrame({
        "TransactionID": rows, "isFraud": [int(i % 7 == 0) for i in rows], "TransactionDT": [86400 + i % 181 * 86400 for i in rows], "TransactionAmt": [i % 90 + 0.5 for i in rows],
        "card1": [i // 25 for i in rows], "addr1": [float(i % 40) if i < 400 else math.nan for i in rows], "D1": [float(i % 3) for i in rows],
        "DeviceInfo": [f"d{i // 30}" if i % 2 and i < 3000 else None for i in rows], "P_emaildomain": ["mail"] * N, "R_emaildomain": [None] * N, "id_30": [None] * N, "id_31": [f"x{i}" if i % 5 else None for i in rows],
        **{c: [float((i * k) % 23) for i in rows] for c, k in (("C1", 3), ("C2", 5), ("C5", 7), ("C13", 11), ("C14", 13))},
        "load_id": [0] * N, "loaded_at": pd.Timestamp("2024-01-01"),
    }).astype({"R_emaildomain": "string", "id_30": "string"})


@pytest.fixture(scope="module")
def folder(data, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    data.to_parquet(path / "merged_train.parquet", index=False, coerce_timestamps="us")
    return str(path)


@pytest.fixture(scope="module")
def nodes_of(data):
    """Nodes of each transaction that the cap leaves."""
    sizes = {c: data[c].value_counts().to_dict() for c in NODES}
    out = []
    for r in data[NODES].itertuples(index=False):
        out.append([f"{c}={int(v) if c == 'addr1' else v}" for c, v in zip(NODES, r) if not pd.isna(v) and sizes[c][v] <= CAP])
    return out


@pytest.fixture(scope="module")
def components(nodes_of):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for tx, nodes in enumerate(nodes_of):
        for n in nodes:
            up[root(tx)] = root(n)
    size = pd.Series([root(x) for x in list(up)]).value_counts()
    return [int(size[root(tx)]) if nodes else 1 for tx, nodes in enumerate(nodes_of)]


def test_components_at_the_references_cap(spark, folder, components):
    got = {r.tx: r.graph_component_size for r in entry.queries()["q_g3_components"](spark, folder).collect()}
    assert [got[i] for i in range(N)] == components and min(components[:5000]) >= 25


def test_cores_at_the_references_cap(spark, folder, nodes_of):
    near = {}
    for nodes in nodes_of:
        for a, b in combinations(nodes, 2):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        low = [n for n, x in near.items() if len(x) <= k]
        for n in low:
            core[n] = k
            for m in near.pop(n):
                near.get(m, set()).discard(n)
        k += not low
    got = {r.tx: r.graph_max_kcore for r in entry.queries()["q_g5_cores"](spark, folder).collect()}
    assert [got[i] for i in range(N)] == [max((core.get(n, 0) for n in nodes), default=0) for nodes in nodes_of]


def test_communities_at_the_references_cap(spark, folder, nodes_of):
    got = {r.tx: r for r in entry.queries()["q_g4_communities"](spark, folder).collect()}
    assert len(got) == N and all(got[i].community is not None for i in range(N) if nodes_of[i])
    # a card is the first node of all its rows
    assert len({(i // 25, got[i].community) for i in range(N)}) == len({i // 25 for i in range(N)})


def test_structure_at_the_references_cap(spark, folder, nodes_of, components):
    got = {r.tx: r for r in entry.queries()["q_l6_structure"](spark, folder).collect()}
    assert [got[i].graph_n_attributes for i in range(N)] == [len(n) for n in nodes_of]
    assert [got[i].graph_component_size for i in range(N)] == components


@pytest.mark.parametrize("name", ["q_p11_cap_5000", "q_j7_projection", "q_l4_two_hop", "q_l5_features", "q_d3_evidence", "q_g3_components", "q_g5_cores"])
def test_sql_at_the_references_cap(spark, folder, name):
    pytest.importorskip("duckdb")
    assert differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) == []


def test_label_features_with_communities_keep_groups_of_25(spark, folder):
    got = entry.queries()["q_l5_louvain"](spark, folder)
    # the first 25 rows share a card; up to day 118 they are training rows
    assert got.where("tx = 0").first().graph_nb_labeled_count >= 24


def test_drift_of_every_column_against_the_load_before(spark, data, tmp_path):
    from sedimenta.operators.quality import load_drift, value_counts

    loads = data.assign(load_id=[i % 4 for i in range(N)])
    loads.loc[loads.load_id == 1, "D1"] = math.nan
    loads.loc[loads.load_id.isin([2, 3]), "DeviceInfo"] = None
    loads.loc[loads.load_id == 3, "card1"] += 100_000
    loads.to_parquet(tmp_path / "merged_train.parquet", index=False, coerce_timestamps="us")
    nan = math.nan
    usual = [("TransactionAmt", 0.0, 0.0, 100.0, 9.0, 45.0, 81.0, None), ("D1", 0.0, 0.0, 3.0, 0.0, 1.0, 2.0, None), ("DeviceInfo", 0.5, nan, nan, nan, nan, nan, "d[0-9]+")]
    pd.DataFrame(usual, columns=["column_name", "null_share", "min_value", "max_value", "p10", "p50", "p90", "pattern"]).to_parquet(tmp_path / "column_baseline.parquet", index=False)
    got = {(r.load_id, r.column_name): r for r in entry.queries()["p6_drift_all"](spark, str(tmp_path)).collect()}
    assert {c for _, c in got} == set(data.columns) - {"load_id", "loaded_at"} and all(r.load_before == r.load_id - 1 for r in got.values() if r.load_id)
    assert got[3, "card1"].psi_before > 10 > 0.1 > got[2, "card1"].psi_before
    assert got[1, "D1"].n_values == 0 < got[1, "D1"].psi_before and got[2, "D1"].n_values_before == 0 < got[2, "D1"].psi_before and got[3, "D1"].psi_before < 0.1
    assert (got[3, "DeviceInfo"].n_bins, got[3, "DeviceInfo"].psi_before, got[3, "DeviceInfo"].chi2_before) == (0, 0.0, 0.0)
    # as the SQL of p6_drift has it, a load without values is passed over
    old = {(r.load_id, r.prev) for r in load_drift(value_counts(spark.read.parquet(str(tmp_path / "merged_train.parquet")), "load_id", ["D1"]), "load_id").collect()}
    assert old == {(2, 0), (3, 2)}


def test_pagerank_converges(spark, folder, nodes_of):
    tx = np.array([i for i, nodes in enumerate(nodes_of) for _ in nodes])
    node, _ = pd.factorize(np.array([n for nodes in nodes_of for n in nodes], dtype=object))
    own, degree = np.bincount(tx, minlength=N), np.bincount(node)
    ranks, steps = [np.full(N, 1 / N)], []
    while len(steps) < 50 and (not steps or steps[-1] >= 1e-8):
        to_node = np.bincount(node, weights=ranks[-1][tx] / own[tx]) / degree
        new = 0.15 / N + 0.85 * np.bincount(tx, weights=to_node[node], minlength=N)
        ranks.append(new + (1 - new.sum()) / N)
        steps.append(np.abs(ranks[-1] - ranks[-2]).sum())
    got = {r.tx: r.rank_millionths for r in entry.queries()["q_g2_pagerank"](spark, folder).collect()}
    assert len(steps) > 3 and np.allclose([got[i] for i in range(N)], ranks[-1] * 1e6, rtol=0, atol=2e-4)
    assert np.abs(ranks[3] - ranks[-1]).max() * 1e6 > 1e-3  # what three rounds lack


def test_rank_correlations_of_all_rates_and_counters(spark, data, folder):
    from sedimenta.plans.graph_features import _label_features

    f = pd.DataFrame([r.asDict() for r in _label_features(spark, folder, True).collect()]).set_index("tx").sort_index().round(9)
    train = data.index[(data.TransactionDT - 86400) // 86400 <= 118]
    rates = [c for c in f.columns if "fraud_rate" in c]
    got = {(r.level3_feature, r.c_feature): r.spearman for r in entry.queries()["q_a22_spearman_louvain"](spark, folder).collect()}
    assert len(rates) == 4 and set(got) == {(t, c) for t in rates for c in ("C1", "C2", "C5", "C13", "C14")}
    for (t, c), r in got.items():
        if f[t][train].nunique() > 1:  # a constant has no correlation
            assert r == pytest.approx(f[t][train].rank().corr(data[c][train].rank()), abs=1e-5)
    assert sum(f[t][train].nunique() > 1 for t in rates) >= 3


def test_structure_has_every_part(spark, folder):
    q = entry.queries()
    got = q["q_l6_with_communities"](spark, folder).cache()
    assert got.count() == N == got.select("tx").distinct().count()
    ours = {r.tx: r for r in got.collect()}
    for name, columns in (("q_a9_degree", None), ("q_a10_cross", None), ("q_a14_activity", None), ("q_g5_cores", ["graph_max_kcore"]), ("q_g4_communities", ["graph_community_size"]), ("q_a12_entropy", None)):
        part = q[name](spark, folder)
        for r in part.collect():
            mine = ours[r[part.columns[0]]]
            for c in columns or part.columns[1:]:
                assert mine[c] == r[c] or mine[c] == pytest.approx(r[c], abs=1e-6), (name, c)
    assert sum(r.graph_pagerank for r in ours.values()) == pytest.approx(1, abs=1e-5)


def test_every_stored_column_is_looked_at(spark, data, folder):
    q, columns = entry.queries(), [c for c in data if c not in ("TransactionID", "TransactionDT", "load_id", "loaded_at")]
    derived = {"start_day": "D1", "amt_log": "TransactionAmt", "amt_decimal": "TransactionAmt", "domain": "P_emaildomain"}
    groups = {}
    for c in [*columns, *derived]:
        groups.setdefault(tuple(data[derived.get(c, c)].isna()), []).append(c)
    got = {(r.columns, r.n_missing) for r in q["q_a5_missing"](spark, folder).collect()}
    assert got == {(",".join(sorted(c)), sum(k)) for k, c in groups.items() if len(c) > 1}
    days = (data.TransactionDT - 86400) // 86400
    drift = {r.column_name: (r.train, r.test) for r in q["q_d1_missing_drift"](spark, folder).collect()}
    assert set(drift) == set(columns)
    assert all(drift[c] == pytest.approx((data[c][days <= 118].isna().mean(), data[c][days > 150].isna().mean()), abs=1e-6) for c in columns)
    assert {r.feature for r in q["q_e11_csi"](spark, folder).collect()} >= {"TransactionAmt", "card1", "D1", "C1", "C2", "C5", "C13", "C14"}
