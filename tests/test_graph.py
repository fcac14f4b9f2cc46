"""Graph operators against the dense matrices of a small random graph with a hub and missing values in every column."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.functions.domain import smooth_rate
from sedimenta.operators import graph, label_spread, skew
from sedimenta.operators import graph_iterative as I

N, COLUMNS = 42, ["shop", "phone", "town"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    out = []
    for i in range(N):
        shop = None if i % 11 == 3 else "hub" if i < 18 else f"s{rng.integers(5)}"
        phone = None if rng.random() < 0.4 else f"n{rng.integers(9)}"
        town = None if i % 3 else float(rng.integers(4)) / 2
        out.append((100 + i, shop, phone, town, int(rng.integers(1, 900)), int(rng.random() < 0.4), i % 5 < 3))
    return [*out, (900, None, None, None, 7, 1, True)]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "k long, shop string, phone string, town double, cents long, bad int, seen boolean").cache()


@pytest.fixture(scope="module")
def links(table):
    return graph.edges(table, "k", COLUMNS).cache()


@pytest.fixture(scope="module")
def keys(table):
    return table.select(F.col("k").alias("tx"))


@pytest.fixture(scope="module")
def dense(data):
    nodes = sorted({(c, r[j + 1]) for r in data for j, c in enumerate(COLUMNS) if r[j + 1] is not None}, key=repr)
    return np.array([[float(r[1 + COLUMNS.index(c)] == v) for c, v in nodes] for r in data]), nodes


def by_key(df, data, column):
    got = {r[0]: r[column] for r in df.collect()}
    assert len(got) == len(data)
    return np.array([got[r[0]] for r in data], dtype=float)


def test_edges_and_degrees(links, table, data, dense):
    a, nodes = dense
    assert links.count() == a.sum() and graph.node_degrees(links).count() == len(nodes)
    assert {(r.node_col, r.node_val): r.degree for r in graph.node_degrees(links).collect()}[("shop", "hub")] == a[:, nodes.index(("shop", "hub"))].sum()
    got = graph.degree_features(table, "k", COLUMNS)
    for j, c in enumerate(COLUMNS):
        want = [sum(o[j + 1] == r[j + 1] for o in data) if r[j + 1] is not None else 0 for r in data]
        assert by_key(got, data, f"graph_deg_{c}").tolist() == want
    assert graph.of_column(links, "town").select("node_col").distinct().count() == 1
    assert "0.5" in {r.node_val for r in graph.of_column(links, "town").collect()} and graph.edges(table.limit(0), "k", COLUMNS).collect() == []


def test_cross_cardinality(table, data):
    got = {r[0]: r for r in graph.cross_cardinality(table, "k", [("shop", "phone"), ("phone", "town")]).collect()}
    for j, b in ((1, 2), (2, 3)):
        name = f"graph_n_unique_{COLUMNS[b - 1]}_per_{COLUMNS[j - 1]}"
        for r in data:
            assert got[r[0]][name] == (len({o[b] for o in data if o[j] == r[j]} - {None}) if r[j] is not None else None)


def test_lookups_shuffle_like_they_broadcast(spark, table):
    counts = graph.unpivot(table, COLUMNS).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    names = {"a": "shop", "b": "phone"}
    side = counts.where("column_name <> 'town'").replace({"shop": "a", "phone": "b"}, subset=["column_name"])
    few, many = (skew.lookup_columns(table, "k", names, side, ["n", "top"], most) for most in (10_000, 0))
    assert few.columns == many.columns and rows(few) == rows(many)
    # half of all rows without a key, a third under one
    facts = spark.createDataFrame([(i, None if i % 2 else "x" if i % 3 else f"y{i}") for i in range(3000)], "i long, g string")
    totals = facts.where("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    assert rows(skew.lookup(facts, totals, ["g"])) == rows(skew.lookup(facts, totals, ["g"], most_rows=0))
    assert skew.lookup(facts, totals.limit(0), ["g"]).where("n is not null").count() == 0
    heavy = {r.g for r in skew.heavy_keys(facts, ["g"], share=0.1, fraction=0.5).collect()}
    assert heavy == {None, "x"} and skew.heavy_keys(facts.limit(0), ["g"]).collect() == []


def test_neighbour_sums_and_counts(links, keys, table, data, dense):
    a, _ = dense
    cents = np.array([r[4] for r in data])
    sums = {r.tx: r.cents for r in graph.neighbour_sums(links, table.select(F.col("k").alias("tx"), "cents"), ["cents"]).collect()}
    assert sums == {r[0]: w for r, w, own in zip(data, a @ (a.T @ cents), a.sum(1)) if own} and 900 not in sums
    capped = graph.cap_degrees(links, 6)
    kept = a * (a.sum(0) <= 6)
    assert capped.count() == kept.sum() and kept.sum() < a.sum()
    counts = graph.neighbour_counts(capped, keys)
    assert by_key(counts, data, "graph_two_hop_count").tolist() == (kept @ kept.sum(0)).tolist()
    assert by_key(counts, data, "graph_n_attributes").tolist() == kept.sum(1).tolist()


def test_entropy_largest_and_projection(links, keys, data, dense):
    a, nodes = dense
    size = a.sum(0)
    part = np.divide(a * size, (a @ size)[:, None], out=np.zeros_like(a), where=(a @ size)[:, None] > 0)
    want = [-sum(p * math.log(p) for p in row if p) for row in part]
    assert np.allclose(by_key(graph.attribute_entropy(links, keys), data, "graph_attr_entropy"), want)
    assert by_key(graph.largest_of_attributes(links, keys, graph.node_degrees(links), ["degree"]), data, "degree").tolist() == (a * size).max(1).tolist()
    name = [f"{c}={int(v) if isinstance(v, float) and v == int(v) else v}" for c, v in nodes]
    both = a.T @ a
    want = {tuple(sorted((name[i], name[j]))): both[i, j] for i in range(len(nodes)) for j in range(i) if both[i, j]}
    assert {(r.a, r.b): r.weight for r in graph.project_attributes(links).collect()} == want


def test_pagerank_equals_the_dense_walk(links, keys, data, dense):
    a, _ = dense
    n, own, size = len(data), a.sum(1), a.sum(0)
    r = np.full(n, 1 / n)
    for _ in range(3):
        new = 0.15 / n + 0.85 * (a / size) @ (a.T @ np.divide(r, own, out=np.zeros(n), where=own > 0))
        r = new + (1 - new.sum()) / n
    assert np.allclose(by_key(I.pagerank(links, keys, rounds=3, tolerance=0.0), data, "rank"), r)
    assert by_key(I.pagerank(links, keys), data, "rank").sum() == pytest.approx(1)
    assert I.pagerank(links, keys.limit(0)).collect() == []


def test_components(spark, links, keys, data, dense):
    a, _ = dense
    n = len(data)
    reach = np.block([[np.eye(n), a], [a.T, np.eye(a.shape[1])]])
    for _ in range(6):
        reach = np.minimum(reach @ reach, 1)
    assert by_key(I.component_sizes(links, keys), data, "graph_component_size").tolist() == reach[:n].sum(1).tolist()
    path = spark.createDataFrame([(i + 1, i) for i in range(3, 60)] + [(7, 7), (90, 90), (80, 81), (81, 82), (82, 80)], "a long, b long")
    roots = {r.node: r.root for r in I.connected_nodes(path).collect()}
    assert set(roots.values()) == {3, 80, 90} and sum(v == 3 for v in roots.values()) == 58


def peeled(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
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
    return core


@pytest.mark.parametrize("seed, nodes, pairs", [(1, 9, 30), (2, 40, 90), (3, 25, 200)])
def test_cores_equal_peeling(spark, seed, nodes, pairs):
    drawn = [tuple(map(int, p)) for p in np.random.default_rng(seed).integers(0, nodes, (pairs, 2))]
    chain = [(1000 + i, 1001 + i) for i in range(12)]
    df = spark.createDataFrame(drawn + chain, "a long, b long")
    assert {r.node: r.core for r in I.core_numbers(df).collect()} == peeled(drawn + chain)
    assert I.core_numbers(df.limit(0)).collect() == []


def modularity(pairs, community):
    total = 2 * sum(w for *_, w in pairs)
    degree, inside = {}, 0
    for a, b, w in pairs:
        for x in (a, b):
            degree[community[x]] = degree.get(community[x], 0) + w
        inside += 2 * w * (community[a] == community[b])
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def one_by_one(pairs):
    """Communities by moves of one node at a time, levels included."""
    names = {x: x for p in pairs for x in p[:2]}
    edges = list(pairs)
    while True:
        near, loops = {}, {}
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})
                if a != b:
                    near[x][y] = near[x].get(y, 0) + w
            if a == b:
                loops[a] = loops.get(a, 0) + w
        degree = {x: sum(n.values()) + 2 * loops.get(x, 0) for x, n in near.items()}
        total, of, size, any_move, moved = sum(degree.values()), {x: x for x in near}, dict(degree), False, True
        while moved:
            moved = False
            for x in sorted(near):
                into = {of[x]: 0}
                for y, w in near[x].items():
                    into[of[y]] = into.get(of[y], 0) + w
                size[of[x]] -= degree[x]
                gain = {c: w - size[c] * degree[x] / total for c, w in into.items()}
                best = max(sorted(gain), key=lambda c: (gain[c], c == of[x]))
                if gain[best] > gain[of[x]] + 1e-12:
                    of[x], moved, any_move = best, True, True
                size[of[x]] += degree[x]
        names = {x: of[c] for x, c in names.items()}
        if not any_move:
            return names
        edges = [(of[a], of[b], w) for a, b, w in edges]


def test_communities_are_nearly_as_modular_as_one_by_one(spark):
    rng = np.random.default_rng(8)
    group = rng.integers(0, 7, 160)
    drawn = {}
    for a, b in rng.integers(0, 160, (9000, 2)):
        if a < b and rng.random() < (0.6 if group[a] == group[b] else 0.05):
            drawn[f"v{a:03}", f"v{b:03}"] = int(rng.integers(1, 4))
    pairs = [(a, b, w) for (a, b), w in drawn.items()]
    df = spark.createDataFrame(pairs, "a string, b string, weight long")
    found = {r.node: r.community for r in I.louvain(df).collect()}
    assert set(found) == {x for p in pairs for x in p[:2]} and all(c == min(x for x in found if found[x] == c) for c in set(found.values()))
    assert modularity(pairs, found) >= 0.98 * modularity(pairs, one_by_one(pairs))
    assert I.louvain(df.limit(0)).collect() == []


def test_communities_of_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 2) for g in "pqr" for i in range(5) for j in range(i)] + [("p0", "q0", 1), ("q1", "r1", 1), ("lone", "pair", 1)]
    found = {r.node: r.community for r in I.louvain(spark.createDataFrame(pairs, "a string, b string, weight long").repartition(3)).collect()}
    assert {x: c for x, c in found.items() if x[0] in "qr" and len(x) == 2} == {f"{g}{i}": f"{g}0" for g in "qr" for i in range(5)}
    assert found["lone"] == found["pair"] == "lone" and len(set(found.values())) == 4


def test_labels_of_neighbours(spark, table, links, data, dense):
    a, _ = dense
    m = np.array([float(r[6]) for r in data])
    y = np.array([float(r[5]) for r in data]) * m
    shared = a @ a.T
    np.fill_diagonal(shared, 0)
    values = label_spread.masked(table, "k", "bad", "seen")
    for stats, want in ((label_spread.neighbour_label_stats(links, values), shared), (label_spread.two_hop_label_stats(links, values), shared @ shared)):
        assert np.allclose(by_key(stats, data, "pos"), want @ y) and np.allclose(by_key(stats, data, "lab"), want @ m)
    # neither hidden labels nor a row's own change anything
    other = label_spread.masked(table.withColumn("bad", F.when(F.col("seen"), F.col("bad")).otherwise(7)), "k", "bad", "seen")
    assert rows(label_spread.neighbour_label_stats(links, values)) == rows(label_spread.neighbour_label_stats(links, other))
    own = label_spread.masked(table.withColumn("bad", F.when(F.col("k") == 104, 1 - F.col("bad")).otherwise(F.col("bad"))), "k", "bad", "seen")
    mine = [[r for r in rows(label_spread.neighbour_label_stats(links, v)) if r[0] == 104] for v in (values, own)]
    assert mine[0] == mine[1]
    with pytest.raises(TypeError):
        label_spread.masked(table.withColumn("seen", F.lit("yes")), "k", "bad", "seen")
    with pytest.raises(ValueError):
        label_spread.training_prior(values.where("m = 0"))
    plan = label_spread.neighbour_label_stats(links, values)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_labels_of_groups(spark, data, table):
    values = label_spread.masked(table, "k", "bad", "seen")
    groups = table.select(F.col("k").alias("tx"), "phone")
    for tx, pos, lab in rows(label_spread.group_label_stats(values, groups, "phone")):
        me = next(r for r in data if r[0] == tx)
        others = [r for r in data if r[2] == me[2] and r[2] is not None and r[0] != tx and r[6]]
        assert (pos, lab) == (sum(r[5] for r in others), len(others))


def test_smoothed_rates(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (900.0, 1000.0)], "p double, l double")
    got = [r[0] for r in df.select(smooth_rate(F.col("p"), F.col("l"), 0.1, 6.0)).collect()]
    assert got == pytest.approx([0.1, (3 + 0.6) / 10, (900 + 0.6) / 1006])
