"""Boosted trees: known trees, patience, missing values, attributions against all coalitions, and a saved model."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import boosting as X

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1200, 4)), 2)
    y = (rng.random(1200) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * (x[:, 1] > 0.5) * (x[:, 2] > 0))))).astype(int)
    rows = [(i, *(None if i % 9 == j else float(v) for j, v in enumerate(x[i])), int(y[i]), i % 4 == 3) for i in range(1200)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y int, v boolean").cache()


@pytest.fixture(scope="module")
def model(data):
    return X.train_boosted(data, NAMES, "y", "v", config=X.BoostConfig(rounds=12, patience=4, depth=3))


def test_patience():
    assert X.best_round([5, 4, 3, 3.5, 3.2, 3.1, 1], 3) == 3 and X.best_round([5, 4, 3, 3.5, 3.2, 1], 3) == 6 and X.best_round([2], 1) == 1


def test_one_split_tree(spark):
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 6), False) for i in range(400)], "k long, a double, y int, v boolean")
    tree = X.train_boosted(df, ["a"], "y", "v", config=X.BoostConfig(rounds=1, depth=1, columns=1.0, rows=1.0))
    low, high = sorted(X.leaves(tree), key=lambda leaf: leaf.value)
    assert (low.value, high.value, low.upto[0], high.above[0]) == (-1.0, 1.0, 6.5, 6.5) and low.share == (0.7,)
    p = {r.a: r.p for r in X.predict(tree, df, ["a"]).select("a", "p").distinct().collect()}
    assert p[6.0] == pytest.approx(1 / (1 + math.exp(2))) and p[7.0] == pytest.approx(1 / (1 + math.exp(-2)))


def test_missing_values_are_below_all_others(spark):
    df = spark.createDataFrame([(i, None if i % 2 else -5e5 - i, i % 2, False) for i in range(300)] + [(301, math.inf, 1, False)], "k long, a double, y int, v boolean")
    tree = X.train_boosted(df, ["a"], "y", "v", config=X.BoostConfig(rounds=1, depth=1, columns=1.0, rows=1.0))
    p = [r.p for r in X.predict(tree, spark.createDataFrame([(None,), (math.nan,), (-1e30,), (0.0,)], "a double"), ["a"]).collect()]
    assert p[0] == p[1] > 0.8 > 0.2 > p[2] == p[3]


def test_trees_after_the_best_round_are_dropped(data, model):
    whole = X.train_boosted(data.withColumn("v", F.lit(False)), NAMES, "y", "v", config=X.BoostConfig(rounds=12, depth=3))
    assert whole.getNumTrees == 12 >= model.getNumTrees >= 1
    two = X.first_trees(whole, 2)
    margins = [(leaf.value, leaf) for leaf in X.leaves(two)]
    x = np.array([r.x.toArray() for r in X.assemble(data.orderBy("k").limit(50), NAMES).collect()])
    byhand = sum(value * np.all([(x[:, f] > a) & (x[:, f] <= u) for f, a, u in zip(leaf.features, leaf.above, leaf.upto)], axis=0) for value, leaf in margins)
    p = [r.p for r in X.predict(two, data.orderBy("k").limit(50), NAMES).orderBy("k").collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-2 * byhand)))


def test_positives_may_weigh_more(data):
    means = [X.predict(X.train_boosted(data, NAMES, "y", "v", w, X.BoostConfig(rounds=5, depth=2)), data, NAMES).agg(F.avg("p")).first()[0] for w in (1.0, 8.0)]
    assert means[1] > means[0] + 0.1


def test_attributions_add_up_and_equal_all_coalitions(data, model):
    some = data.orderBy("k").limit(40)
    got = X.contributions(model, some, "k", NAMES).orderBy("k").collect()
    p = [r.p for r in X.predict(model, some, NAMES).orderBy("k").collect()]
    assert np.allclose([1 / (1 + math.exp(-2 * (r["__base"] + sum(r[f] for f in NAMES)))) for r in got], p)
    found = X.leaves(model)
    x = np.array([r.x.toArray() for r in X.assemble(some, NAMES).orderBy("k").collect()])

    def value(row, known):
        return sum(leaf.value * math.prod(float(a < row[f] <= u) if f in known else s for f, a, u, s in zip(leaf.features, leaf.above, leaf.upto, leaf.share)) for leaf in found)

    for i in (0, 7, 31):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value(x[i], {*s, f}) - value(x[i], set(s))) for k in range(4) for s in itertools.combinations(rest, k))
            assert got[i][NAMES[f]] == pytest.approx(want, abs=1e-9)
    assert X.contributions(model, some.limit(0), "k", NAMES).collect() == []


def test_saved_model_predicts_the_same(data, model, tmp_path):
    X.save_model(model, str(tmp_path / "m"))
    again = X.load_model(str(tmp_path / "m"))
    assert again.getNumTrees == model.getNumTrees
    assert [r.p for r in X.predict(again, data.orderBy("k"), NAMES).collect()] == [r.p for r in X.predict(model, data.orderBy("k"), NAMES).collect()]
