"""Skewed keys, feature table, rolling totals and load quality on small cases with hand-made or brute-force results."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators import quality as Q
from sedimenta.operators.feature_table import entity_feature_table, entity_type_stats
from sedimenta.operators.rolling import daily_totals, rolling_totals, trailing
from sedimenta.operators.skew import heavy_keys, skew_aggregate, skew_join
from sedimenta.operators.versions import latest_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest_rows_takes_the_newest_and_breaks_ties_the_same_way(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "x"), (None, 9, "n"), (2, 1, None)], "k long, v long, t string")
    assert rows(latest_rows(df, "k", "v", ["t"])) == [(1, "c"), (2, None)]
    assert rows(latest_rows(df.limit(0), "k", "v", ["t"])) == []


def test_heavy_keys_are_few_and_include_null(spark):
    df = spark.createDataFrame([("hot",)] * 600 + [(None,)] * 300 + [(f"k{i}",) for i in range(300)], "k string")
    found = {r[0] for r in heavy_keys(df, ["k"], share=0.1, fraction=0.9).collect()}
    assert found == {"hot", None}
    assert heavy_keys(df.limit(0), ["k"]).collect() == []


def test_skew_aggregate_equals_a_plain_one(spark):
    random.seed(3)
    data = [(i, random.choice(["hot"] * 5 + [None, "a", "b", f"u{i}"]), i % 3, i) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, k string, w int, n long")
    heavy = heavy_keys(df, ["k"], share=0.2, fraction=0.5)
    got = skew_aggregate(df.drop("n").withColumn("amount", F.col("id")), ["k"], ["w"], {"n": F.count("*"), "s": F.sum("amount")}, {"n": F.sum("n"), "s": F.sum("s")}, heavy, F.col("id"))
    want = defaultdict(lambda: [0, 0])
    for i, k, w, n in data:
        want[k, w][0] += 1
        want[k, w][1] += n
    assert rows(got.select("k", "w", "n", "s")) == sorted([(*k, *v) for k, v in want.items()], key=repr)


def test_skew_join_equals_a_plain_one(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(600)], "id long, k string")
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, v int")
    heavy = spark.createDataFrame([("hot",)], "k string")
    for how in ("inner", "left"):
        assert rows(skew_join(facts, side, ["k"], heavy, how)) == rows(facts.join(side, "k", how))
        assert rows(skew_join(facts, side, ["k"], heavy.limit(0), how)) == rows(facts.join(side, "k", how))


def test_domains_days_and_cents(spark):
    df = spark.createDataFrame([(" MX.Example. ",), ("a.b..",), ("",), (None,), ("x.y\t",)], "d string")
    assert [r[0] for r in df.select(D.unified_domain(F.col("d"))).collect()] == ["mx.example", "a.b.", "", None, "x.y"]
    df = spark.createDataFrame([(86400, 0.125), (86399, float("nan")), (172799, None), (0, -2.5), (0, float("inf"))], "t long, a double")
    assert [tuple(r) for r in df.select(D.day_of(F.col("t")), D.cents(F.col("a"))).collect()] == [(0, 13), (-1, 0), (0, 0), (-1, -250), (-1, 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 30, 50])
def test_trailing_equals_brute_force(width):
    x = np.random.default_rng(1).integers(-5, 9, (6, 41))
    want = np.array([[r[max(0, i - width + 1) : i + 1].sum() for i in range(41)] for r in x])
    assert (trailing(x, width) == want).all()


def test_rolling_totals_with_gaps_nulls_and_late_days(spark):
    data = [(1, 3, 100), (1, 3, 50), (1, 9, 7), (2, 20, 5), (None, 4, 9), (3, None, 9), (4, 25, 1), (2, 12, None), (5, -2, 10)]
    daily = daily_totals(spark.createDataFrame(data, "c long, d long, a long"), "c", "d", "a")
    got = {(r.c, r.d): (r.t2, r.t7) for r in rolling_totals(daily, "c", "d", "a", (2, 7), 20).collect()}
    per = defaultdict(Counter)
    for c, d, a in data:
        if c is not None and d is not None and d <= 20:
            per[c][d] += a or 0
    want = {(c, d): tuple(sum(v for k, v in days.items() if d - w < k <= d) for w in (2, 7)) for c, days in per.items() for d in range(min(days), 21)}
    assert got == want
    assert rolling_totals(daily.limit(0), "c", "d", "a", (7,), 20).collect() == []
    kept = rolling_totals(daily, "c", "d", "a", (2, 7), 20, lambda day, t: (t[7] >= 100) & (day >= 4)).collect()
    assert sorted((r.c, r.d) for r in kept) == [(1, d) for d in range(4, 10)]


def test_rolling_totals_over_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(c, d, c + d) for c in range(20) for d in range(0, 15, 1 + c % 4)]
        got = rolling_totals(spark.createDataFrame(data, "c long, d long, a long"), "c", "d", "a", (3,), 15)
        want = sorted((c, d, sum(c + k for k in range(0, 15, 1 + c % 4) if d - 3 < k <= d)) for c in range(20) for d in range(16))
        assert rows(got) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_feature_table_expands_every_type(spark):
    events = spark.createDataFrame([(i, 1, 10, 5, 100) for i in range(50)] + [(60, 1, 20, 9, None), (61, 2, 10, 3, 7), (62, None, 10, 1, 1), (63, 2, None, 1, 1), (64, 3, 99, 1, 1)], "id long, e long, k long, d long, a long")
    stats = entity_type_stats(events, "e", "k", "id", "d", "a", share=0.01)
    assert rows(stats) == sorted([(1, 10, 50, 5, 5000), (1, 20, 1, 9, 0), (2, 10, 1, 3, 7), (3, 99, 1, 1, 1)], key=repr)
    wide = entity_feature_table(stats, "e", "k", [10, 20, 30], 11)
    assert rows(wide) == sorted([(1, [50, 1, 0], [6, 2, None], [5000, 0, 0]), (2, [1, 0, 0], [8, None, None], [7, 0, 0])], key=repr)
    assert entity_type_stats(events.limit(0), "e", "k", "id", "d", "a").collect() == []


@pytest.fixture
def loads(spark):
    data = [(1, 1.0, "ok-1"), (1, 2.0, "ok-2"), (1, float("nan"), None), (1, None, "b?d"), *[(2, 7.0, "ok-1")] * 10, (3, 900.0, ""), (None, 1.0, "ok-1")]
    return spark.createDataFrame([(*r, i, "x" * 50_000) for i, r in enumerate(data)], "l long, x double, t string, n int, txt string")


def test_profile_counts_exactly(spark, loads):
    usual = [Q.Baseline("x", null_share=0.0, low=0.0, high=100.0, p10=1.0, p50=2.0, p90=3.0), Q.Baseline("t", null_share=0.1, pattern="ok-[0-9]|ok-[0-9]x")]
    counts = Q.value_counts(loads, "l", ["x", "t", "absent"])
    got = {(r.l, r.column_name): r for r in Q.profile(counts, "l", usual).collect()}
    one = got[1, "x"]
    assert (one.n_rows, one.n_missing, one.n_values, one.n_distinct, one.min_value, one.max_value, one.n_out_of_range, one.n_le_p10, one.n_le_p50, one.n_off_pattern) == (4, 2, 2, 2, 1.0, 2.0, 0, 1, 2, None)
    text = got[1, "t"]
    assert (text.n_missing, text.n_distinct, text.min_text, text.max_text, text.n_off_pattern, text.n_out_of_range) == (1, 3, "b?d", "ok-2", 1, None)
    found = {tuple(r) for r in Q.findings(Q.profile(counts, "l", usual), "l", usual, 0.1503, 0.2003).collect()}
    assert found == {
        (1, "x", "null_share"), (1, "x", "drift"), (1, "t", "pattern"), (2, "x", "constant"), (2, "x", "drift"), (2, "t", "constant"),
        (3, "x", "out_of_range"), (3, "x", "drift"), (3, "t", "pattern"), (None, "x", "drift"),
    }
    assert Q.value_counts(loads.limit(0), "l", ["x"]).collect() == []


def test_profile_takes_long_texts_and_clashing_names(spark, loads):
    counts = Q.value_counts(loads, "l", ["txt", "n"])
    assert {r.column_name: r.n_distinct for r in Q.profile(counts, "l", []).where("l = 2").collect()} == {"txt": 1, "n": 10}


def test_load_drift_is_zero_between_equal_loads(spark):
    df = spark.createDataFrame([(load, float(v), f"t{v % 3}") for load in (1, 2) for v in range(30)] + [(3, 500.0, "new")] * 5, "l long, x double, t string")
    drift = {(r.l, r.column_name): r for r in Q.load_drift(Q.value_counts(df, "l", ["x", "t"]), "l").collect()}
    assert set(drift) == {(2, "x"), (2, "t"), (3, "x"), (3, "t")}
    assert abs(drift[2, "x"].psi_before) < 1e-12 and abs(drift[2, "t"].chi2_before) < 1e-12
    assert drift[3, "x"].psi_before > 5 and drift[3, "t"].psi_before > 5


def test_baselines_read_nan_as_none(spark):
    df = spark.createDataFrame([("c", 0.1, float("nan"), None, 1.0, None, 2.0, None)], "column_name string, null_share double, min_value double, max_value double, p10 double, p50 double, p90 double, pattern string")
    assert Q.read_baselines(df) == [Q.Baseline("c", 0.1, None, None, 1.0, None, 2.0, None)]
