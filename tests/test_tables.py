"""Scans, joins, splits, encoders, order and sinks on small tables of our own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import encoders as E
from sedimenta.operators import profiling, relational, reporting, temporal
from sedimenta.operators.ordering import dense_codes, running_totals
from sedimenta.operators.quantiles import exact_quantiles, quantiles
from sedimenta.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_left_join_flags_and_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(k, f"l{k}") for k in (11, 12, 13, 14)] + [(None, "l?")], "key long, both string")
    right = spark.createDataFrame([(12, 0.5, "r"), (14, None, "r"), (99, 7.0, "r")], "key long, weight double, both string")
    got = relational.join_one_to_one(left, right, "key", "there").select("key", "both", "weight", "there")
    assert rows(got) == sorted([(11, "l11", None, 0), (12, "l12", 0.5, 1), (13, "l13", None, 0), (14, "l14", None, 1), (None, "l?", None, 0)], key=repr)
    with pytest.raises(ValueError, match="12"):
        relational.join_one_to_one(left, right.union(right.limit(1)), "key", "there")
    assert relational.join_one_to_one(left.limit(0), right, "key", "there").collect() == []


def test_csv_missing_values_and_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id-7,ident-a-b,other-name\n1.5,NaN,u\nNaN,3,\n")
    read = tables.read_csv(spark, str(tmp_path / "x.csv"), "`id-7` double, `ident-a-b` double, `other-name` string")
    named = tables.normalise_identity_columns(read)
    assert named.columns == ["id_7", "ident_a_b", "other-name"] and rows(named) == rows(spark.createDataFrame([(1.5, None, "u"), (None, 3.0, None)], named.schema))


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", [1, 2]), (2, None, []), (3, "", None)], "k int, s string, l array<int>")
    for _ in (1, 2):  # a second write replaces the first
        tables.write_parquet(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)
    tables.write_json_documents(df, str(tmp_path / "j"))
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert text[0] == '{"k":1,"s":"a,\\"b\\"","l":[1,2]}' and rows(spark.read.schema(df.schema).json(str(tmp_path / "j"))) == rows(df)


def test_narrow_types_hold_every_value(spark):
    df = spark.createDataFrame([(-128, 9, 3e38, 1.5, None), (127, 9, -1.0, math.nan, None), (None, None, math.inf, None, None)], "b long, kept long, d double, e double, nothing double")
    wide = spark.createDataFrame([(40_000, -2**40, 1e39)], "i long, l long, d double")
    made = relational.narrow(df, ["kept"])
    assert dict(made.dtypes) == {"b": "tinyint", "kept": "bigint", "d": "float", "e": "float", "nothing": "float"} and rows(made.select("b", "kept")) == rows(df.select("b", "kept"))
    assert dict(relational.narrow(wide).dtypes) == {"i": "int", "l": "bigint", "d": "double"}
    assert relational.narrow_report(wide.select(F.lit("x").alias("s"))).collect() == []


def test_blocks_of_columns():
    stored = ["TransactionDT", "V3", "D16", "D15", "id_x", "C14", "uid_size", "le_M1", "graph_deg_a", "dist2"]
    assert relational.select_features(stored, ["C", "D", "base", "uid"]) == ["D15", "C14", "uid_size", "dist2"]
    assert relational.select_features(stored, ["V", "graph", "label_encode"], ["V3"]) == ["le_M1", "graph_deg_a"]
    assert relational.block_of("TransactionDT", ["base", "V"]) is None and relational.block_of("id_x", ["base", "id"]) == "id"
    assert relational.raw_block(stored, None, "id_", ["id_x"]) == [] and relational.raw_block(stored, ["dist2", "dist9"], "") == ["dist2"]


def test_split_by_day(spark):
    second = 86_400
    seconds = [second * (1 + d) + 37 * (d % 11) for d in range(61) for _ in range(1 + d % 3)]
    df = temporal.add_time_features(spark.createDataFrame(enumerate(seconds), "k long, t long"), "t")
    split = temporal.temporal_split(df, "day", 20, 4, 39)
    bounds = {"train": (0, 20), "gap": (21, 24), "val": (25, 39), "test": (40, 60)}
    for r in temporal.split_summary(split.withColumn("y", F.lit(1)), "day", "y").collect():
        low, high = bounds[r.split]
        assert (r.day_min, r.day_max, r.rate) == (low, high, 1.0) and r.n == sum(1 + d % 3 for d in range(low, high + 1))
        assert r.pct == pytest.approx(r.n / len(seconds))
    assert rows(temporal.split_from_masks(temporal.split_masks(split, "k"), "k")) == rows(split.select("k", "split"))
    for bad in ((20, 0, 39), (20, 4, 24), (20, 4, 60), (39, 4, 20)):
        with pytest.raises(ValueError):
            temporal.temporal_split(df, "day", *bad)
    early = temporal.add_time_features(spark.createDataFrame([(-5,), (second + 7_201,)], "t long"), "t").collect()
    assert [(r.day, r.week, r.hour, r.dayofweek) for r in early] == [(-2, -1, 23, 5), (0, 0, 2, 0)]


def test_encoders_look_at_training_rows_only(spark):
    shown = [(1, "red", 4.0), (2, "red", 8.0), (3, "blue", 6.0), (4, None, 1.0), (5, "green", 3.0)]
    hidden = [(6, "red", 12.0), (7, "black", 5.0), (8, None, 2.0)]
    df = spark.createDataFrame(shown + hidden, "k long, c string, v double")
    train = df.where("k <= 5")
    freq = {r.k: r.freq_c for r in E.apply_frequency(df, E.fit_frequency(train, "c"), "c").collect()}
    assert freq == {1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 2, 7: 0, 8: 0}
    code = {r.k: r.le_c for r in E.apply_label_codes(df, E.fit_label_codes(train, "c"), "c").collect()}
    assert code == {1: 2, 2: 2, 3: 0, 4: -1, 5: 1, 6: 2, 7: -1, 8: -1}
    stat = {r.k: (r.v_c_mean, r.v_c_std, r.v_c_ratio) for r in E.apply_group_stats(df, E.fit_group_stats(train, "c", "v"), "c", "v").collect()}
    assert stat[6] == pytest.approx((6.0, math.sqrt(8), 2.0)) and stat[3] == (6.0, None, 1.0) and stat[7] == stat[8] == (None, None, None)
    amounts = spark.createDataFrame([(0.25,), (41.0,), (-14.25,), (None,)], "v double").select(*[c.alias(n) for n, c in E.amount_features(F.col("v")).items()]).collect()
    assert [tuple(r) for r in amounts[:2]] == [pytest.approx((math.log(1.25), 0.25)), pytest.approx((math.log(42), 0.0))] and [tuple(r) for r in amounts[2:]] == [(None, 0.75), (None, None)]


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), int(v)) for i, v in enumerate(rng.permutation(400))]
    df = spark.createDataFrame(data, "i long, v long").repartition(9)
    got = {r.v: (r.s, r.n) for r in running_totals(df, [F.col("v").asc()], {"s": F.col("i"), "n": F.lit(1)}).collect()}
    place = {v: i for i, v in data}
    upto = np.cumsum([place[v] for v in range(400)])
    assert got == {v: (upto[v], v + 1) for v in range(400)}
    assert rows(dense_codes(df.select((F.col("v") % 7).alias("m")), "m", start=3)) == [(m, m + 3) for m in range(7)]
    assert running_totals(df.limit(0), [F.col("v").asc()], {"s": F.col("i")}).collect() == []


def test_quantiles_equal_numpy(spark):
    x = np.round(np.random.default_rng(9).gamma(2, 3, 257), 1)
    long = spark.createDataFrame([("g", float(v)) for v in x] + [("one", 4.0), ("one", math.nan), ("none", None), ("one", math.inf)], "f string, v double")
    fractions = [0, 0.03, 0.25, 0.5, 0.91, 1]
    got = exact_quantiles(long, "f", "v", fractions)
    assert np.allclose(got["g"], np.quantile(x, fractions)) and got["one"] == [4.0] * 6 and "none" not in got
    assert quantiles(long.limit(0), "v", [0.3]) == []


def test_equal_patterns_of_missing_values(spark):
    data = [(k, None if k % 3 else 1, "x" if k % 3 == 0 else None, None if k % 5 else 2.0, 1.5 if k % 5 == 0 else None, k) for k in range(200)]
    df = spark.createDataFrame(data, "k long, a long, b string, c double, d double, e long")
    got = {(r.columns, r.n_missing) for r in profiling.missing_pattern_groups(df, ["a", "b", "c", "d", "e", "k"], "k").collect()}
    assert got == {("a,b", 133), ("c,d", 160), ("e,k", 0)}


def test_log_of_experiments_grows_columns_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "log")
    first = reporting.log_experiment(spark, path, "m,1", "base+C", {"depth": 3}, {"auc": 0.75}, n_features=7, positive_weight=5.0, notes='a "note"')
    assert rows(first.select("name", "val_auc", "n_features", "positive_weight", "notes")) == [("m,1", 0.75, 7, 5.0, 'a "note"')]
    log = reporting.log_experiment(spark, path, "m2", "base", {"depth": 4}, {"auc": 0.5, "ks": 0.25}, {"auc": 0.625}, trees=12)
    assert rows(log.select("name", "val_ks", "test_auc", "trees")) == [("m,1", None, None, None), ("m2", 0.25, 0.625, 12)]
    assert rows(reporting.tested_experiments(log.unionByName(log.withColumn("test_auc", F.lit(0.7)).where("name = 'm2'").withColumn("timestamp", F.lit("9999")))).select("name", "test_auc")) == [("m2", 0.7)]
    one, two = (r.param_hash for r in log.orderBy("timestamp", "name").collect())
    assert one != two and len(one) == 8 and reporting.parameter_hash({"x": 1, "y": [2]}) == reporting.parameter_hash({"y": [2], "x": 1})
    assert all(r.timestamp.endswith("+00:00") for r in log.collect())
    both = reporting.union_logs([log.select("name"), log.select("name", "val_auc")])
    assert both.count() == 4 and both.columns == ["name", "val_auc"]


def test_samples_are_the_same_each_time(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 2)) for i in range(700)], "k long, y int")
    some = [rows(reporting.hash_sample(df.repartition(n), "k", 33)) for n in (1, 4)]
    assert some[0] == some[1] and len(some[0]) == 33 and rows(reporting.hash_sample(df, "k", 33, seed=1)) != some[0]
    sample = reporting.stratified_sample(df, "k", "y", 220)
    assert (sample.where("y = 1").count(), sample.count()) == (100, 220) and sample.agg(F.sum("weight")).first()[0] == pytest.approx(700)
    assert reporting.stratified_sample(df, "k", "y", 10).where("y = 0").count() == 0


def test_simulation_counts_good_rows_by_weight(spark):
    from sedimenta.operators import costs

    data = [(1, 310.0, 700, 1.0), (0, 320.0, 50, 2.5), (0, 400.0, 60, 2.5), (1, 400.0, 900, 1.0), (0, 700.0, 10, 2.5)]
    df = spark.createDataFrame(data, "y int, points double, cents long, w double")
    for r in costs.simulate(df, "y", "points", "cents", "w", [300, 320, 400, 800], 3.0).collect():
        good = sum(w for y, p, _, w in data if not y and p <= r.threshold)
        bad = sum(y for y, p, *_ in data if p <= r.threshold)
        missed = sum(c for y, p, c, _ in data if y and p > r.threshold)
        assert (r.review_rate, r.recall, r.fn_cost, r.total_cost) == pytest.approx(((good + bad) / 9.5, bad / 2, missed, missed + 3 * good))
        assert r.precision == (pytest.approx(bad / (good + bad)) if good + bad else None)
    assert costs.simulate(df.limit(0), "y", "points", "cents", "w", [300], 3.0).first().review_rate is None


def test_layout_puts_linked_nodes_near(spark):
    edges = [(a, f"t{g}{i}", a) for g, a in enumerate(("u=1", "v=2")) for i in range(6 + g)] + [("u=1", "t00", "w=9"), ("u=1", "t01", "w=9")]
    links = spark.createDataFrame([(a, int(t[1:]), n) for a, t, n in edges], "anchor string, tx long, node string")
    rows_ = spark.createDataFrame([(int(t[1:]), 1, 2.5) for t in sorted({t for _, t, _ in edges})], "k long, y long, amount double")
    documents = reporting.subgraph_documents(rows_, "k", "y", "amount", links)
    assert [r.place for r in documents.orderBy("anchor").collect()] == [1, 2]
    spots = {(r.anchor, r.id): np.array([r.x, r.y]) for r in reporting.spring_layout(documents).collect()}
    assert len(spots) == 6 + 2 + 7 + 1 and all(np.abs(p).max() <= 1 + 1e-9 for p in spots.values())
    near = [np.linalg.norm(spots[a, f"tx{int(t[1:])}"] - spots[a, n]) for a, t, n in edges]
    every = [np.linalg.norm(p - q) for (a, _), p in spots.items() for (b, _), q in spots.items() if a == b]
    assert np.mean(near) < np.mean([d for d in every if d > 0]) and reporting.spring_layout(documents.limit(0)).collect() == []


def test_command_line(spark, capsys):
    from sedimenta.__main__ import main

    assert main(["nowhere"]) == 0 and "p5_found" in capsys.readouterr().out and main(["nowhere", "no_such_query"]) == 2
