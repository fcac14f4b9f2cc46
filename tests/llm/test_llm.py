"""Operators of the llm package on small cases: brute force, exact round trips, held-out accuracy."""

import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import distinct, mixing, splits, subjects, tokenizer
from sedimenta.llm.components import components


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# components and splits


def brute_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "nulls"])
def test_components_equal_union_find(spark, kind):
    random.seed(kind)
    ids = random.sample(range(1000), 60)
    links = {
        "chain": list(zip(ids, ids[1:])),
        "star": [(ids[0], x) for x in ids[1:]],
        "random": [(random.choice(ids), random.choice(ids)) for _ in range(45)],
        "nulls": [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5)],
    }[kind]
    df = spark.createDataFrame([(*x, "clash") for x in links], "x long, y long, node string")
    got = components(df, "x", "y").collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == brute_components(links)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_closest_subset_equals_brute_force():
    random.seed(4)
    for _ in range(200):
        sizes = {random.randint(1, 9): random.randint(1, 3) for _ in range(3)}
        target = random.randint(0, 40)
        taken = splits.closest_subset(sizes, target)
        assert all(0 < k <= sizes[s] for s, k in taken.items())
        sums = {sum(c) for k in range(sum(sizes.values()) + 1) for c in itertools.combinations([s for s, n in sizes.items() for _ in range(n)], k)}
        assert abs(sum(s * k for s, k in taken.items()) - target) == min(abs(x - target) for x in sums)


def total_of(taken):
    return sum(s * k for s, k in taken.items())


def test_closest_subset_of_wide_targets():
    assert splits.closest_subset({3_000_000: 1, 2_500_000: 2}, 5_000_000) == {2_500_000: 2}
    assert splits.closest_subset({3_000_001: 1, 2_500_000: 2}, 5_000_000) == {2_500_000: 2}
    many = {5 * 10**10: 1, 1: 3 * 10**10, 2: 10**10, 3: 10**9}
    taken = splits.closest_subset(many, 12_345_678_901)
    assert total_of(taken) == 12_345_678_901 and all(0 < k <= many[s] for s, k in taken.items())
    assert splits.closest_subset({0: 5, 4: 0}, 3) == {} and splits.closest_subset({4: 2}, 0) == {}


def test_coarse_cells_come_near(monkeypatch):
    random.seed(6)
    for bits, cells, most in ((16, 1 << 20, 0), (16, 64, 4)):
        monkeypatch.setattr(splits, "MOST_BITS", bits)
        monkeypatch.setattr(splits, "CELLS", cells)
        for _ in range(200):
            sizes, target = {random.randint(1, 30): random.randint(1, 3) for _ in range(4)}, random.randint(0, 150)
            sums = {0}
            for s, n in sizes.items():
                sums = {x + s * k for x in sums for k in range(n + 1)}
            assert abs(total_of(splits.closest_subset(sizes, target)) - target) <= min(abs(x - target) for x in sums) + most


@pytest.mark.parametrize("step, target", [(lambda i: 8 * i, 4_000_001), (lambda i: 7 * i + 1, 3_500_001)])
def test_a_thousand_sizes_need_little_memory(step, target):
    sizes = {step(i): 2 for i in range(1, 1001)}
    tracemalloc.start()
    taken = splits.closest_subset(sizes, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000 and abs(total_of(taken) - target) <= (1 if step(1) == 8 else 0)


def test_splits_keep_groups_and_meet_targets(spark):
    random.seed(2)
    data, tx = [], itertools.count()
    for g, size in enumerate([300, 90, 40] + [random.randint(1, 6) for _ in range(150)]):
        data += [(next(tx), g, "clash") for _ in range(size)]
    records = spark.createDataFrame(data, "r long, g long, split_name string").select("r", "g")
    got = splits.split_records(records, "r", "g", [("train", 0.7), ("val", 0.12), ("test", 0.18)])
    out = got.collect()
    assert sorted(r.r for r in out) == list(range(len(data)))
    per = defaultdict(set)
    for r in out:
        per[r.g].add(r.split_name)
    assert all(len(s) == 1 for s in per.values())
    share = Counter(r.split_name for r in out)
    for name, want in (("train", 0.7), ("val", 0.12), ("test", 0.18)):
        assert abs(share[name] - want * len(data)) <= 1.5
    assert rows(got) == rows(splits.split_records(records.repartition(5), "r", "g", [("train", 0.7), ("val", 0.12), ("test", 0.18)]))


def test_splits_of_one_huge_group_and_of_nothing(spark):
    one = spark.createDataFrame([(i, 1) for i in range(50)], "r long, g long")
    assert {r.split_name for r in splits.split_records(one, "r", "g", [("a", 0.5), ("b", 0.5)]).collect()} in ({"a"}, {"b"})
    assert splits.split_records(one.limit(0), "r", "g", [("a", 1.0)]).collect() == []


def test_many_groups_of_a_size_go_through_buckets(spark):
    groups = spark.createDataFrame([(i, 1) for i in range(3000)], "g long, s long")
    got = splits.assign_groups(groups, "g", "s", [("a", 0.25), ("b", 0.75)], bucket_rows=50)
    assert Counter(r.split_name for r in got.collect()) == {"a": 750, "b": 2250}


# distinct counts


def test_estimates_stay_within_the_stated_error_and_merge(spark):
    bits = distinct.bits_for(0.02, 5000)
    assert distinct.relative_error(5000, bits) <= 0.02 < distinct.relative_error(5000, bits // 8)
    data = [(load, g, i * 7919 % n) for g, n in (("a", 5000), ("b", 300), ("c", 3)) for load in (1, 2) for i in range(0, n + load * 10)]
    df = spark.createDataFrame([*data, (1, "c", None), (2, None, 5)], "l int, g string, x long")
    parts = distinct.partial_bitmaps(df, ["l", "g"], "x", bits)
    got = {r.g: r for r in distinct.estimates(distinct.merge_bitmaps(parts, ["g"]), ["g"], bits).collect()}
    true = df.groupBy("g").agg(F.countDistinct("x").alias("d"), F.count("*").alias("n")).collect()
    for r in true:
        assert got[r.g].n_rows == r.n
        assert abs(got[r.g].n_distinct - r.d) <= max(0.5, 4 * 0.02 * r.d)
    whole = distinct.estimates(distinct.partial_bitmaps(df, ["g"], "x", bits), ["g"], bits)
    assert {r.g: r.n_distinct for r in whole.collect()} == {g: r.n_distinct for g, r in got.items()}
    levels = distinct.estimates(distinct.merge_sets(parts, [[], ["g"]], ["g"]), ["level", "g"], bits)
    assert {(r.level, r.g): r.bits_set for r in levels.collect()}["g", "b"] == got["b"].bits_set
    assert levels.where("level = 'all'").first().n_rows == df.count()


def test_full_and_empty_bitmaps(spark):
    df = spark.createDataFrame([("a", i) for i in range(5000)] + [("b", None)], "g string, x long")
    got = {r.g: r for r in distinct.estimates(distinct.partial_bitmaps(df, ["g"], "x", 64), ["g"], 64).collect()}
    assert got["a"].bits_set == 64 and got["a"].error is None and got["a"].n_distinct == pytest.approx(64 * math.log(64))
    assert (got["b"].n_distinct, got["b"].n_rows) == (0.0, 1)
    assert distinct.partial_bitmaps(df.limit(0), ["g"], "x", 64).collect() == []


def test_bounds_hold_for_few_and_many_items(spark):
    bits = 4096
    data = [(n, n * 100_003 + i) for n in (1, 25, 30, 300, 3000, 12_000) for i in range(n)]
    df = spark.createDataFrame(data, "g long, x long")
    est = distinct.estimates(distinct.partial_bitmaps(df, ["g"], "x", bits), ["g"], bits)
    for r in est.withColumn("high", distinct.most_items(bits)).collect():
        assert r.bits_set <= r.g <= r.high + 1e-9


# tokenizer

TEXTS = [
    "", " ", "\n\n\t x", "def f(x):\r\n\treturn x  # don't I'll we've", "<|endoftext|> is ordinary", "naïve café — 北京 и мир", "é é \U0001f469‍\U0001f4bb\U0001f3fd", "x" * 3000, "ab" * 5000, "0123456789 ²½ ٣٤",
    "\x00\x1c\x85\xa0 end", "a" + " " * 700 + "b", "SELECT * FROM t WHERE a<>'b';--", "ꙮ﻿�",
]


@pytest.fixture(scope="module")
def own():
    with open(f"{tokenizer.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return tokenizer.Tokenizer(tokenizer.parse_ranks(f.read()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(f"{tokenizer.FOLDER}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(own, library):
    for text in TEXTS:
        assert list(own.encode(text)) == library(text), text[:40]


def test_random_texts_round_trip_and_equal_the_library(own, library):
    random.seed(8)
    letters = ["abcdefgh ", "aAbB_(){};=\n\t ", "é中文кир😀 ́", "'s're'll't 09", "etaoin shrdlu"]
    for _ in range(1500):
        alphabet = random.choice(letters) + random.choice(letters)
        text = "".join(random.choice(alphabet) for _ in range(random.choice([1, 5, 40, 120])))
        ids = list(own.encode(text))
        assert ids == library(text) and own.decode(ids) == text and own.count(text) == len(ids)


def test_states_may_be_forgotten(own, library, monkeypatch):
    monkeypatch.setattr(tokenizer, "MOST_STATES", 50)
    monkeypatch.setattr(tokenizer, "MOST_PIECES", 3)
    for text in TEXTS:
        assert list(own.encode(text)) == library(text)


def fresh():
    with open(f"{tokenizer.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return tokenizer.Transducer(tokenizer.parse_ranks(f.read()))


@pytest.mark.parametrize("letters, most", [("ab", 500), ("abc", 1500), ("=-+", 3000), ("x", 50)])
def test_states_of_a_long_piece_are_few_and_tokens_leave_before_its_end(library, letters, most):
    random.seed(1)
    piece, t, ids, early = "".join(random.choices(letters, k=1_000_000)), fresh(), [], 0
    for at, settled in enumerate(t.stream(b for b in piece.encode())):
        early += len(settled) if len(ids) < 1000 else 0
        ids += settled
    assert ids == library(piece)
    assert len(t.places) <= most  # of a million prefixes
    assert max(len(open_) for places in t.places for _, _, open_ in places) <= 12 and early > 900
    fed, source = [], iter(piece.encode())
    stream = fresh().stream(source)
    while len(fed) < 100:
        fed += next(stream)
    assert sum(1 for _ in source) > 999_000  # a hundred tokens were there after a thousand bytes


def test_states_of_ten_megabytes_are_bounded_without_forgetting():
    words = [a + b + c for a in ("", "get", "set", "is", "has", "make", "re", "un") for b in ("user", "Index", "value", "Buffer", "count", "Name", "hash") for c in ("", "s", "Id", "List", "Of", "_at", "ing", "ed")]
    random.seed(3)
    t, seen, prefixes = fresh(), [], 0
    for _ in range(10):
        size = 0
        while size < 1_000_000:
            piece = (" " + "".join(random.choices(words, k=random.randint(1, 12)))).encode()
            t.encode(piece)
            size += len(piece)
        prefixes += size
        seen.append(len(t.places))
    assert seen[-1] < min(tokenizer.MOST_STATES, prefixes / 50) and seen[-1] - seen[-2] < 0.1 * seen[0]


def test_decoder_waits_for_unfinished_characters():
    data = "aé中😀z".encode()
    for cut in range(len(data) + 1):
        stream = tokenizer.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == "aé中😀z"
    stream = tokenizer.Utf8Stream()
    assert stream.feed(b"a\xf0\x9f") == "a" and stream.close() == "�"


def test_encode_texts_gives_every_row_a_list(spark, library):
    df = spark.createDataFrame([*[(i, t, "clash") for i, t in enumerate(TEXTS)], (99, None, None), (None, "x", None)], "d long, t string, ids string")
    got = tokenizer.encode_texts(df, "d", "t", tokenizer.vocabulary(spark)).collect()
    assert len(got) == df.count()
    by = {r.d: list(r.ids) for r in got}
    assert by[99] == [] and by[0] == [] and all(by[i] == library(t) for i, t in enumerate(TEXTS))
    assert {r.d: r.n_tokens for r in tokenizer.count_tokens(df, "t", ["d"], tokenizer.vocabulary(spark)).collect()} == {d: len(x) for d, x in by.items()}
    assert tokenizer.check_round_trip(df, "d", "t", tokenizer.vocabulary(spark)).where("not same").count() == 0
    assert tokenizer.encode_texts(df.limit(0), "d", "t", tokenizer.vocabulary(spark)).collect() == []


# mixing


def test_water_fill_clamps_and_redistributes():
    plan = {p.source: p for p in mixing.water_fill([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 10), ("d", 0.0, 3)], {"a": 100, "b": 1000, "c": 900, "d": 50})}
    assert plan["a"].planned == 100 and plan["a"].short and not plan["b"].short
    assert plan["b"].planned / plan["c"].planned == pytest.approx(1.5)
    assert sum(p.planned for p in plan.values()) == pytest.approx(2050) and plan["d"].planned == 0
    assert all(p.repeats <= p.most for p in plan.values())


def test_water_fill_when_nothing_is_enough():
    plan = mixing.water_fill([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.1, 5)], {"a": 10, "b": 10}, size=1000)
    assert [p.planned for p in plan] == [10, 20, 0] and all(p.short for p in plan)
    assert mixing.water_fill([], {}) == [] and mixing.water_fill([("a", 1.0, None)], {"a": 5})[0].planned == 0


def test_sampled_mix_meets_its_plan(spark):
    data = [(i, "a" if i < 200 else "b" if i < 4000 else None, i % 50) for i in range(4100)]
    df = spark.createDataFrame(data, "d long, s string, n_tokens long")
    tokens = {s: sum(n for _, x, n in data if x == s) for s in "ab"}
    plan = mixing.water_fill([("a", 0.3, 4), ("b", 0.7, 1)], tokens)
    got = mixing.sample_mix(df, "d", "s", plan).collect()
    assert len({r.d for r in got}) == len(got) and all(0 < r.repeats <= {"a": 4, "b": 1}[r.s] for r in got)
    for p in plan:
        assert abs(sum(r.n_tokens * r.repeats for r in got if r.s == p.source) - p.planned) <= 0.05 * p.planned + 50
    assert rows(mixing.sample_mix(df.repartition(6), "d", "s", plan)) == sorted(map(tuple, got), key=repr)
    assert mixing.sample_mix(df.limit(0), "d", "s", plan).collect() == []


# subjects


def test_words_are_cut_at_humps_and_joined_ones_are_split():
    assert subjects.Words().of("HTTPServer fooBar_baz SNAKE_CASE x 北京 naïve") == sorted(["http", "server", "foo", "bar", "baz", "snake", "case", "北京", "naïve"])
    f = subjects.Features(["goal", "league", "tmp", "table", "id"])
    assert f.of(["leaguetmp", "goal", "unknown", "tableid"]) == [0, 1, 2, 3, 4] and f.of([]) == []
    assert subjects.Words().of(None) == [] and subjects.Words().of("a1b") == []
    for times in (15, 20, 20_000):  # words of any length
        assert subjects.Features(["enzyme", "protein"]).of(["proteinenzyme" * times]) == [0, 1]
    assert subjects.Features(["белок", "фермент"]).of(["белокфермент"]) == [0, 1]
    assert subjects.Features(["goal", "goals", "score"]).of(["goalsscore", "goalscore"]) == [0, 1, 2] and subjects.Features([]).of(["anything"]) == []


def test_complement_weights_equal_their_definition():
    inside, n_inside, every, n = np.array([[8.0, 0.0], [5.0, 5.0], [0.0, 1.0]]), np.array([10.0, 20.0]), np.array([8.0, 50.0, 40.0]), 100.0
    w = subjects.complement_weights(inside, n_inside, every, n)
    raw = [[math.log((e + 0.5) / 101) - math.log((e - i + 0.5) / (n - m + 1)) for i, m in zip(row, n_inside)] for row, e in zip(inside, every)]
    size = [sum(abs(r[s]) for r in raw) for s in (0, 1)]
    for s in (0, 1):
        scale = min(2, max(0.5, sum(size) / 2 / size[s]))
        assert [float(x) for x in w[:, s]] == pytest.approx([r[s] * scale for r in raw], rel=1e-5)
    assert w[0, 0] == w.max() and subjects.complement_weights(inside * 0, n_inside * 0, every, n).max() == 0


def test_own_calibrations_differ_from_the_shared_one_only_where_labels_suffice(spark):
    rng = np.random.default_rng(4)
    ids = [[0] * int(a) + [1] * int(b) for a, b in rng.integers(1, 30, (600, 2))]
    data = [(i, x, [0] if x.count(0) > 15 and i % 2 else [1] if x.count(1) > 25 and i % 40 == 0 else [], True) for i, x in enumerate(ids)]
    features = spark.createDataFrame(data, "d long, ids array<int>, y array<int>, fit boolean")
    table = np.eye(2, dtype=np.float32)
    settings = subjects.Settings(own_labels=20)
    shared = subjects.calibrate(features, table, subjects.Settings(own_labels=10**9))
    own = subjects.calibrate(features, table, settings)
    assert (shared[0] == shared[1]).all() and (own[1] == shared[1]).all() and not (own[0] == shared[0]).all()
    assert subjects.calibrate(features, table * 0, settings) is None


def corpus(seed, n):
    rng = random.Random(seed)
    own = {s: [f"{s}{w}" for w in "abcdefghijklmnop"] for s in ("moon", "bread", "court")}
    plain = [f"plain{w}" for w in "abcdefghijklmnopqrstuvwxyz"]
    docs, truth = [], {}
    for i in range(n):
        about = rng.sample(sorted(own), rng.choice([0, 1, 1, 1, 2]))
        words = [rng.choice(plain) for _ in range(60)]
        for s in about:
            words += [rng.choice(own[s]) for _ in range(14)]
        words += [own[rng.choice(sorted(own))][0]] * rng.choice([0, 0, 12])  # a borrowed name
        rng.shuffle(words)
        docs.append((i, " ".join(words), "clash"))
        truth[i] = set(about)
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = corpus(1, 900)
    rng = random.Random(2)
    read = {i for i in truth if rng.random() < 0.25}
    labels = [(i, s if rng.random() > 0.05 else "court") for i in sorted(read) for s in sorted(truth[i])]
    extra = [(10_000, None, None), (10_001, "", None), (10_002, " \n", None), (10_003, "plaina " * 20_000, None)]
    df = spark.createDataFrame(docs + extra, "d long, t string, subject string")
    lab = spark.createDataFrame([*labels, labels[0], (77_777, "moon"), (1, "no such"), (None, "moon")], "d long, subject string")
    posterior = subjects.subject_posteriors(df, "d", "t", lab, ["bread", "court", "moon"])
    found = {(r.d, r.subject) for r in subjects.subjects_of(posterior, "d").collect()}
    hidden = {(i, s) for i, ss in truth.items() if i not in read for s in ss}
    got = {(i, s) for i, s in found if i not in read}
    assert len(got & hidden) / len(hidden) > 0.95 and len(got & hidden) / len(got) > 0.95
    assert not {i for i, _ in found} & {10_000, 10_001, 10_002, 10_003}
    assert max(Counter(i for i, _ in found).values()) <= 2


def test_subjects_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "moona moonb")], "d long, t string")
    lab = spark.createDataFrame([(1, "moon")], "d long, subject string")
    assert subjects.subject_posteriors(docs, "d", "t", lab.limit(0), ["moon"]).collect() == []
    assert subjects.subject_posteriors(docs.limit(0), "d", "t", lab, ["moon"]).collect() == []
    assert subjects.subject_posteriors(docs, "d", "t", lab, []).collect() == []


def test_calibration_finds_the_share_of_labelled_cases():
    rng = np.random.default_rng(0)
    s = rng.normal(0, 2, 20_000)
    true = rng.random(20_000) < 1 / (1 + np.exp(-3 * s))
    labelled = true & (rng.random(20_000) < 0.2)
    x = np.stack([np.ones_like(s), s, np.zeros_like(s), np.zeros_like(s)], 1)
    _, share = subjects.fit_calibration(x, np.ones_like(s), labelled.astype(float))
    assert share == pytest.approx(0.2, abs=0.03)
