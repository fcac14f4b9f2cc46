"""Queries of the llm package: against SQL where there is any, else against brute force."""

import os
from collections import Counter, defaultdict

import pytest

from sedimenta.llm import queries
from tests.compare import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    pytest.importorskip("duckdb")
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name]) == []


def test_splits_keep_clients_and_meet_the_targets(spark):
    out = queries.p1_splits(spark, SF).collect()
    assert len(out) == len({r.TransactionID for r in out})
    per = defaultdict(set)
    for r in out:
        per[r.first_id].add(r.split_name)
    assert all(len(s) == 1 for s in per.values())
    for r in queries.p1_shares(spark, SF).collect():
        assert abs(r.share - r.target_share) <= 1 / len(out)
    found = queries.p1_found(spark, SF).collect()
    first = {r.TransactionID: r.first_id for r in out}
    assert all(first[r.TransactionID] == r.first_id == first[r.first_id] for r in found)
    assert Counter(first.values())[found[0].first_id] == 1 + sum(r.first_id == found[0].first_id for r in found)


def test_distinct_counts_come_near_exact_ones(spark):
    pytest.importorskip("duckdb")
    exact = connect(SF).sql(f"WITH {queries.TX_SQL} SELECT tx_day, count(DISTINCT card1), count(*) FROM tx GROUP BY 1").fetchall()
    got = {r.tx_day: r for r in queries.p3_distinct(spark, SF).where("level = 'tx_day'").collect()}
    assert len(got) == len(exact)
    for day, cards, n in exact:
        assert got[day].n_rows == n and abs(got[day].n_distinct - cards) <= 0.5 + 4 * queries.ERROR * cards


def test_saturated_bitmaps_lose_no_group(spark, tmp_path):
    import pandas as pd

    n = 1000  # all cards of a device on a day, and one group far from it
    card, day = [*range(n), *[1] * 40], pd.Timestamp("2024-01-01")
    pd.DataFrame({"TransactionID": range(len(card)), "card1": card, "DeviceInfo": ["d"] * n + ["e"] * 40, "ProductCD": ["W"] * n + [None] * 40, "TransactionDT": 86400, "loaded_at": day, "load_id": 0}).to_parquet(tmp_path / "merged_train.parquet", coerce_timestamps="us")
    for bits in (64, 1024, queries.BITS):
        got = sorted(map(tuple, queries.p3_found(spark, str(tmp_path), bits).collect()))
        assert got == [("d", "W", 0), ("d", "all", 0)]


def test_ids_counts_and_mix_fit_together(spark):
    ids = {r.doc_id: len(r.ids) for r in queries.p7_ids(spark, SF).collect()}
    trip = queries.p7_round_trip(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in trip} == ids and all(r.same for r in trip)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    targets = spark.read.parquet(f"{SF}/mix_targets.parquet").collect()
    tokens = Counter()
    for d, n in ids.items():
        tokens[source[d]] += n
    total = sum(tokens[t.source] for t in targets)
    assert {r.source for r in queries.p8_found(spark, SF).collect()} == {t.source for t in targets if t.max_repeats * tokens[t.source] < t.target_share * total}
    most = {t.source: t.max_repeats for t in targets}
    mix = queries.p8_mix(spark, SF).collect()
    assert all(0 < r.repeats <= most[r.source] and r.n_tokens == ids[r.doc_id] for r in mix)
    shares = {r.source: r for r in queries.p8_shares(spark, SF).collect()}
    mixed = Counter()
    for r in mix:
        mixed[r.source] += r.repeats * r.n_tokens
    assert all(shares[s].mixed_tokens == mixed[s] for s in most) and sum(r.mixed_share for r in shares.values()) == pytest.approx(1)


def test_subjects_agree_with_most_labels(spark):
    found = {(r.doc_id, r.subject) for r in queries.p9_found(spark, SF).collect()}
    labels = {(r.doc_id, r.subject) for r in spark.read.parquet(f"{SF}/doc_subject_labels.parquet").collect()}
    assert len(found & labels) >= 0.8 * len(labels)
    assert max(Counter(d for d, _ in found).values()) <= 2
    composition = {r.subject: r.n for r in queries.p9_composition(spark, SF).collect()}
    assert composition == {s: sum(x == s for _, x in found) for s in composition}


@pytest.mark.parametrize("name", ["p1_found", "p1_shares", "p3_found", "p3_distinct"])
def test_query_over_skewed_tables(spark, name, tmp_path):
    pytest.importorskip("duckdb")
    from tests.skewed import skewed_tables

    folder = skewed_tables(SF, tmp_path)
    assert differences(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLE[name]) == []
