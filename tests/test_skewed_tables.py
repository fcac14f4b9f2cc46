"""Queries over tables with hot keys and many missing values, against SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.skewed import skewed_tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return skewed_tables(SF, tmp_path_factory.mktemp("skewed"))


@pytest.mark.parametrize("name", "p2_totals p2_weekly p2_found p4_stats p4_features p4_found p5_rolling p5_found p6_found p6_profile q_a9_degree q_a10_cross q_a12_entropy q_w1_client_labels q_l5_features q_r11_matrix q_a14_activity".split())
def test_query_over_skewed_tables(spark, folder, name):
    pytest.importorskip("duckdb")
    assert differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["q_a9_degree", "q_r11_matrix", "q_w1_client_labels", "q_a12_entropy"])
def test_dictionaries_beyond_the_broadcast(spark, folder, name, monkeypatch):
    """The same without any broadcast dictionary: by skew join and, for several columns, unpivoted."""
    pytest.importorskip("duckdb")
    from sedimenta.operators import skew

    for function in (skew.lookup, skew.lookup_columns):
        monkeypatch.setattr(function, "__defaults__", (0,))
    assert differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) == []
