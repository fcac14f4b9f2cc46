"""Queries p2: counts and totals per sender domain, address and card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators.skew import heavy_keys, skew_aggregate
from sedimenta.plans.transactions import TX_SQL, days, latest
from sedimenta.session import cut_lineage
from sedimenta.sources.tables import bounded, table

KEYS = ["field_name", "key_value"]


def _fields(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each transaction and field; a missing value is a NULL key."""
    named = [
        F.lit("P_emaildomain"), D.unified_domain(F.col("P_emaildomain")),
        F.lit("addr1"), D.whole(F.col("addr1")).cast("string"),
        F.lit("card1"), F.col("card1").cast("string"),
    ]
    return df.select(*keep, F.stack(F.lit(3), *named).alias(*KEYS))


def _totals(spark: SparkSession, sf_dir: str, within: list[str], sums: list[str]) -> tuple[DataFrame, DataFrame]:
    """The transactions, and the totals per key."""
    heavy = heavy_keys(_fields(table(spark, sf_dir, "merged_train", ["P_emaildomain", "addr1", "card1"])), KEYS, share=0.005)
    columns = ["P_emaildomain", "addr1", "card1", *["TransactionDT"] * bool(within), *["TransactionAmt"] * ("total_cents" in sums)]
    tx = days(latest(spark, sf_dir, *columns))
    if within:
        tx = tx.withColumn("tx_week", D.week_of(F.col("tx_day")))
    first = {"n": F.count("*"), "total_cents": F.sum("cents")}
    long = _fields(tx, "TransactionID", *within, *["cents"] * ("total_cents" in sums))
    return tx, skew_aggregate(long, KEYS, within, {k: first[k] for k in sums}, {k: F.sum(k) for k in sums}, heavy, F.col("TransactionID"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and total of every value of the three fields, missing ones included."""
    return _totals(spark, sf_dir, [], ["n", "total_cents"])[1].select(*KEYS, "n", "total_cents")


def p2_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per week."""
    return _totals(spark, sf_dir, ["tx_week"], ["n", "total_cents"])[1].select(*KEYS, "tx_week", "n", "total_cents")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold at least 3 % of a week's transactions."""
    tx, per_key = _totals(spark, sf_dir, ["tx_week"], ["n"])
    weeks = tx.groupBy("tx_week").agg(F.count("*").alias("week_n"))
    held = per_key.where(F.col("key_value").isNotNull()).join(bounded(cut_lineage(weeks), 10_000), "tx_week")
    return held.where(100 * F.col("n") >= 3 * F.col("week_n")).select(*KEYS, "tx_week")


QUERIES = {"p2_totals": p2_totals, "p2_weekly": p2_weekly, "p2_found": p2_found}

_LONG = f"""WITH {TX_SQL}, long AS (
  SELECT 'P_emaildomain' AS field_name, domain AS key_value, tx_week, cents FROM tx
  UNION ALL SELECT 'addr1', CAST(CAST(addr1 AS BIGINT) AS VARCHAR), tx_week, cents FROM tx
  UNION ALL SELECT 'card1', CAST(card1 AS VARCHAR), tx_week, cents FROM tx)"""
ORACLE = {
    "p2_totals": f"{_LONG} SELECT field_name, key_value, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total_cents FROM long GROUP BY ALL",
    "p2_weekly": f"{_LONG} SELECT field_name, key_value, tx_week, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total_cents FROM long GROUP BY ALL",
    "p2_found": f"""{_LONG}, w AS (SELECT tx_week, count(*) AS week_n FROM tx GROUP BY 1)
      SELECT field_name, key_value, tx_week FROM long JOIN w USING (tx_week) WHERE key_value IS NOT NULL
      GROUP BY field_name, key_value, tx_week, week_n HAVING 100 * count(*) >= 3 * week_n""",
}
