"""Queries p4 and p5: per-card feature table over event types, and rolling totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators.feature_table import entity_feature_table, entity_type_stats
from sedimenta.operators.rolling import daily_totals, rolling_totals
from sedimenta.plans.transactions import LAST_DAY, TX_SQL, days, latest
from sedimenta.sources.tables import bounded, table


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = days(latest(spark, sf_dir, "card1", "ProductCD", "P_emaildomain", "TransactionDT", "TransactionAmt"))
    tx = tx.withColumn("P_emaildomain", D.unified_domain(F.col("P_emaildomain")))
    types = bounded(table(spark, sf_dir, "event_types", ["event_type_id", "ProductCD", "P_emaildomain"]))
    events = tx.join(types, ["ProductCD", "P_emaildomain"]).select("TransactionID", "card1", "event_type_id", "tx_day", "cents")
    # heavy groups show in the rows as stored, without the shuffle that finds the latest
    stored = table(spark, sf_dir, "merged_train", ["card1", "ProductCD", "P_emaildomain"]).withColumn("P_emaildomain", D.unified_domain(F.col("P_emaildomain")))
    sampled = stored.join(types, ["ProductCD", "P_emaildomain"]).select("card1", "event_type_id")
    return entity_type_stats(events, "card1", "event_type_id", "TransactionID", "tx_day", "cents", sampled=sampled).withColumnsRenamed({"total": "total_cents"})


def p4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, last day and total of each card and event type that occur together."""
    return _stats(spark, sf_dir)


def p4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per card: counts, days since the last transaction and totals over the complete type list."""
    types = [r[0] for r in table(spark, sf_dir, "event_types", ["event_type_id"]).orderBy("event_type_id").collect()]
    stats = _stats(spark, sf_dir).withColumnsRenamed({"total_cents": "total"})
    wide = entity_feature_table(stats, "card1", "event_type_id", types, LAST_DAY)
    # cards without an event of the list have a row of zeros as well
    cards = latest(spark, sf_dir, "card1").select("card1").where(F.col("card1").isNotNull()).distinct()
    zeros, none = F.array_repeat(F.lit(0).cast("long"), len(types)), F.array_repeat(F.lit(None).cast("long"), len(types))
    full = cards.join(wide, "card1", "left")
    return full.select("card1", F.coalesce("counts", zeros).alias("counts"), F.coalesce("days_since", none).alias("days_since"), F.coalesce("totals", zeros).alias("totals_cents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with at least 3 transactions of a type, 30,000 cents together, the last on day 61 or before."""
    kept = (F.col("n") >= 3) & (F.col("total_cents") >= 30_000) & (F.col("last_day") <= 61)
    return _stats(spark, sf_dir).where(kept).select("card1", "event_type_id")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_totals(days(latest(spark, sf_dir, "card1", "TransactionDT", "TransactionAmt")), "card1", "tx_day", "cents")


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages per day of the last 7 and 30 days, for each card and day from its first."""
    totals = rolling_totals(_daily(spark, sf_dir), "card1", "tx_day", "cents", (7, 30), LAST_DAY)
    return totals.select("card1", "tx_day", F.col("t7").alias("total_7"), F.col("t30").alias("total_30"), (F.col("t7") / 7).alias("average_7"), (F.col("t30") / 30).alias("average_30"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from 29 whose last 7 days hold at least 200,000 cents and nine tenths of the last 30 days' total."""

    def burst(day, totals):  # noqa: ANN001, ANN202
        return (day >= 29) & (totals[7] >= 200_000) & (10 * totals[7] >= 9 * totals[30])

    return rolling_totals(_daily(spark, sf_dir), "card1", "tx_day", "cents", (7, 30), LAST_DAY, burst).select("card1", "tx_day")


QUERIES = {"p4_stats": p4_stats, "p4_features": p4_features, "p4_found": p4_found, "p5_rolling": p5_rolling, "p5_found": p5_found}

_STATS = f"""WITH {TX_SQL}, stats AS (
  SELECT card1, event_type_id, count(*) AS n, max(tx_day) AS last_day, CAST(sum(cents) AS BIGINT) AS total_cents
  FROM tx JOIN event_types e ON e.ProductCD = tx.ProductCD AND e.P_emaildomain = tx.domain WHERE card1 IS NOT NULL GROUP BY ALL)"""
_ROLL = f"""WITH {TX_SQL}, daily AS (SELECT card1, tx_day, sum(cents) AS cents FROM tx WHERE card1 IS NOT NULL GROUP BY ALL),
  spine AS (SELECT card1, CAST(unnest(range(min(tx_day), {LAST_DAY + 1})) AS BIGINT) AS tx_day FROM daily GROUP BY card1),
  roll AS (SELECT s.card1, s.tx_day,
      CAST(sum(coalesce(d.cents, 0)) OVER (PARTITION BY s.card1 ORDER BY s.tx_day ROWS 6 PRECEDING) AS BIGINT) AS total_7,
      CAST(sum(coalesce(d.cents, 0)) OVER (PARTITION BY s.card1 ORDER BY s.tx_day ROWS 29 PRECEDING) AS BIGINT) AS total_30
    FROM spine s LEFT JOIN daily d ON d.card1 = s.card1 AND d.tx_day = s.tx_day)"""
ORACLE = {
    "p4_features": f"""{_STATS}, c AS (SELECT DISTINCT card1 FROM tx WHERE card1 IS NOT NULL), f AS (SELECT c.card1, e.event_type_id AS t, n, {LAST_DAY} - last_day AS since, total_cents FROM c CROSS JOIN event_types e LEFT JOIN stats s ON s.card1 = c.card1 AND s.event_type_id = e.event_type_id)
      SELECT card1, list(coalesce(n, 0) ORDER BY t) AS counts, list(since ORDER BY t) AS days_since, list(coalesce(total_cents, 0) ORDER BY t) AS totals_cents FROM f GROUP BY card1""",
    "p4_stats": f"{_STATS} SELECT * FROM stats",
    "p4_found": f"{_STATS} SELECT card1, event_type_id FROM stats WHERE n >= 3 AND total_cents >= 30000 AND last_day <= 61",
    "p5_rolling": f"{_ROLL} SELECT *, total_7 / 7.0::DOUBLE AS average_7, total_30 / 30.0::DOUBLE AS average_30 FROM roll",
    "p5_found": f"{_ROLL} SELECT card1, tx_day FROM roll WHERE tx_day >= 29 AND total_7 >= 200000 AND 10 * total_7 >= 9 * total_30",
}
