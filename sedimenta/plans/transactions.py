"""Common input of the queries: transactions of ``merged_train``, each once, missing values as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators.versions import latest_rows
from sedimenta.sources.tables import table

LAST_DAY = 181
#: ``tx``: the same rows for the SQL check, all columns.
TX_SQL = """
tx AS (
  SELECT * REPLACE (CASE WHEN isnan(addr1) THEN NULL ELSE addr1 END AS addr1, CASE WHEN isnan(D1) THEN NULL ELSE D1 END AS D1,
                    CASE WHEN isnan(TransactionAmt) THEN NULL ELSE TransactionAmt END AS TransactionAmt),
         CAST(floor((TransactionDT - 86400) / 86400.0) AS BIGINT) AS tx_day,
         CAST(floor(floor((TransactionDT - 86400) / 86400.0) / 7.0) AS BIGINT) AS tx_week,
         coalesce(CAST(round(CASE WHEN isnan(TransactionAmt) THEN NULL ELSE TransactionAmt END * 100) AS BIGINT), 0) AS cents,
         regexp_replace(regexp_replace(lower(P_emaildomain), '^\\s+|\\s+$', '', 'g'), '\\.$', '') AS domain
  FROM merged_train WHERE TransactionID IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY TransactionID ORDER BY loaded_at DESC NULLS LAST) = 1
)"""


def latest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each TransactionID once, with the columns asked for of its latest row."""
    return latest_rows(table(spark, sf_dir, "merged_train"), "TransactionID", "loaded_at", list(columns))


def days(df: DataFrame) -> DataFrame:
    """``tx_day`` instead of ``TransactionDT`` and ``cents`` instead of ``TransactionAmt``, where they are there."""
    made = {"TransactionDT": D.day_of(F.col("TransactionDT")).alias("tx_day"), "TransactionAmt": D.cents(F.col("TransactionAmt")).alias("cents")}
    return df.select(*[made.get(c, F.col(c)) for c in df.columns])
