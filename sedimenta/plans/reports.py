"""Queries of report tables, models and drift."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators import metrics as M
from sedimenta.operators import reporting as R
from sedimenta.plans.tabular import _TEXT, COLUMNS, SPLIT_SQL, rounded, split_tx, stored_columns, tx
from sedimenta.plans.transactions import TX_SQL
from sedimenta.session import checkpoint_dir, cut_lineage
from sedimenta.sources.tables import read_csv, table, write_json_documents, write_parquet

WEIGHTS = ["C1", "C2", "C13", "V12", "V45", "D1", "D2", "dist1", "TransactionAmt"]
ANCHORS = ["card1", "DeviceInfo", "addr1"]
SHOWN = ["card1", "addr1", "DeviceInfo", "P_emaildomain"]


def q_a20_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.importance_table(tx(spark, sf_dir, *WEIGHTS), WEIGHTS))


def q_a21_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.group_summary(R.importance_table(tx(spark, sf_dir, *WEIGHTS), WEIGHTS)))


def q_m5_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.drop_feature(R.importance_table(tx(spark, sf_dir, *WEIGHTS), WEIGHTS), "C13", "C1"))


def q_a24_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stored row of each card."""
    rows = table(spark, sf_dir, "merged_train", ["card1", "TransactionID", "load_id", "loaded_at"])
    return R.keep_last(rows.select("card1", "TransactionID", "load_id", "loaded_at").distinct(), "card1", [F.col("loaded_at"), F.col("TransactionID")]).select("card1", "TransactionID", "load_id")


def q_a23_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.chosen_entities(tx(spark, sf_dir, "isFraud", *ANCHORS), ANCHORS, "isFraud"))


def _subgraphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = cut_lineage(tx(spark, sf_dir, "isFraud", "TransactionAmt", *SHOWN))
    return df, R.subgraph_edges(df, "TransactionID", R.chosen_entities(df, ANCHORS, "isFraud"), SHOWN)


def q_r3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subgraphs(spark, sf_dir)[1]


def q_r4_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraphs as JSON documents, with nodes and edges, and their place by label rate."""
    df, edges = _subgraphs(spark, sf_dir)
    documents = R.subgraph_documents(df, "TransactionID", "isFraud", "TransactionAmt", edges).withColumn("fraud_rate", F.bround("fraud_rate", 6))
    return R.as_json(documents, keep=["anchor", "place"])


def q_r1_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts as one JSON document a week."""
    df = split_tx(spark, sf_dir, "isFraud").withColumn("week", D.week_of(F.col("tx_day")))
    each = df.groupBy("week").agg(F.count("*").alias("n"), F.sum("isFraud").alias("n_fraud"))
    return each.select(F.to_json(F.struct("week", "n", "n_fraud")).alias("document"))


def q_o4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 1,000 rows."""
    return R.hash_sample(tx(spark, sf_dir, "isFraud"), "TransactionID", 1000)


def q_o5_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and others up to 20,000 rows of the test period."""
    return R.stratified_sample(_test_rows(spark, sf_dir), "TransactionID", "isFraud")


def q_o5_stratified_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and others up to 500 rows of the test period."""
    return R.stratified_sample(_test_rows(spark, sf_dir), "TransactionID", "isFraud", 500)


def _test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(split_tx(spark, sf_dir, "isFraud").where("split = 'test'").select("TransactionID", "isFraud"))


def q_d1_missing_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing share of every stored column in the training and the test period."""
    columns = stored_columns(spark, sf_dir)
    df = split_tx(spark, sf_dir, *columns)
    parts = [x for c in columns for x in (F.lit(c), F.col(c).isNull().cast("int"))]
    long = df.where("split in ('train', 'test')").select("split", F.stack(F.lit(len(columns)), *parts).alias("column_name", "gone"))
    train, test = (F.avg(F.when(F.col("split") == s, F.col("gone"))) for s in ("train", "test"))
    return rounded(long.groupBy("column_name").agg(train.alias("train"), test.alias("test"), (test - train).alias("change")))


def q_d4_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of single columns in each period; missing values are left out."""
    df = cut_lineage(split_tx(spark, sf_dir, "isFraud", "C1", "C13"))
    out = None
    for c in ("C1", "C13"):
        for s in ("train", "val", "test"):
            one = M.evaluate(df.where(F.col("split") == s), "TransactionID", "isFraud", c, ()).select(F.lit(c).alias("column_name"), F.lit(s).alias("split"), "auc", "n")
            out = one if out is None else out.unionByName(one)
    return rounded(out)


def q_r5_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nodes of the subgraphs are drawn."""
    df, edges = _subgraphs(spark, sf_dir)
    return R.spring_layout(R.subgraph_documents(df, "TransactionID", "isFraud", "TransactionAmt", edges))


def q_s4_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table written as Parquet to the shared folder and read back, two columns of it."""
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    write_parquet(tx(spark, sf_dir, "card1", "addr1", "DeviceInfo"), path)
    return spark.read.parquet(path).select("TransactionID", "DeviceInfo")


def q_s7_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as CSV read back: of each file the last load among those with a row number."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "loads", ["load_id", "file_name", "n_rows"]).withColumn("n_rows", F.when(F.col("load_id") % 3 != 0, F.col("n_rows")))
    rows.withColumn("file_name", F.substring("file_name", 1, 6)).write.option("header", True).csv(path)
    log = read_csv(spark, path, "load_id long, file_name string, n_rows long").where(F.col("n_rows").isNotNull())
    return R.keep_last(log, "file_name", [F.col("load_id")])


def q_s8_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts written as JSON documents and read back as text."""
    path = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    df = split_tx(spark, sf_dir, "isFraud").withColumn("week", D.week_of(F.col("tx_day")))
    write_json_documents(df.groupBy("week").agg(F.count("*").alias("n"), F.sum("isFraud").alias("n_fraud")), path)
    return spark.read.text(path).withColumnRenamed("value", "document")


def q_s1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loads written as CSV to the shared folder and scanned again under a schema."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "loads", ["load_id", "file_name", "n_rows"]).write.option("header", True).csv(path)
    return read_csv(spark, path, "load_id long, file_name string, n_rows long")


def q_u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with different columns one below the other."""
    return R.union_logs([table(spark, sf_dir, "loads", ["load_id", "n_rows"]), table(spark, sf_dir, "split_targets", ["split_name", "target_share"])])


QUERIES = {n: q for n, q in list(globals().items()) if n.startswith("q_") and q.__module__ == __name__}

_IMP = f"WITH {TX_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({c}::DOUBLE) AS v FROM tx" for c in WEIGHTS) + """),
  i AS (SELECT feature, avg(v) AS mean_abs, CASE WHEN regexp_full_match(feature, 'C[0-9]+') THEN 'C' WHEN feature LIKE 'V%' THEN 'V' WHEN regexp_full_match(feature, 'D[0-9]+') THEN 'D' ELSE 'other' END AS feature_group FROM l WHERE v IS NULL OR NOT isnan(v) GROUP BY feature),
  imp AS (SELECT *, row_number() OVER (ORDER BY mean_abs DESC NULLS LAST, feature)::INTEGER AS place FROM i)"""
_ENT = f"WITH {TX_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_TEXT.get(c, c)} AS value, isFraud FROM tx WHERE {c} IS NOT NULL" for c in ANCHORS) + """),
  st AS (SELECT column_name, value, count(*) AS n, avg(isFraud) AS rate FROM l GROUP BY ALL HAVING count(*) BETWEEN 6 AND 60),
  ch AS (SELECT * FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY rate DESC, value) <= 6) UNION SELECT * FROM (SELECT * FROM st WHERE rate = 0 QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY value) <= 3))"""
_RT = f"WITH {TX_SQL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tx)"
_AUC = " UNION ALL ".join(f"SELECT '{c}' AS column_name, split, isFraud, {c} AS x FROM s WHERE split <> 'gap' AND {c} IS NOT NULL AND NOT isnan({c})" for c in ("C1", "C13"))
_SHOW = " UNION ALL ".join(f"SELECT TransactionID AS tx, '{c}' AS column_name, {_TEXT.get(c, c)} AS value FROM tx WHERE {c} IS NOT NULL" for c in SHOWN)
_SUB = f"""{_ENT}, a AS ({_SHOW}), h AS (SELECT ch.column_name || '=' || ch.value AS anchor, ch.column_name AS ac, tx FROM ch JOIN a USING (column_name, value)),
  o AS (SELECT anchor, a.tx, a.column_name || '=' || a.value AS node FROM h JOIN a ON a.tx = h.tx AND a.column_name <> h.ac), ed AS (SELECT anchor, tx, anchor AS node FROM h UNION ALL SELECT anchor, tx, node FROM o QUALIFY count(*) OVER (PARTITION BY anchor, node) > 1)"""


def _strata(most: int) -> str:
    return f"""{_RT}, te AS (SELECT TransactionID, isFraud FROM s WHERE split = 'test'), b AS (SELECT count(*) FILTER (isFraud = 0) AS good, count(*) FILTER (isFraud = 1) AS bad FROM te)
      SELECT TransactionID, isFraud, 1.0::DOUBLE AS weight FROM te WHERE isFraud = 1 UNION ALL (SELECT TransactionID, isFraud, good / greatest(0, least(good, {most} - bad))::DOUBLE FROM te, b WHERE isFraud = 0 QUALIFY row_number() OVER (ORDER BY md5(TransactionID || '-42'), TransactionID) <= {most} - bad)"""


ORACLE = {
    "q_o4_sample": f"WITH {TX_SQL} SELECT TransactionID, isFraud FROM tx ORDER BY md5(TransactionID || '-42'), TransactionID LIMIT 1000",
    "q_o5_stratified": _strata(20_000),
    "q_o5_stratified_500": _strata(500),
    "q_r4_subgraphs": f"""{_SUB}, r AS (SELECT ed.*, isFraud, TransactionAmt FROM ed JOIN tx ON TransactionID = ed.tx),
        nd AS (SELECT anchor, 'tx' || tx AS id, 'transaction' AS kind, count(*) AS degree, any_value(isFraud) AS fraud, round_even(any_value(TransactionAmt), 2) AS amount, NULL AS label FROM r GROUP BY anchor, tx
          UNION ALL SELECT anchor, node, 'attribute', count(*), NULL, NULL, left(regexp_replace(node, '^[^=]*=', ''), 24) FROM r GROUP BY anchor, node),
        hu AS (SELECT anchor, count(*) AS n_transactions, sum(isFraud)::BIGINT AS n_fraud, avg(isFraud) AS rate FROM r WHERE node = anchor GROUP BY anchor),
        ns AS (SELECT anchor, list({{'id': id, 'kind': kind, 'degree': degree, 'fraud': fraud, 'amount': amount, 'label': label}} ORDER BY id) AS nodes FROM nd GROUP BY anchor), es AS (SELECT anchor, list({{'source': 'tx' || tx, 'target': node}} ORDER BY 'tx' || tx, node) AS edges FROM r GROUP BY anchor)
        SELECT hu.anchor, row_number() OVER (ORDER BY rate DESC, hu.anchor)::INTEGER AS place, to_json({{'n_transactions': n_transactions, 'n_fraud': n_fraud, 'fraud_rate': round_even(rate, 6), 'nodes': nodes, 'edges': edges}})::VARCHAR AS document FROM hu JOIN ns ON ns.anchor = hu.anchor JOIN es ON es.anchor = hu.anchor""",
    "q_s4_parquet": f"WITH {TX_SQL} SELECT TransactionID, DeviceInfo FROM tx",
    "q_s7_log": "SELECT load_id, left(file_name, 6) AS file_name, n_rows FROM loads WHERE load_id % 3 <> 0 AND n_rows IS NOT NULL QUALIFY row_number() OVER (PARTITION BY left(file_name, 6) ORDER BY load_id DESC) = 1",
    "q_s1_csv": "SELECT load_id, file_name, n_rows FROM loads",
    "q_u1_union": "SELECT load_id, n_rows, NULL AS split_name, NULL AS target_share FROM loads UNION ALL SELECT NULL, NULL, split_name, target_share FROM split_targets",
    "q_a20_importance": f"{_IMP} SELECT feature, round(mean_abs, 6) AS mean_abs, feature_group, place FROM imp",
    "q_a21_groups": f"{_IMP} SELECT feature_group, count(*) AS n, round(sum(mean_abs), 6) AS total, round(avg(mean_abs), 6) AS mean, round(max(mean_abs), 6) AS largest, round(sum(mean_abs) / sum(sum(mean_abs)) OVER (), 6) AS pct_of_total FROM imp GROUP BY 1",
    "q_m5_decision": f"{_IMP}, d AS (SELECT max(mean_abs) FILTER (feature = 'C13') AS w, max(place) FILTER (feature = 'C13') AS p, max(mean_abs) FILTER (feature = 'C1') AS b FROM imp) SELECT round(w, 6) AS weight, p AS place, round(w / b, 6) AS ratio, (w / b < 0.2 OR p > 50) AS dropped FROM d",
    "q_a24_keep_last": "SELECT card1, TransactionID, load_id FROM (SELECT DISTINCT card1, TransactionID, load_id, loaded_at FROM merged_train) QUALIFY row_number() OVER (PARTITION BY card1 ORDER BY loaded_at DESC, TransactionID DESC) = 1",
    "q_a23_entities": f"{_ENT} SELECT column_name, value, n, round(rate, 6) AS rate FROM ch",
    "q_r3_edges": f"{_SUB} SELECT anchor, tx, node FROM ed",
    "q_r1_json": f"""WITH {TX_SQL} SELECT '{{"week":' || tx_week || ',"n":' || count(*) || ',"n_fraud":' || sum(isFraud) || '}}' AS document FROM tx GROUP BY tx_week""",
    "q_s8_json": f"""WITH {TX_SQL} SELECT '{{"week":' || tx_week || ',"n":' || count(*) || ',"n_fraud":' || sum(isFraud) || '}}' AS document FROM tx GROUP BY tx_week""",
    "q_d1_missing_drift": f"{_RT}, l AS (" + " UNION ALL ".join(f"SELECT split, '{c}' AS column_name, ({c} IS NULL)::INTEGER AS g FROM s" for c in COLUMNS) + ") SELECT column_name, round(avg(g) FILTER (split = 'train'), 6) AS train, round(avg(g) FILTER (split = 'test'), 6) AS test, round(avg(g) FILTER (split = 'test') - avg(g) FILTER (split = 'train'), 6) AS change FROM l GROUP BY 1",
    "q_d4_univariate": f"""{_RT}, m AS ({_AUC}), d AS (SELECT column_name, split, x, count(*) AS n, sum(isFraud) AS pos FROM m GROUP BY ALL), c AS (SELECT *, sum(pos) OVER (PARTITION BY column_name, split ORDER BY x DESC) AS cp, sum(n) OVER (PARTITION BY column_name, split) AS tn, sum(pos) OVER (PARTITION BY column_name, split) AS tp FROM d)
        SELECT column_name, split, round(sum((n - pos) * (cp - pos / 2)) / nullif(any_value(tp::DOUBLE * (tn - tp)), 0), 6) AS auc, any_value(tn)::BIGINT AS n FROM c GROUP BY 1, 2""",
}
