"""Queries of scans, joins, splits, encoders and profiles over the transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators import encoders as E
from sedimenta.operators import profiling as P
from sedimenta.operators import relational as R
from sedimenta.operators import temporal as T
from sedimenta.operators.feature_matrix import MatrixConfig, feature_matrix
from sedimenta.plans.transactions import TX_SQL, latest
from sedimenta.sources.tables import nan_to_null, normalise_identity_columns, table

# The columns whose values are nodes.
NODES = ["card1", "addr1", "DeviceInfo", "P_emaildomain", "R_emaildomain", "id_30", "id_31"]
SPLIT_SQL = "CASE WHEN tx_day <= 118 THEN 'train' WHEN tx_day <= 125 THEN 'gap' WHEN tx_day <= 150 THEN 'val' ELSE 'test' END"


def tx(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Transactions, once each, NaN as NULL."""
    return nan_to_null(latest(spark, sf_dir, *columns))


def split_tx(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Transactions with ``tx_day`` and ``split``."""
    df = tx(spark, sf_dir, "TransactionDT", *columns).withColumn("tx_day", D.day_of(F.col("TransactionDT")))
    return df.withColumn("split", T.split_of(F.col("tx_day"), 118, 7, 150))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison with another engine's order of summation."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def q_s2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned scan with a pushed filter."""
    return table(spark, sf_dir, "merged_train", ["TransactionID", "TransactionAmt", "load_id"]).where(F.col("TransactionAmt") > 500)


def q_j1_identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction with its identity row, if any."""
    identity = normalise_identity_columns(table(spark, sf_dir, "train_identity").distinct())
    joined = R.join_one_to_one(tx(spark, sf_dir, "TransactionDT"), identity, "TransactionID", "has_row")
    return joined.select("TransactionID", "id_01", "id_02", "id_12", "id_33", "DeviceType", "has_row")


def q_j2_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with their masks, by key."""
    masks = T.split_from_masks(table(spark, sf_dir, "split_masks"), "TransactionID")
    return R.join_one_to_one(tx(spark, sf_dir, "isFraud"), masks, "TransactionID", "has_mask")


def q_j5_unseen_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the test period that training never saw, with their rows (anti join)."""
    df = split_tx(spark, sf_dir, "card1")
    seen = df.where("split = 'train'").select("card1").distinct()
    return df.where("split = 'test'").groupBy("card1").agg(F.count("*").alias("n")).join(seen, "card1", "left_anti")


def q_p2_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.add_time_features(tx(spark, sf_dir, "TransactionDT"), "TransactionDT").select("TransactionID", "day", "week", "hour", "dayofweek")


def q_p4_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tx(spark, sf_dir, "TransactionAmt").select("TransactionID", *[c.alias(n) for n, c in E.amount_features(F.col("TransactionAmt")).items()]))


def q_p5_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.narrow_report(table(spark, sf_dir, "merged_train"), ["TransactionID", "TransactionDT", "isFraud"])


def q_p7_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the stored table and the block each belongs to."""
    columns = table(spark, sf_dir, "merged_train").columns
    chosen = R.select_features(columns, ["base", "D", "C", "V", "id"])
    return spark.createDataFrame([(c, R.block_of(c, ["base", "D", "C", "V", "id"])) for c in chosen], "column_name string, block string")


def q_t1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tx(spark, sf_dir, "TransactionDT").select("TransactionID", D.day_of(F.col("TransactionDT")).alias("tx_day"))
    return T.temporal_split(days, "tx_day").select("TransactionID", "split")


def q_t2_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored masks beside the split computed again."""
    stored = T.split_from_masks(table(spark, sf_dir, "split_masks"), "TransactionID").withColumnRenamed("split", "stored")
    both = split_tx(spark, sf_dir).join(stored, "TransactionID", "left")
    return both.groupBy("split", "stored").agg(F.count("*").alias("n"))


def q_a6_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.split_summary(split_tx(spark, sf_dir, "isFraud"), "tx_day", "isFraud"))


def q_a1_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "isFraud").withColumn("week", D.week_of(F.col("tx_day")))
    return rounded(P.rate_by(df, "week", "isFraud"))


def q_a2_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tx(spark, sf_dir, "isFraud", "TransactionDT").withColumn("hour", D.hour_of(F.col("TransactionDT")))
    return rounded(P.rate_by(df, "hour", "isFraud"))


def q_a3_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.cardinality_summary(tx(spark, sf_dir, *NODES), NODES))


def q_a4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.coverage_across_periods(split_tx(spark, sf_dir, *NODES), NODES, "split", "train", ["val", "test"]))


def stored_columns(spark: SparkSession, sf_dir: str, numbers_only: bool = False) -> list[str]:
    """Columns of merged_train but the key, the time that splits it and the load's own two."""
    kinds = dict(table(spark, sf_dir, "merged_train").dtypes)
    return [c for c, k in kinds.items() if c not in ("TransactionID", "TransactionDT", "load_id", "loaded_at") and not (numbers_only and k == "string")]


def q_a5_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every stored column and those derived from one: the client's start day, the amount's features, the unified sender domain."""
    columns = stored_columns(spark, sf_dir)
    df = tx(spark, sf_dir, "TransactionDT", *columns)
    derived = {"start_day": D.day_of(F.col("TransactionDT")) - F.col("D1"), **E.amount_features(F.col("TransactionAmt")), "domain": D.unified_domain(F.col("P_emaildomain"))}
    return P.missing_pattern_groups(df.withColumns(derived), [*columns, *derived], "TransactionID")


def q_a7_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "card1", "DeviceInfo")
    for c in ("card1", "DeviceInfo"):
        df = E.apply_frequency(df, E.fit_frequency(df.where("split = 'train'"), c), c)
    return df.select("TransactionID", "freq_card1", "freq_DeviceInfo")


def q_a8_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "card1", "TransactionAmt")
    fitted = E.fit_group_stats(df.where("split = 'train'"), "card1", "TransactionAmt")
    made = E.apply_group_stats(df, fitted, "card1", "TransactionAmt")
    return rounded(made.select("TransactionID", *[f"TransactionAmt_card1_{s}" for s in ("mean", "std", "ratio")]), 9)


def q_w5_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "P_emaildomain")
    return E.apply_label_codes(df, E.fit_label_codes(df.where("split = 'train'"), "P_emaildomain"), "P_emaildomain").select("TransactionID", "le_P_emaildomain")


def matrix(spark: SparkSession, sf_dir: str, config: MatrixConfig = MatrixConfig()) -> DataFrame:
    """The feature matrix of the stored columns, with label, day and split."""
    stored = table(spark, sf_dir, "merged_train").columns
    df = T.add_time_features(split_tx(spark, sf_dir, "isFraud", *config.needed(stored)), "TransactionDT")
    return feature_matrix(df, "TransactionID", ["isFraud", "tx_day", "split"], F.col("split") == "train", config)


def q_r11_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix(spark, sf_dir), 9)


QUERIES = {n: q for n, q in list(globals().items()) if n.startswith("q_")}

_W = f"WITH {TX_SQL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tx)"
_TEXT = {"addr1": "CAST(CAST(addr1 AS BIGINT) AS VARCHAR)", "card1": "CAST(card1 AS VARCHAR)"}
_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT split, '{c}' AS column_name, {_TEXT.get(c, c)} AS value FROM s" for c in NODES) + "), counts AS (SELECT column_name, split, value, count(*) AS n FROM long GROUP BY ALL)"
_INTS = "card1 has_identity load_id".split()
_REALS = "TransactionAmt card2 card3 card5 addr1 addr2 dist1 dist2 C1 C2 C5 C13 C14 D1 D2 D3 D4 D10 D15 V12 V45 V87 V258 V307".split()
_NARROW = [f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS target_type FROM merged_train" for c in _INTS]
_NARROW += [f"SELECT '{c}', min({c}) FILTER (isfinite({c})), max({c}) FILTER (isfinite({c})), 'float' FROM merged_train" for c in _REALS]


def _matrix_sql() -> str:
    """One dictionary for each encoded column, each joined by itself."""
    config = MatrixConfig()
    stored = ["card1", "has_identity", *_REALS, *TEXTS]
    labels, frequencies = ([c for c in cs if c in stored] for cs in (config.label_encode, config.frequency_encode))
    ctes, joins, out = [], [], ["s.TransactionID", "isFraud", "tx_day", "split", "CAST(floor(TransactionDT / 3600.0) AS BIGINT) % 24 AS hour", "tx_day % 7 AS dayofweek", "round(ln(1 + CASE WHEN TransactionAmt > -1 THEN TransactionAmt END), 9) AS amt_log", "round(TransactionAmt - floor(TransactionAmt), 9) AS amt_decimal"]
    for c in dict.fromkeys([*labels, *frequencies, *config.groups]):
        ctes.append(f"d_{c} AS (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY {c}) - 1 AS code, avg(TransactionAmt) AS m, stddev_samp(TransactionAmt) AS d FROM s WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})")
        joins.append(f"LEFT JOIN d_{c} ON d_{c}.v = s.{c}")
    out += [f"coalesce(d_{c}.code, -1) AS le_{c}" for c in labels] + [f"coalesce(d_{c}.n, 0) AS freq_{c}" for c in frequencies]
    for c in config.groups:
        out += [f"round(d_{c}.m, 9) AS TransactionAmt_{c}_mean", f"round(d_{c}.d, 9) AS TransactionAmt_{c}_std", f"round(TransactionAmt / nullif(d_{c}.m, 0), 9) AS TransactionAmt_{c}_ratio"]
    out += [f"round(s.{c}, 9) AS {c}" if c in _REALS else f"s.{c}" for c in config.raw_columns(stored)]
    return f"{_W}, {', '.join(ctes)} SELECT {', '.join(out)} FROM s {' '.join(joins)}"


#: Stored columns, for the SQL.
TEXTS = "ProductCD card4 card6 P_emaildomain R_emaildomain M1 M4 M6 id_30 id_31 DeviceType DeviceInfo".split()
COLUMNS = ["isFraud", "card1", "has_identity", *_REALS, *TEXTS]
ORACLE = {
    "q_s2_scan": "SELECT TransactionID, TransactionAmt, load_id FROM merged_train WHERE TransactionAmt > 500",
    "q_j1_identity_join": f"WITH {TX_SQL}, i AS (SELECT DISTINCT * FROM train_identity) SELECT tx.TransactionID, i.id_01, i.id_02, i.id_12, i.id_33, i.DeviceType, CAST(i.TransactionID IS NOT NULL AS INTEGER) AS has_row FROM tx LEFT JOIN i ON i.TransactionID = tx.TransactionID",
    "q_j2_matrix_join": f"WITH {TX_SQL} SELECT tx.TransactionID, isFraud, CASE WHEN is_train THEN 'train' WHEN is_gap THEN 'gap' WHEN is_val THEN 'val' WHEN is_test THEN 'test' END AS split, CAST(m.TransactionID IS NOT NULL AS INTEGER) AS has_mask FROM tx LEFT JOIN split_masks m ON m.TransactionID = tx.TransactionID",
    "q_j5_unseen_cards": f"{_W} SELECT card1, count(*) AS n FROM s WHERE split = 'test' AND card1 NOT IN (SELECT card1 FROM s WHERE split = 'train' AND card1 IS NOT NULL) GROUP BY card1",
    "q_p2_time": f"WITH {TX_SQL} SELECT TransactionID, tx_day AS day, tx_week AS week, CAST(floor(TransactionDT / 3600.0) AS BIGINT) % 24 AS hour, tx_day % 7 AS dayofweek FROM tx",
    "q_p4_amount": f"WITH {TX_SQL}, a AS (SELECT TransactionID, TransactionAmt AS x FROM tx) SELECT TransactionID, round(ln(1 + CASE WHEN x > -1 THEN x END), 6) AS amt_log, round(x - floor(x), 6) AS amt_decimal FROM a",
    "q_p5_narrow": " UNION ALL ".join(_NARROW),
    "q_p7_features": """SELECT column_name, CASE WHEN column_name IN ('TransactionAmt', 'dist1', 'dist2', 'has_identity') THEN 'base' WHEN regexp_full_match(column_name, 'D[0-9]+') THEN 'D'
        WHEN regexp_full_match(column_name, 'C[0-9]+') THEN 'C' WHEN column_name LIKE 'V%' THEN 'V' ELSE 'id' END AS block FROM (DESCRIBE merged_train)
        WHERE column_name IN ('TransactionAmt', 'dist1', 'dist2', 'has_identity') OR regexp_full_match(column_name, '[CDV][0-9]+') OR column_name LIKE 'id\\_%' ESCAPE '\\'""",
    "q_t1_split": f"{_W} SELECT TransactionID, split FROM s",
    "q_t2_masks": f"{_W} SELECT split, CASE WHEN is_train THEN 'train' WHEN is_gap THEN 'gap' WHEN is_val THEN 'val' WHEN is_test THEN 'test' END AS stored, count(*) AS n FROM s LEFT JOIN split_masks m ON m.TransactionID = s.TransactionID GROUP BY 1, 2",
    "q_a6_split_summary": f"{_W} SELECT split, count(*) AS n, min(tx_day) AS day_min, max(tx_day) AS day_max, round(avg(isFraud), 6) AS rate, round(count(*) / (SELECT count(*) FROM s), 6) AS pct FROM s GROUP BY split",
    "q_a1_weekly": f"WITH {TX_SQL} SELECT tx_week AS week, count(*) AS n, round(avg(isFraud), 6) AS rate FROM tx GROUP BY 1",
    "q_a2_hourly": f"WITH {TX_SQL} SELECT CAST(floor(TransactionDT / 3600.0) AS BIGINT) % 24 AS hour, count(*) AS n, round(avg(isFraud), 6) AS rate FROM tx GROUP BY 1",
    "q_a3_cardinality": f"""{_W}{_LONG}, g AS (SELECT column_name, value, sum(n) AS n FROM counts GROUP BY ALL), t AS (SELECT count(*) AS all_n FROM s)
        SELECT column_name, count(n) FILTER (value IS NOT NULL) AS n_unique, round(coalesce(sum(n) FILTER (value IS NULL), 0) / any_value(all_n), 6) AS pct_missing,
        CAST(coalesce(max(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS largest_group, round(coalesce(max(n) FILTER (value IS NOT NULL), 0) / any_value(all_n), 6) AS pct_in_largest,
        count(n) FILTER (value IS NOT NULL AND n = 1) AS n_singleton, round(count(n) FILTER (value IS NOT NULL AND n = 1) / count(n) FILTER (value IS NOT NULL), 6) AS pct_singleton,
        round(CAST(quantile_cont(n, 0.5) FILTER (value IS NOT NULL) AS DOUBLE), 6) AS median_group_size FROM g, t GROUP BY column_name""",
    "q_a4_coverage": f"""{_W}{_LONG}, tr AS (SELECT column_name, value FROM counts WHERE split = 'train' AND value IS NOT NULL)
        SELECT c.column_name, c.split, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, round(coalesce(sum(n) FILTER (tr.value IS NOT NULL), 0) / sum(n), 6) AS pct_rows_covered, round(count(tr.value) / count(*), 6) AS pct_values_covered
        FROM counts c LEFT JOIN tr ON tr.column_name = c.column_name AND tr.value = c.value WHERE c.split IN ('val', 'test') AND c.value IS NOT NULL GROUP BY 1, 2""",
    "q_a5_missing": f"WITH {TX_SQL}, x AS (SELECT *, tx_day - D1 AS start_day, CASE WHEN TransactionAmt > -1 THEN TransactionAmt END AS amt_log, TransactionAmt AS amt_decimal FROM tx), p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, bit_xor(CASE WHEN {c} IS NULL THEN hash(TransactionID) ELSE 0::UBIGINT END) AS x FROM x" for c in [*COLUMNS, "start_day", "amt_log", "amt_decimal", "domain"]) + ") SELECT string_agg(column_name, ',' ORDER BY column_name) AS columns, count(*) AS n_columns, n_missing FROM p GROUP BY n_missing, x HAVING count(*) >= 2",
    "q_a7_frequency": f"{_W}, a AS (SELECT card1, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1), b AS (SELECT DeviceInfo, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1) SELECT TransactionID, coalesce(a.n, 0) AS freq_card1, coalesce(b.n, 0) AS freq_DeviceInfo FROM s LEFT JOIN a ON a.card1 = s.card1 LEFT JOIN b ON b.DeviceInfo = s.DeviceInfo",
    "q_a8_group_stats": f"{_W}, a AS (SELECT card1, avg(TransactionAmt) AS m, stddev_samp(TransactionAmt) AS d FROM s WHERE split = 'train' GROUP BY 1) SELECT TransactionID, round(m, 9) AS TransactionAmt_card1_mean, round(d, 9) AS TransactionAmt_card1_std, round(TransactionAmt / nullif(m, 0), 9) AS TransactionAmt_card1_ratio FROM s LEFT JOIN a ON a.card1 = s.card1",
    "q_w5_codes": f"{_W}, a AS (SELECT P_emaildomain, row_number() OVER (ORDER BY P_emaildomain COLLATE C) - 1 AS c FROM (SELECT DISTINCT P_emaildomain FROM s WHERE split = 'train' AND P_emaildomain IS NOT NULL)) SELECT TransactionID, coalesce(c, -1) AS le_P_emaildomain FROM s LEFT JOIN a ON a.P_emaildomain = s.P_emaildomain".replace(" COLLATE C", ""),
    "q_r11_matrix": _matrix_sql(),
}
