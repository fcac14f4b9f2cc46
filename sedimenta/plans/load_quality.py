"""Queries p6: profile of each load's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.quality import EDGES, baseline_drift, findings, load_drift, profile, read_baselines, value_counts
from sedimenta.sources.tables import table

#: Columns of merged_train in its order, by kind, for the SQL check.
NUMBERS = "TransactionID isFraud TransactionDT TransactionAmt card1 card2 card3 card5 addr1 addr2 dist1 dist2 C1 C2 C5 C13 C14 D1 D2 D3 D4 D10 D15 V12 V45 V87 V258 V307 has_identity".split()
TEXTS = "ProductCD card4 card6 P_emaildomain R_emaildomain M1 M4 M6 id_30 id_31 DeviceType DeviceInfo".split()


def _usual(spark: SparkSession, sf_dir: str) -> list:
    return read_baselines(table(spark, sf_dir, "column_baseline"))


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact profile of every column but the load's own two, per load."""
    df = table(spark, sf_dir, "merged_train")
    counts = value_counts(df, "load_id", [c for c in df.columns if c not in ("load_id", "loaded_at")])
    return profile(counts, "load_id", _usual(spark, sf_dir))


def p6_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the baseline's columns moved from the baseline and from the load before that has values of the column."""
    usual = _usual(spark, sf_dir)
    counts = value_counts(table(spark, sf_dir, "merged_train"), "load_id", [b.column for b in usual])
    moved = load_drift(counts, "load_id").join(baseline_drift(profile(counts, "load_id", usual), "load_id"), ["load_id", "column_name"], "full")
    rounded = [F.round(c, 6).alias(c) for c in ("psi_before", "chi2_before", "psi_baseline")]
    return moved.select("load_id", "column_name", "n_bins", *rounded)


def p6_drift_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every column but the load's own two moved from the load before, whether or not it has values there; the baseline's also from the baseline."""
    usual = _usual(spark, sf_dir)
    df = table(spark, sf_dir, "merged_train")
    counts = value_counts(df, "load_id", [c for c in df.columns if c not in ("load_id", "loaded_at")])
    known = value_counts(df, "load_id", [b.column for b in usual])
    moved = load_drift(counts, "load_id", every_group=True).join(baseline_drift(profile(known, "load_id", usual), "load_id"), ["load_id", "column_name"], "full")
    rounded = [F.round(c, 6).alias(c) for c in ("psi_before", "chi2_before", "psi_baseline")]
    return moved.select("load_id", "column_name", F.col("prev").alias("load_before"), F.col("all").alias("n_values"), F.col("prev_all").alias("n_values_before"), "n_bins", *rounded)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a load in a column of column_baseline."""
    usual = _usual(spark, sf_dir)
    counts = value_counts(table(spark, sf_dir, "merged_train"), "load_id", [b.column for b in usual])
    return findings(profile(counts, "load_id", usual), "load_id", usual, null_off=0.1503, drift_off=0.2003)


QUERIES = {"p6_profile": p6_profile, "p6_drift": p6_drift, "p6_drift_all": p6_drift_all, "p6_found": p6_found}


def _long(numbers: list[str], texts: list[str]) -> str:
    parts = [f"SELECT load_id, '{c}' AS column_name, CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END AS num, CAST(NULL AS VARCHAR) AS txt FROM merged_train" for c in numbers]
    parts += [f"SELECT load_id, '{c}', CAST(NULL AS DOUBLE), {c} FROM merged_train" for c in texts]
    return f"""WITH long AS ({' UNION ALL '.join(parts)}),
      b AS (SELECT * REPLACE (CASE WHEN isnan(min_value) THEN NULL ELSE min_value END AS min_value, CASE WHEN isnan(max_value) THEN NULL ELSE max_value END AS max_value) FROM column_baseline),
      prof AS (SELECT load_id, column_name, count(*) AS n_rows,
        count(*) FILTER (num IS NULL AND txt IS NULL) AS n_missing, count(*) FILTER (num IS NOT NULL OR txt IS NOT NULL) AS n_values,
        count(DISTINCT num) + count(DISTINCT txt) AS n_distinct, min(num) AS min_value, max(num) AS max_value, min(txt) AS min_text, max(txt) AS max_text,
        CASE WHEN any_value(b.pattern) IS NOT NULL THEN count(*) FILTER (NOT regexp_full_match(txt, b.pattern)) END AS n_off_pattern,
        CASE WHEN any_value(b.min_value) IS NOT NULL THEN count(*) FILTER (num < b.min_value OR num > b.max_value) END AS n_out_of_range,
        {', '.join(f'CASE WHEN any_value(b.{q}) IS NOT NULL AND NOT isnan(any_value(b.{q})) THEN count(*) FILTER (num <= b.{q}) END AS n_le_{q}' for q in ('p10', 'p50', 'p90'))}
        FROM long LEFT JOIN b USING (column_name) GROUP BY load_id, column_name)"""


_THREE = _long(["TransactionAmt", "D1"], ["DeviceInfo"])
_PLACE = f"'#' || CAST(len(list_filter({list(EDGES)}, lambda e: e <= num)) AS VARCHAR)"
ORACLE = {
    "p6_profile": f"{_long(NUMBERS, TEXTS)} SELECT * FROM prof",
    "p6_found": f"""{_THREE}, f AS (SELECT p.load_id, p.column_name, unnest([
        CASE WHEN abs(n_missing / n_rows - b.null_share) > 0.1503 THEN 'null_share' END,
        CASE WHEN n_values >= 10 AND n_distinct = 1 THEN 'constant' END,
        CASE WHEN n_off_pattern > 0 THEN 'pattern' END, CASE WHEN n_out_of_range > 0 THEN 'out_of_range' END,
        CASE WHEN abs(n_le_p10 / nullif(n_values, 0) - 0.1) > 0.2003 OR abs(n_le_p50 / nullif(n_values, 0) - 0.5) > 0.2003 OR abs(n_le_p90 / nullif(n_values, 0) - 0.9) > 0.2003 THEN 'drift' END]) AS finding
        FROM prof p JOIN b USING (column_name))
      SELECT load_id, column_name, finding FROM f WHERE finding IS NOT NULL""",
    "p6_drift": f"""{_THREE}, bins AS (SELECT load_id, column_name, CASE WHEN num IS NOT NULL THEN {_PLACE} ELSE '=' || txt END AS bin, count(*) AS n
        FROM long WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL),
      tot AS (SELECT load_id, column_name, sum(n) AS s, lag(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS prev, lag(sum(n)) OVER (PARTITION BY column_name ORDER BY load_id) AS ps FROM bins GROUP BY 1, 2),
      pair AS (SELECT t.load_id, t.column_name, x.bin, any_value(t.s) AS s, any_value(t.ps) AS ps, sum(CASE WHEN x.load_id = t.load_id THEN n ELSE 0 END) AS n, sum(CASE WHEN x.load_id = t.prev THEN n ELSE 0 END) AS was
        FROM tot t JOIN bins x ON x.column_name = t.column_name AND x.load_id IN (t.load_id, t.prev) WHERE t.prev IS NOT NULL GROUP BY 1, 2, 3),
      sh AS (SELECT *, greatest(n / s, 1e-6) AS a, greatest(was / ps, 1e-6) AS e FROM pair),
      d AS (SELECT load_id, column_name, count(*) AS n_bins, round(sum((a - e) * ln(a / e)), 6) AS psi_before, round(sum((a - e) * (a - e) / e * s), 6) AS chi2_before FROM sh GROUP BY 1, 2),
      q AS (SELECT load_id, column_name, greatest(n_le_p10 / n_values, 1e-6) AS a, greatest((n_le_p50 - n_le_p10) / n_values, 1e-6) AS c, greatest((n_le_p90 - n_le_p50) / n_values, 1e-6) AS f, greatest((n_values - n_le_p90) / n_values, 1e-6) AS g FROM prof WHERE n_le_p10 IS NOT NULL AND n_values > 0),
      r AS (SELECT load_id, column_name, round((a - 0.1) * ln(a / 0.1) + (c - 0.4) * ln(c / 0.4) + (f - 0.4) * ln(f / 0.4) + (g - 0.1) * ln(g / 0.1), 6) AS psi_baseline FROM q)
      SELECT load_id, column_name, n_bins, psi_before, chi2_before, psi_baseline FROM d FULL JOIN r USING (load_id, column_name)""",
    "p6_drift_all": f"""{_long(NUMBERS, TEXTS)}, bins AS (SELECT load_id, column_name, CASE WHEN num IS NOT NULL THEN {_PLACE} ELSE '=' || txt END AS bin, count(*) AS n
        FROM long WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL),
      tot AS (SELECT load_id, column_name, n_values AS s, lag(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS prev, lag(n_values) OVER (PARTITION BY column_name ORDER BY load_id) AS ps FROM prof),
      pair AS (SELECT t.load_id, t.column_name, x.bin, any_value(t.prev) AS prev, any_value(t.s) AS s, any_value(t.ps) AS ps, sum(CASE WHEN x.load_id = t.load_id THEN n ELSE 0 END) AS n, sum(CASE WHEN x.load_id = t.prev THEN n ELSE 0 END) AS was
        FROM tot t LEFT JOIN bins x ON x.column_name = t.column_name AND x.load_id IN (t.load_id, t.prev) WHERE t.prev IS NOT NULL GROUP BY 1, 2, 3),
      sh AS (SELECT *, greatest(coalesce(n / nullif(s, 0), 0), 1e-6) AS a, greatest(coalesce(was / nullif(ps, 0), 0), 1e-6) AS e FROM pair),
      d AS (SELECT load_id, column_name, any_value(prev) AS load_before, any_value(s) AS n_values, any_value(ps) AS n_values_before, count(bin) AS n_bins, round(sum((a - e) * ln(a / e)), 6) AS psi_before, round(sum((a - e) * (a - e) / e * s), 6) AS chi2_before FROM sh GROUP BY 1, 2),
      q AS (SELECT load_id, column_name, greatest(n_le_p10 / n_values, 1e-6) AS a, greatest((n_le_p50 - n_le_p10) / n_values, 1e-6) AS c, greatest((n_le_p90 - n_le_p50) / n_values, 1e-6) AS f, greatest((n_values - n_le_p90) / n_values, 1e-6) AS g FROM prof WHERE n_le_p10 IS NOT NULL AND n_values > 0),
      r AS (SELECT load_id, column_name, round((a - 0.1) * ln(a / 0.1) + (c - 0.4) * ln(c / 0.4) + (f - 0.4) * ln(f / 0.4) + (g - 0.1) * ln(g / 0.1), 6) AS psi_baseline FROM q)
      SELECT load_id, column_name, load_before, n_values, n_values_before, n_bins, psi_before, chi2_before, psi_baseline FROM d FULL JOIN r USING (load_id, column_name)""",
}
