"""Ranking metrics. Rows are first added up by distinct score; ties in a score count as the metric defines."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.ordering import running_totals
from sedimenta.session import cut_lineage


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores from high to low with rows ``n`` and positives ``pos``, and both up to and including the score."""
    each = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return running_totals(each, [F.col(score).desc()], {"cum_n": F.col("n"), "cum_pos": F.col("pos")})


def hits_at(known: DataFrame, key: str, label: str, score: str, table: DataFrame, places: Sequence[int]) -> dict[int, int]:
    """Positives among the first rows, by score from high to low, for each of ``places``.

    The table of distinct scores says what lies above the score at which a
    place is reached. Only where that score has positives and others and the
    place falls among them, its rows are put in the order of ``key``.
    """
    passed = F.filter(F.array(*[F.lit(int(p)) for p in sorted(set(places))]), lambda p: (p > F.col("cum_n") - F.col("n")) & (p <= F.col("cum_n")))
    met = table.select(score, "n", "pos", "cum_n", "cum_pos", F.explode(passed).alias("place")).collect()
    hits, within = {}, []
    for r in met:
        first, above = r["place"] - (r["cum_n"] - r["n"]), r["cum_pos"] - r["pos"]
        hits[r["place"]] = above + (first if r["pos"] == r["n"] else r["pos"] if first == r["n"] else 0)
        if 0 < r["pos"] < r["n"] and first < r["n"]:
            within.append((r[score], r["n"], first, r["place"]))
    if within:
        sizes, starts, upto = {s: n for s, n, *_ in within}, {}, 0
        for s in sorted(sizes, reverse=True):
            starts[s], upto = upto, upto + sizes[s]
        cuts = sorted({starts[s] + first for s, _, first, _ in within})
        tied = known.where(F.col(score).isin(list(sizes))).select(key, label, score)
        ranked = running_totals(tied, [F.col(score).desc(), F.col(key).asc()], {"__place": F.lit(1)})
        below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("__place")))
        found = ranked.groupBy(score, below.alias("cut")).agg(F.sum(F.col(label).cast("long")).alias("pos")).collect()
        for s, _, first, place in within:
            hits[place] += sum(r["pos"] or 0 for r in found if r[score] == s and r["cut"] <= cuts.index(starts[s] + first))
    return hits


def evaluate(df: DataFrame, key: str, label: str, score: str, levels: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """One row: AUC (ties by half), KS, average precision, label rate, rows, and recall, precision and lift at each level.

    Of rows with the same score the smaller key ranks first. Without positives
    or without negatives, what would divide by them is NULL.
    """
    known = df.where(F.col(score).isNotNull()).select(key, label, score)
    n, positives = known.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    p, q = F.lit(float(positives)), F.lit(float(n - positives))
    neg, cum_neg = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    area = F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2))
    gap = F.max(F.try_divide(F.col("cum_pos"), p) - F.try_divide(cum_neg, q))
    ap = F.sum(F.try_divide(F.col("pos"), p) * F.col("cum_pos") / F.col("cum_n"))
    table = cut_lineage(score_table(known, label, score))
    row = table.agg(F.try_divide(area, p * q).alias("auc"), F.greatest(gap, F.lit(0.0)).alias("ks"), ap.alias("pr_auc"))
    row = row.select("*", F.try_divide(p, F.lit(float(n))).alias("rate"), F.lit(n).alias("n"))
    tops = {k: max(1, math.ceil(n * k)) for k in levels}
    caught = hits_at(known, key, label, score, table, list(tops.values())) if n and tops else {}
    for k, t in tops.items():
        name, hits = percent_name(k), F.lit(float(caught.get(t, 0)))
        row = row.withColumns({f"recall_at_{name}": F.try_divide(hits, p), f"precision_at_{name}": hits / t, f"lift_at_{name}": F.try_divide(hits / t, F.try_divide(p, F.lit(float(n))))})
    return row


def percent_name(share: float) -> str:
    """A share in column names: 0.05 is 5pct, 0.004 is 0.4pct."""
    return f"{100 * share:g}pct"


def gain_table(df: DataFrame, key: str, label: str, score: str, n_points: int = 100) -> DataFrame:
    """Recall, precision and lift at evenly spaced review rates; lift is recall over the rate itself."""
    known = df.where(F.col(score).isNotNull()).select(key, label, score)
    n, positives = known.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    spine = [((i + 1) / n_points, max(1, int((i + 1) / n_points * n))) for i in range(n_points)]
    upto = hits_at(known, key, label, score, cut_lineage(score_table(known, label, score)), [c for _, c in spine]) if n else {}
    rows = [(f, c, upto[c] / positives if positives else None, upto[c] / c, upto[c] / positives / f if positives else None) for f, c in spine if n]
    return df.sparkSession.createDataFrame(rows, "review_rate double, n_reviewed long, recall double, precision double, lift double")


def metrics_line(metrics: Mapping[str, float]) -> str:
    """Metrics of one model in one line: names and values to four digits, missing ones as a dash."""
    return " | ".join(f"{name} {'-' if value is None else f'{value:.4f}' if isinstance(value, float) else value}" for name, value in metrics.items())
