"""Report tables: importance, chosen entities, subgraphs, experiment log."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators.profiling import unpivot
from sedimenta.sources.tables import bounded


def feature_group(name: Column) -> Column:
    """The group of a feature by its name, the first pattern that fits."""
    return (
        F.when(name.startswith("graph_"), "graph").when(name.startswith("uid_"), "uid").when(name.rlike(r"\AC[0-9]+\z"), "C")
        .when(name.startswith("V"), "V").when(name.rlike(r"\AD[0-9]+\z"), "D").otherwise("other")
    )


def importance_table(values: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution of each feature, its group and its place (1 is most; ties by name)."""
    parts = [x for f in features for x in (F.lit(f), F.abs(F.col(f).cast("double")))]
    long = values.select(F.stack(F.lit(len(features)), *parts).alias("feature", "v"))
    means = long.groupBy("feature").agg(F.avg("v").alias("mean_abs"))
    place = F.row_number().over(Window.orderBy(F.col("mean_abs").desc_nulls_last(), "feature"))  # one row per feature
    return means.select("feature", "mean_abs", feature_group(F.col("feature")).alias("feature_group"), place.alias("place")).orderBy("place")


def group_summary(table: DataFrame) -> DataFrame:
    """Features, total, mean, largest and share of each group."""
    each = table.groupBy("feature_group").agg(F.count("*").alias("n"), F.sum("mean_abs").alias("total"), F.avg("mean_abs").alias("mean"), F.max("mean_abs").alias("largest"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per group
    return each.withColumn("pct_of_total", F.try_divide(F.col("total"), F.sum("total").over(every))).orderBy(F.col("total").desc(), "feature_group")


def drop_feature(table: DataFrame, feature: str, beside: str, least_ratio: float = 0.2, most_place: int = 50) -> DataFrame:
    """One row: whether ``feature`` goes, because it weighs too little beside another or ranks too low; it stays if absent."""
    f = F.max(F.when(F.col("feature") == feature, F.col("mean_abs")))
    b = F.max(F.when(F.col("feature") == beside, F.col("mean_abs")))
    place = F.max(F.when(F.col("feature") == feature, F.col("place")))
    ratio = F.coalesce(F.try_divide(f, b), F.lit(0.0))
    return table.agg(f.alias("weight"), place.alias("place"), ratio.alias("ratio"), F.coalesce(f.isNotNull() & ((ratio < least_ratio) | (place > most_place)), F.lit(False)).alias("dropped"))


def keep_last(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("__i", last).where("__i = 1").drop("__i")


def chosen_entities(df: DataFrame, columns: Sequence[str], label: str, least: int = 6, most: int = 60, high: int = 6, low: int = 3) -> DataFrame:
    """Values of each column with ``least`` to ``most`` rows: the ``high`` ones of highest label rate, and the first ``low`` ones of rate 0; ties by value."""
    stats = unpivot(df, columns, [label]).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    fit = stats.where(F.col("n").between(least, most))

    def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
        return rows.withColumn("__i", F.row_number().over(Window.partitionBy("column_name").orderBy(*order))).where(F.col("__i") <= k).drop("__i")

    return top(fit, [F.col("rate").desc(), F.col("value")], high).union(top(fit.where("rate = 0"), [F.col("value")], low)).distinct()


def subgraph_edges(df: DataFrame, key: str, chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``anchor``, ``tx`` and ``node``: each chosen value with its rows, and the other values that several of them share."""
    long = unpivot(df, columns, [key]).where(F.col("value").isNotNull())
    anchors = long.join(bounded(chosen.select("column_name", "value")), ["column_name", "value"])
    anchors = anchors.select(F.concat_ws("=", "column_name", "value").alias("anchor"), F.col("column_name").alias("anchor_column"), key)
    others = long.join(anchors, key).where(F.col("column_name") != F.col("anchor_column")).select("anchor", key, F.concat_ws("=", "column_name", "value").alias("node"))
    shared = others.groupBy("anchor", "node").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "node")
    hubs = anchors.select("anchor", key, F.col("anchor").alias("node"))
    return hubs.unionByName(others.join(shared, ["anchor", "node"]).select("anchor", key, "node")).withColumnRenamed(key, "tx")


def subgraph_documents(df: DataFrame, key: str, label: str, amount: str, edges: DataFrame) -> DataFrame:
    """One document per anchor: counts, ``place`` by label rate from high to low (ties by anchor), and nodes and edges as arrays; a subgraph has at most as many transactions as chosen for."""
    rows = df.select(F.col(key).alias("tx"), label, amount)
    e = edges.join(rows, "tx")
    tx_name = F.concat(F.lit("tx"), F.col("tx").cast("string"))
    tx_nodes = e.groupBy("anchor", "tx").agg(F.count("*").alias("degree"), F.first(label).alias("fraud"), F.first(amount).alias("amount"))
    tx_nodes = tx_nodes.select("anchor", tx_name.alias("id"), F.lit("transaction").alias("kind"), "degree", "fraud", F.bround("amount", 2).alias("amount"), F.lit(None).cast("string").alias("label"))
    at_nodes = e.groupBy("anchor", "node").agg(F.count("*").alias("degree"))
    at_nodes = at_nodes.select("anchor", F.col("node").alias("id"), F.lit("attribute").alias("kind"), "degree", F.lit(None).cast("long").alias("fraud"), F.lit(None).cast("double").alias("amount"), F.substring(F.regexp_replace("node", r"\A[^=]*=", ""), 1, 24).alias("label"))
    nodes = tx_nodes.unionByName(at_nodes).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "degree", "fraud", "amount", "label"))).alias("nodes"))
    links = e.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(tx_name.alias("source"), F.col("node").alias("target")))).alias("edges"))
    hubs = e.where(F.col("node") == F.col("anchor")).groupBy("anchor").agg(F.count("*").alias("n_transactions"), F.sum(label).alias("n_fraud"), F.avg(label).alias("fraud_rate"))
    place = F.row_number().over(Window.orderBy(F.col("fraud_rate").desc(), "anchor"))  # as many rows as were chosen
    return hubs.withColumn("place", place).join(nodes, "anchor").join(links, "anchor")


def spring_layout(documents: DataFrame, rounds: int = 60, seed: int = 42) -> DataFrame:
    """``anchor``, ``id``, ``x`` and ``y`` of every node of the subgraphs, in a square around 0.

    Forces as Fruchterman and Reingold (1991) have them: linked nodes attract,
    all repel, steps get smaller. One subgraph is one row and has as many nodes
    as a document may hold, so each is laid out by itself; the start is seeded.
    """

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for anchor, ids, ends in zip(frame["anchor"], frame["ids"], frame["ends"]):
                at = {x: i for i, x in enumerate(ids)}
                links = np.array([(at[a], at[b]) for a, b in (e.split("\t") for e in ends)], dtype=int).reshape(-1, 2)
                spots, ideal = np.random.default_rng(seed).uniform(-1, 1, (len(at), 2)), 1 / max(1.0, len(at)) ** 0.5
                for step in np.linspace(0.2, 0.002, rounds):
                    gap = spots[:, None] - spots[None]
                    far = np.maximum(np.linalg.norm(gap, axis=2), 1e-6)
                    move = (gap * (ideal**2 / far**2)[..., None]).sum(axis=1)
                    pull = (spots[links[:, 0]] - spots[links[:, 1]]) * (far[links[:, 0], links[:, 1]] / ideal)[:, None]
                    np.add.at(move, links[:, 0], -pull)
                    np.add.at(move, links[:, 1], pull)
                    spots = spots + move * (np.minimum(step, np.linalg.norm(move, axis=1)) / np.maximum(np.linalg.norm(move, axis=1), 1e-9))[:, None]
                spots = spots - spots.mean(axis=0)
                spots = spots / max(1e-9, np.abs(spots).max())
                yield pd.DataFrame({"anchor": anchor, "id": list(at), "x": spots[:, 0], "y": spots[:, 1]})

    flat = documents.select("anchor", F.col("nodes.id").alias("ids"), F.transform("edges", lambda e: F.concat_ws("\t", e["source"], e["target"])).alias("ends"))
    return flat.mapInPandas(place, "anchor string, id string, x double, y double")


def as_json(df: DataFrame, column: str = "document", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and each row as one compact JSON text, NULL written as null."""
    return df.select(*keep, F.to_json(F.struct(*[c for c in df.columns if c not in keep]), {"ignoreNullFields": "false"}).alias(column))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same each time: those with the smallest MD5 of key and seed, ties by key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary")), key).limit(n)


def stratified_sample(df: DataFrame, key: str, label: str, most: int = 20_000, seed: int = 42) -> DataFrame:
    """All positives and a sample of the others up to ``most`` rows together, with ``weight``: how many rows a row stands for."""
    good = df.where(F.col(label) == 0)
    n_good, n_bad = good.count(), df.where(F.col(label) == 1).count()
    n = max(0, min(n_good, most - n_bad))
    weight = n_good / n if n else 0.0
    return df.where(F.col(label) == 1).withColumn("weight", F.lit(1.0)).unionByName(hash_sample(good, key, n, seed).withColumn("weight", F.lit(weight)))


def parameter_hash(parameters: Mapping) -> str:
    """Eight hex digits that depend on the parameters and not on their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:8]


def log_experiment(
    spark: SparkSession, path: str, name: str, feature_set: str, parameters: Mapping, val: Mapping[str, float], test: Mapping[str, float] | None = None,
    n_features: int | None = None, trees: int | None = None, positive_weight: float | None = None, notes: str = "",
) -> DataFrame:
    """Appends one experiment to a folder of CSV files and gives back the whole log.

    Metrics get the prefixes ``val_`` and ``test_``; the row has the time in
    UTC and a hash of the parameters. Each experiment is a file with its own
    header, so columns may be new and none is written again; the log is their
    union by name, and a column that a file lacks is NULL there.
    """
    row = {"timestamp": datetime.now(timezone.utc).isoformat(timespec="milliseconds"), "name": name, "feature_set": feature_set, "param_hash": parameter_hash(parameters)}
    row |= {"n_features": n_features, "trees": trees, "positive_weight": positive_weight, "notes": notes}
    row |= {f"{period}_{k}": None if v is None else float(v) for period, found in (("val", val), ("test", test or {})) for k, v in found.items()}
    kinds = ", ".join(f"`{k}` {_log_kind(k)}" for k in row)
    spark.createDataFrame([tuple(row.values())], kinds).coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(f"{path}/{row['param_hash']}-{uuid.uuid4().hex}")
    return read_log(spark, path)


def _log_kind(column: str) -> str:
    return "long" if column in ("n_features", "trees") else "double" if column == "positive_weight" or column.startswith(("val_", "test_")) else "string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; one file an experiment, so as many scans as there are kinds of header."""
    files = [f.getPath().toString() for f in _listed(spark, path)]
    headers: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        headers.setdefault(tuple(spark.read.option("header", True).csv(f).columns), []).append(f)
    made = [spark.read.schema(", ".join(f"`{c}` {_log_kind(c)}" for c in columns)).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(fs) for columns, fs in headers.items()]
    return union_logs(made)


def _listed(spark: SparkSession, path: str) -> list:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder), key=lambda f: f.getPath().toString())


def tested_experiments(log: DataFrame) -> DataFrame:
    """The last experiment of each name among those that were judged on the test period."""
    return keep_last(log.where(F.col("test_auc").isNotNull()), "name", [F.col("timestamp")])


def union_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """Logs one below the other; a column that one lacks is NULL there."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out
