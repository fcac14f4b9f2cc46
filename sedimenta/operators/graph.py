"""The bipartite graph of transactions and attribute values, as a table of edges.

An edge is (``tx``, ``node_col``, ``node_val``); a node is a column and a value,
so equal values of different columns are different nodes. Sums over neighbours
are two aggregations, edges to nodes and nodes back to transactions, and never
a join of transactions with transactions. Edges meet figures of all nodes by a
checked broadcast or a skew join; sums over neighbours are taken of capped
nodes, whose edges are few by the cap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.profiling import as_text, unpivot
from sedimenta.operators.skew import lookup, lookup_columns

NODE = ["node_col", "node_val"]


def edges(df: DataFrame, key: str, node_columns: Sequence[str]) -> DataFrame:
    """One edge for each row and column with a value; a missing value makes no node. Keys should be unique."""
    long = unpivot(df.withColumnRenamed(key, "tx"), node_columns, ["tx"])
    return long.where(F.col("value").isNotNull()).withColumnsRenamed({"column_name": "node_col", "value": "node_val"})


def node_degrees(e: DataFrame) -> DataFrame:
    """Transactions of each node."""
    return e.groupBy(*NODE).agg(F.count("*").alias("degree"))


def cap_degrees(e: DataFrame, most: int) -> DataFrame:
    """Edges of nodes with at most ``most`` transactions."""
    return lookup(e, node_degrees(e), NODE).where(F.col("degree") <= most).select(*e.columns)


def of_column(e: DataFrame, column: str) -> DataFrame:
    return e.where(F.col("node_col") == column)


def neighbour_sums(e: DataFrame, values: DataFrame, names: Sequence[str], less_own: bool = False) -> DataFrame:
    """Sums of each transaction's neighbours' values, weighted by the attributes they share, itself included.

    ``values`` has one row per ``tx``. With ``less_own`` a transaction's own
    part, its value times its attributes, is taken away. Transactions without
    edges have no row.
    """
    with_values = e.join(values.select("tx", *names), "tx")
    nodes = with_values.groupBy(*NODE).agg(*[F.sum(n).alias(f"__{n}") for n in names])
    back = with_values.join(nodes, NODE)
    return back.groupBy("tx").agg(*[F.sum(F.col(f"__{n}") - F.col(n) if less_own else F.col(f"__{n}")).alias(n) for n in names])


def project_attributes(e: DataFrame) -> DataFrame:
    """Pairs of nodes (``a`` < ``b``) and the transactions that have both, ``weight``.

    A transaction has one node per column, so it gives a handful of pairs.
    """
    node = F.concat_ws("=", *NODE)
    per_tx = e.groupBy("tx").agg(F.array_sort(F.collect_set(node)).alias("n"))
    firsts = per_tx.select("n", F.posexplode("n").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("n", F.col("i") + 2, F.greatest(F.size("n") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def degree_features(df: DataFrame, key: str, node_columns: Sequence[str]) -> DataFrame:
    """``graph_deg_{column}``: rows that share the row's value, itself included; 0 if missing. ``key`` is unique."""
    sizes = unpivot(df, node_columns).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    found = lookup_columns(df, key, {c: c for c in node_columns}, sizes, ["n"])
    return found.select(key, *[F.coalesce(f"n~{c}", F.lit(0)).alias(f"graph_deg_{c}") for c in node_columns])


def cross_cardinality(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``graph_n_unique_{b}_per_{a}``: distinct values of b among the rows with the row's value of a; NULL if a is missing. ``key`` is unique."""
    names = {f"graph_n_unique_{b}_per_{a}": a for a, b in pairs}
    parts = [x for (a, b), name in zip(pairs, names) for x in (F.lit(name), as_text(df, a), as_text(df, b))]
    both = df.select(F.stack(F.lit(len(pairs)), *parts).alias("column_name", "value", "other")).where(F.col("value").isNotNull()).distinct()
    found = lookup_columns(df, key, names, both.groupBy("column_name", "value").agg(F.count("other").alias("n")), ["n"])
    return found.select(key, *[F.col(f"n~{name}").alias(name) for name in names])


def neighbour_counts(e: DataFrame, keys: DataFrame) -> DataFrame:
    """Two-hop count, attributes and their ratio for every ``tx`` of ``keys``; 0 without edges."""
    joined = lookup(e, node_degrees(e), NODE)
    each = joined.groupBy("tx").agg(F.sum("degree").alias("t"), F.count("*").alias("k"))
    t, k = F.coalesce("t", F.lit(0)), F.coalesce("k", F.lit(0))
    return keys.select("tx").join(each, "tx", "left").select("tx", t.alias("graph_two_hop_count"), k.alias("graph_n_attributes"), F.coalesce(F.try_divide(t, k), F.lit(0.0)).alias("graph_avg_neighbors_per_attr"))


def attribute_entropy(e: DataFrame, keys: DataFrame) -> DataFrame:
    """Entropy of the sizes of a transaction's attributes; 0 without edges.

    With the total T of its degrees d: ln T - sum(d ln d) / T, one aggregation.
    """
    joined = lookup(e, node_degrees(e), NODE)
    each = joined.groupBy("tx").agg(F.sum("degree").alias("t"), F.sum(F.col("degree") * F.log("degree")).alias("s"))
    entropy = F.log("t") - F.col("s") / F.col("t")
    return keys.select("tx").join(each, "tx", "left").select("tx", F.coalesce(entropy, F.lit(0.0)).alias("graph_attr_entropy"))


def largest_of_attributes(e: DataFrame, keys: DataFrame, nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """Largest node value among each transaction's attributes; 0 if none."""
    each = lookup(e, nodes.select(*NODE, *values), NODE).groupBy("tx").agg(*[F.max(v).alias(v) for v in values])
    return keys.select("tx").join(each, "tx", "left").select("tx", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def client_key(parts: Sequence[Column], day: Column, since: Column) -> Column:
    """Parts and start day as one text, NULL if any is missing."""
    whole = [p.cast("string") for p in (*parts, day - since)]
    missing = whole[0].isNull()
    for p in whole[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws("_", *whole))


def client_activity(df: DataFrame, key: str, client: str, amount: str, day: str, device: str) -> DataFrame:
    """Size, amounts, devices, span and pace of each row's client, over all periods; NULL for rows without client."""
    rows = df.where(F.col(client).isNotNull())
    stats = rows.groupBy(client).agg(
        F.count("*").alias("uid_size"), F.avg(amount).alias("uid_amt_mean"), F.stddev_samp(amount).alias("uid_amt_std"), F.countDistinct(device).alias("uid_n_unique_device"), (F.max(day) - F.min(day)).alias("uid_span_days")
    )
    out = lookup(df.select(key, client, amount), stats, [client])
    return out.select(
        key, "uid_size", "uid_amt_mean", "uid_amt_std", "uid_n_unique_device", "uid_span_days",
        (F.col("uid_size") / (F.col("uid_span_days") + 1)).alias("uid_tx_per_day"), F.try_divide(F.col(amount), F.col("uid_amt_mean")).alias("uid_amt_ratio"),
    )
