"""Queries of the transaction-attribute graph and of label features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.operators import graph as G
from sedimenta.operators import graph_iterative as I
from sedimenta.operators import label_spread as L
from sedimenta.operators.metrics import evaluate
from sedimenta.operators.ranks import spearman
from sedimenta.plans.tabular import _TEXT, NODES, SPLIT_SQL, rounded, split_tx, tx
from sedimenta.plans.transactions import TX_SQL
from sedimenta.session import cut_lineage

# Most transactions of a node, and the pairs whose second column is counted per value of the first.
CAP = 5000
CROSS = [("DeviceInfo", "card1"), ("card1", "DeviceInfo"), ("card1", "P_emaildomain"), ("addr1", "card1")]
#: A cap that bites at every size of the test tables, for the query of the cap itself.
LOW_CAP = 20


def _edges(spark: SparkSession, sf_dir: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges, capped if asked for, and all keys; both written to the checkpoint folder, as the operators read them several times."""
    df = tx(spark, sf_dir, *NODES)
    e = cut_lineage(G.edges(df, "TransactionID", NODES))
    return (cut_lineage(G.cap_degrees(e, cap)) if cap else e), df.select(F.col("TransactionID").alias("tx"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "isFraud").withColumn("is_train", F.col("split") == "train")
    return cut_lineage(L.masked(df, "TransactionID", "isFraud", "is_train"))


def _clients(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = split_tx(spark, sf_dir, "card1", "addr1", "D1", *columns)
    parts = [F.col("card1"), D.whole(F.col("addr1"))]
    return df.withColumn("client", G.client_key(parts, F.col("tx_day"), D.whole(F.col("D1"))))


def q_g1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(tx(spark, sf_dir, *NODES), "TransactionID", NODES)


def q_a13_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_degrees(q_g1_edges(spark, sf_dir))


def q_p11_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left of each column after a cap of 20."""
    return _left(spark, sf_dir, LOW_CAP)


def q_p11_cap_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left of each column after the cap."""
    return _left(spark, sf_dir, CAP)


def _left(spark: SparkSession, sf_dir: str, cap: int) -> DataFrame:
    return G.cap_degrees(q_g1_edges(spark, sf_dir), cap).groupBy("node_col").agg(F.count("*").alias("n_edges"), F.countDistinct("node_val").alias("n_nodes"))


def q_a9_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_features(tx(spark, sf_dir, *NODES), "TransactionID", NODES)


def q_a10_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cross_cardinality(tx(spark, sf_dir, "card1", "addr1", "DeviceInfo", "P_emaildomain"), "TransactionID", CROSS)


def q_a11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.neighbour_counts(*_edges(spark, sf_dir, CAP)))


def q_a12_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.attribute_entropy(*_edges(spark, sf_dir)))


def q_j6_neighbour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total amount of the neighbours, itself included."""
    e, _ = _edges(spark, sf_dir, CAP)
    amounts = tx(spark, sf_dir, "TransactionAmt").select(F.col("TransactionID").alias("tx"), D.cents(F.col("TransactionAmt")).alias("cents"))
    return G.neighbour_sums(e, amounts, ["cents"])


def q_j7_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.project_attributes(_edges(spark, sf_dir, CAP)[0])


def q_a15_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, keys = _edges(spark, sf_dir, CAP)
    return G.largest_of_attributes(e, keys, G.node_degrees(e), ["degree"])


def q_p13_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clients(spark, sf_dir).select("TransactionID", "client")


def q_a14_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_activity(spark, sf_dir), 9)


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _clients(spark, sf_dir, "TransactionAmt", "DeviceInfo")
    return G.client_activity(df, "TransactionID", "client", "TransactionAmt", "tx_day", "DeviceInfo")


def q_g2_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until the ranks move less than 1e-8 together, 50 at most."""
    ranks = I.pagerank(*_edges(spark, sf_dir, CAP))
    return ranks.select("tx", F.round(F.col("rank") * 1e6, 4).alias("rank_millionths"))


def q_g3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.component_sizes(*_edges(spark, sf_dir, CAP))


def q_g5_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest core number among each transaction's attributes."""
    return _cores(*_edges(spark, sf_dir, CAP))


def _cores(e: DataFrame, keys: DataFrame) -> DataFrame:
    cores = I.core_numbers(G.project_attributes(e))
    nodes = e.select(*G.NODE).distinct().withColumn("node", F.concat_ws("=", *G.NODE)).join(cores, "node", "left").select(*G.NODE, F.coalesce("core", F.lit(0)).alias("graph_max_kcore"))
    return G.largest_of_attributes(e, keys, nodes, ["graph_max_kcore"])


def q_g4_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute nodes of the largest community among each transaction's attributes, and the community of its first one; a transaction without attributes is one of its own."""
    e, keys = _edges(spark, sf_dir, CAP)
    nodes = cut_lineage(_communities(e))
    return _community_sizes(e, keys, nodes).join(_community_of(e, keys, nodes), "tx")


def _community_of(e: DataFrame, keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tx`` and the ``community`` of its first attribute in the order of the columns; ``tx=`` and its key if it has none."""
    first = F.min_by("community", F.array_position(F.array(*[F.lit(c) for c in NODES]), F.col("node_col")))
    found = e.join(nodes, G.NODE).groupBy("tx").agg(first.alias("community"))
    return keys.select("tx").join(found, "tx", "left").select("tx", F.coalesce("community", F.concat(F.lit("tx="), F.col("tx").cast("string"))).alias("community"))


def _community_sizes(e: DataFrame, keys: DataFrame, nodes: DataFrame) -> DataFrame:
    sizes = nodes.groupBy("community").agg(F.count("*").alias("graph_community_size"))
    return G.largest_of_attributes(e, keys, nodes.join(sizes, "community"), ["graph_community_size"])


def _communities(e: DataFrame) -> DataFrame:
    found = I.louvain(G.project_attributes(e))
    named = e.select(*G.NODE).distinct().withColumn("node", F.concat_ws("=", *G.NODE))
    # a node without pairs is a community of its own
    return named.join(found, "node", "left").select(*G.NODE, F.coalesce("community", "node").alias("community"))


def q_l3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _edges(spark, sf_dir, CAP)
    return L.neighbour_label_stats(e, _values(spark, sf_dir))


def q_l4_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _edges(spark, sf_dir, CAP)
    return L.two_hop_label_stats(e, _values(spark, sf_dir))


def q_w1_client_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = _clients(spark, sf_dir).select(F.col("TransactionID").alias("tx"), "client")
    return L.group_label_stats(_values(spark, sf_dir), clients, "client")


def _label_features(spark: SparkSession, sf_dir: str, communities: bool = False) -> DataFrame:
    """The six label features; the community is the address, or one found in the graph."""
    e, keys = _edges(spark, sf_dir, CAP)
    df = _clients(spark, sf_dir)
    groups = _community_of(e, keys, cut_lineage(_communities(e))) if communities else df.select(F.col("TransactionID").alias("tx"), D.whole(F.col("addr1")).alias("community"))
    return L.label_features(e, _values(spark, sf_dir), groups, df.select(F.col("TransactionID").alias("tx"), "client"))


def q_l5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six label features, with the address as a given community."""
    return rounded(_label_features(spark, sf_dir))


def q_l5_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six label features with communities found in the graph."""
    return rounded(_label_features(spark, sf_dir, True))


def _structure(spark: SparkSession, sf_dir: str, e: DataFrame, capped: DataFrame, keys: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degrees, cross-cardinality and entropy of all nodes; counts, PageRank, components and cores of capped ones; client activity; sizes of communities, if given."""
    named = lambda df: df.withColumnRenamed("TransactionID", "tx")
    parts = [
        named(q_a9_degree(spark, sf_dir)), named(q_a10_cross(spark, sf_dir)), G.neighbour_counts(capped, keys), G.attribute_entropy(e, keys),
        I.pagerank(capped, keys).withColumnRenamed("rank", "graph_pagerank"), I.component_sizes(capped, keys), _cores(capped, keys), named(_activity(spark, sf_dir)),
    ]
    if nodes is not None:
        parts.append(_community_sizes(capped, keys, nodes))
    out = keys
    for part in parts:
        out = out.join(part, "tx")
    return out


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All edges, those of capped nodes, and all keys."""
    e, keys = _edges(spark, sf_dir)
    return e, cut_lineage(G.cap_degrees(e, CAP)), keys


def graph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structural and label features, with communities found in the graph once for both."""
    e, capped, keys = _graphs(spark, sf_dir)
    nodes = cut_lineage(_communities(capped))
    clients = _clients(spark, sf_dir).select(F.col("TransactionID").alias("tx"), "client")
    labels = L.label_features(capped, _values(spark, sf_dir), _community_of(capped, keys, nodes), clients)
    return _structure(spark, sf_dir, e, capped, keys, nodes).join(labels, "tx")


def q_l6_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural features together, all but the communities."""
    out = _structure(spark, sf_dir, *_graphs(spark, sf_dir))
    return rounded(out.withColumn("graph_pagerank", F.round(F.col("graph_pagerank") * 1e6, 4)))


def q_l6_with_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural features together."""
    e, capped, keys = _graphs(spark, sf_dir)
    return _structure(spark, sf_dir, e, capped, keys, cut_lineage(_communities(capped)))


COUNTERS = ["C1", "C2", "C5", "C13", "C14"]
RATES = ["graph_nb_fraud_rate_1hop", "graph_nb_fraud_rate_2hop", "graph_community_fraud_rate", "uid_fraud_rate"]


def q_a22_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of every rate among the label features with every stored counter, on training rows; the address is the community."""
    return _correlated(spark, sf_dir, cut_lineage(_label_features(spark, sf_dir)), RATES)


def q_a22_spearman_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with communities found in the graph."""
    return _correlated(spark, sf_dir, cut_lineage(_label_features(spark, sf_dir, True)), RATES)


def q_d8_counter_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the degrees of a transaction's values with every stored counter, on training rows."""
    f = q_a9_degree(spark, sf_dir).withColumnRenamed("TransactionID", "tx")
    return _correlated(spark, sf_dir, f, [f"graph_deg_{c}" for c in NODES]).withColumnRenamed("level3_feature", "degree_feature")


def _correlated(spark: SparkSession, sf_dir: str, f: DataFrame, features: list[str]) -> DataFrame:
    df = split_tx(spark, sf_dir, *COUNTERS).where("split = 'train'").withColumnRenamed("TransactionID", "tx").join(f, "tx")
    pairs = [(t, c) for t in features for c in COUNTERS]
    parts = [x for t, c in pairs for x in (F.lit(f"{t}~{c}"), F.round(F.col(t).cast("double"), 9), F.col(c))]
    long = df.select(F.stack(F.lit(len(pairs)), *parts).alias("pair", "x", "y"))
    made = spearman(long, "pair", "x", "y")
    return rounded(made.select(F.split_part("pair", F.lit("~"), F.lit(1)).alias("level3_feature"), F.split_part("pair", F.lit("~"), F.lit(2)).alias("c_feature"), "spearman"))


def q_d7_client_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each client with training rows, by those rows and by all: clients, both means, and clients that grow."""
    df = _clients(spark, sf_dir).where(F.col("client").isNotNull())
    each = df.groupBy("client").agg(F.count(F.when(F.col("split") == "train", 1)).alias("t"), F.count("*").alias("n")).where("t > 0")
    return rounded(each.agg(F.count("*").alias("n_clients"), F.avg("t").alias("mean_train"), F.avg("n").alias("mean_all"), F.count(F.when(F.col("n") > F.col("t"), 1)).alias("n_larger")))


def q_d2_client_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with several transactions, and those whose labels are all the same."""
    df = _clients(spark, sf_dir, "isFraud").where(F.col("client").isNotNull())
    each = df.groupBy("client").agg(F.count("*").alias("n"), F.min("isFraud").alias("a"), F.max("isFraud").alias("b")).where("n > 1")
    return each.agg(F.count("*").alias("n_clients"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("n_same"))


def q_d3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled neighbours in each split: mean, median, and rows without any."""
    e, _ = _edges(spark, sf_dir, CAP)
    lab = L.neighbour_label_stats(e, _values(spark, sf_dir)).join(split_tx(spark, sf_dir).select(F.col("TransactionID").alias("tx"), "split"), "tx")
    # counts of counts, so the median's buffer holds no rows
    counted = lab.groupBy("split", "lab").agg(F.count("*").alias("n"))
    return rounded(counted.groupBy("split").agg(
        F.sum("n").alias("n"), (F.sum(F.col("lab") * F.col("n")) / F.sum("n")).alias("mean_labelled"),
        F.percentile("lab", 0.5, F.col("n")).alias("median_labelled"), F.sum(F.when(F.col("lab") == 0, F.col("n")).otherwise(0)).alias("n_without"),
    ))


def q_d2_blind_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a labelled neighbour: their share of each period, and what the neighbours' rate ranks among them (AUC)."""
    e, _ = _edges(spark, sf_dir, CAP)
    values = _values(spark, sf_dir)
    prior = L.training_prior(values)
    stats = L.neighbour_label_stats(e, values).select("tx", "lab", F.round(D.smooth_rate(F.col("pos"), F.col("lab"), prior), 12).alias("rate"))
    df = cut_lineage(split_tx(spark, sf_dir, "isFraud").withColumnRenamed("TransactionID", "tx").join(stats, "tx").where("split <> 'gap'"))
    out = None
    for s in ("train", "val", "test"):
        part = df.where(F.col("split") == s)
        one = evaluate(part.where("lab > 0"), "tx", "isFraud", "rate", ()).select(F.lit(s).alias("split"), "auc", F.col("n").alias("n_seen"), F.lit(part.count()).alias("n"))
        out = one if out is None else out.unionByName(one)
    return rounded(out.withColumn("share_seen", F.col("n_seen") / F.col("n")))


QUERIES = {n: q for n, q in list(globals().items()) if n.startswith("q_") and q.__module__ == __name__}

_E = f"WITH RECURSIVE {TX_SQL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tx), e0 AS (" + " UNION ALL ".join(f"SELECT TransactionID AS tx, '{c}' AS node_col, {_TEXT.get(c, c)} AS node_val FROM tx WHERE {c} IS NOT NULL" for c in NODES) + "), deg AS (SELECT node_col, node_val, count(*) AS degree FROM e0 GROUP BY ALL)"


def _capped(cap: int | None) -> str:
    return f"{_E}, e AS (SELECT e0.*, degree FROM e0 JOIN deg USING (node_col, node_val) WHERE degree <= {cap or 1 << 60}), k AS (SELECT TransactionID AS tx FROM tx)"


_VALUES = ", v AS (SELECT TransactionID AS tx, CASE WHEN split = 'train' THEN isFraud::DOUBLE ELSE 0 END AS y, CASE WHEN split = 'train' THEN 1.0::DOUBLE ELSE 0 END AS m FROM s)"
_CLIENT = "CASE WHEN card1 IS NOT NULL AND addr1 IS NOT NULL AND D1 IS NOT NULL THEN card1 || '_' || CAST(addr1 AS BIGINT) || '_' || (tx_day - CAST(D1 AS BIGINT)) END"


def _hop(source: str, name: str) -> str:
    return f""", {name}n AS (SELECT node_col, node_val, sum(y) AS y, sum(m) AS m FROM e JOIN {source} USING (tx) GROUP BY ALL),
      {name} AS (SELECT e.tx, sum(n.y - o.y) AS y, sum(n.m - o.m) AS m FROM e JOIN {name}n n ON n.node_col = e.node_col AND n.node_val = e.node_val JOIN {source} o ON o.tx = e.tx GROUP BY e.tx)"""


def _stats(hop: str) -> str:
    return f"SELECT v.tx, greatest(coalesce({hop}.y, 0), 0) AS pos, greatest(coalesce({hop}.m, 0), 0) AS lab FROM v LEFT JOIN {hop} ON {hop}.tx = v.tx"


def _groups(key: str, name: str) -> str:
    return f""", {name}k AS (SELECT TransactionID AS tx, {key} AS g FROM s), {name}t AS (SELECT g, sum(y) AS y, sum(m) AS m FROM {name}k JOIN v USING (tx) WHERE g IS NOT NULL GROUP BY g),
      {name} AS (SELECT v.tx, greatest(coalesce(t.y - v.y, 0), 0) AS pos, greatest(coalesce(t.m - v.m, 0), 0) AS lab FROM v JOIN {name}k k2 ON k2.tx = v.tx LEFT JOIN {name}t t ON t.g = k2.g)"""


def _rate(t: str) -> str:
    return f"CASE WHEN {t}.lab = 0 THEN prior ELSE ({t}.pos + 20 * prior) / ({t}.lab + 20) END"


_LINKS = """, nd AS (SELECT DISTINCT node_col || '=' || node_val AS node FROM e), f AS (SELECT tx, node_col || '=' || node_val AS node FROM e)"""
_COMP = _LINKS + """, fi AS (SELECT tx, min(node) AS a FROM f GROUP BY tx), l AS (SELECT DISTINCT a, node AS b FROM fi JOIN f USING (tx) UNION SELECT node, a FROM fi JOIN f USING (tx) UNION SELECT node, node FROM nd),
  reach AS (SELECT 0 AS i, node, node AS low FROM nd UNION ALL SELECT i + 1, l.b, min(low) FROM reach JOIN l ON l.a = reach.node WHERE i < 60 GROUP BY i, l.b),
  root AS (SELECT node, low AS root FROM reach WHERE i = 60), tr AS (SELECT tx, root FROM fi JOIN root ON node = a), sz AS (SELECT root, (SELECT count(*) FROM tr WHERE tr.root = r.root) + count(*) AS z FROM root r GROUP BY root)"""
_COMPONENT = "SELECT k.tx, coalesce(z, 1) AS graph_component_size FROM k LEFT JOIN tr ON tr.tx = k.tx LEFT JOIN sz ON sz.root = tr.root"
_CORE = _LINKS + """, both_ AS (SELECT DISTINCT x.node AS u, y.node AS v FROM f x JOIN f y ON x.tx = y.tx AND x.node <> y.node),
  cr AS (SELECT 0 AS i, u, count(*) AS c FROM both_ GROUP BY u UNION ALL SELECT i + 1, u, max(least(c, place)) FROM
    (SELECT i, both_.u, c, row_number() OVER (PARTITION BY both_.u ORDER BY c DESC) AS place FROM cr JOIN both_ ON both_.v = cr.u WHERE i < 80) GROUP BY i, u), co AS (SELECT u AS node, c AS core FROM cr WHERE i = 80)"""
_CORES = "SELECT k.tx, coalesce(c, 0) AS graph_max_kcore FROM k LEFT JOIN (SELECT tx, max(coalesce(core, 0)) AS c FROM f LEFT JOIN co USING (node) GROUP BY tx) x ON x.tx = k.tx"
_RANK = """, n AS (SELECT count(*)::DOUBLE AS n FROM k), rk AS (SELECT tx, count(*) AS r FROM e GROUP BY tx), g AS (SELECT tx, node_col, node_val, 1.0::DOUBLE / r AS r, 1.0::DOUBLE / degree AS d FROM e JOIN rk USING (tx)),
  pg AS (SELECT 0 AS i, tx, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE AS step FROM k, n
    UNION ALL SELECT i, tx, rank, sum(abs(rank - was)) OVER () FROM (SELECT i, tx, was, base + (1 - sum(base) OVER ()) / n AS rank FROM (
      SELECT pg.i + 1 AS i, pg.tx, pg.rank AS was, n, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s, 0) AS base FROM pg CROSS JOIN n LEFT JOIN (
        SELECT g.tx, sum(m * g.d) AS s FROM g JOIN (SELECT node_col, node_val, sum(p.rank * g.r) AS m FROM pg p JOIN g ON g.tx = p.tx GROUP BY ALL) USING (node_col, node_val) GROUP BY g.tx) x ON x.tx = pg.tx
      WHERE pg.i < 50 AND pg.step >= 1e-8)))"""
_RANKS = "SELECT tx, round(rank * 1e6, 4) AS rank_millionths FROM pg WHERE i = (SELECT max(i) FROM pg)"


_FEATURES = f"""{_capped(CAP)}{_VALUES}{_hop('v', 'h1')}{_hop('h1', 'h2')}{_groups('CAST(addr1 AS BIGINT)', 'gc')}{_groups(_CLIENT, 'gu')}, s1 AS ({_stats('h1')}), s2 AS ({_stats('h2')}), pr AS (SELECT sum(y) / sum(m) AS prior FROM v),
  feat AS (SELECT s1.tx, {_rate('s1')} AS graph_nb_fraud_rate_1hop, s1.lab AS graph_nb_labeled_count, {_rate('s2')} AS graph_nb_fraud_rate_2hop, {_rate('gc')} AS graph_community_fraud_rate, {_rate('gu')} AS uid_fraud_rate, gu.lab AS uid_labeled_count
    FROM s1 JOIN s2 USING (tx) JOIN gc USING (tx) JOIN gu USING (tx), pr)"""


def _spearman(pairs: str, name: str) -> str:
    return f"""pr2 AS ({pairs}), rr AS (SELECT {name}, c_feature, rank() OVER (PARTITION BY {name}, c_feature ORDER BY x) + (count(*) OVER (PARTITION BY {name}, c_feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY {name}, c_feature ORDER BY y) + (count(*) OVER (PARTITION BY {name}, c_feature, y) - 1) / 2 AS ry FROM pr2)
        SELECT {name}, c_feature, round(CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END, 6) AS spearman FROM rr GROUP BY 1, 2"""


_RATE_PAIRS = " UNION ALL ".join(f"SELECT '{t}' AS level3_feature, '{c}' AS c_feature, round({t}, 9) AS x, {c} AS y FROM s JOIN feat ON feat.tx = s.TransactionID WHERE split = 'train' AND {c} IS NOT NULL AND NOT isnan({c})" for t in RATES for c in COUNTERS)
_DEGREE_PAIRS = " UNION ALL ".join(f"SELECT 'graph_deg_{t}' AS degree_feature, '{c}' AS c_feature, graph_deg_{t} AS x, {c} AS y FROM s JOIN dg USING (TransactionID) WHERE split = 'train' AND {c} IS NOT NULL AND NOT isnan({c})" for t in NODES for c in COUNTERS)
_DEGREES = "SELECT TransactionID, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY {c}) END AS graph_deg_{c}" for c in NODES) + " FROM tx"
_CROSS = "SELECT TransactionID, " + ", ".join(f"(CASE WHEN {a} IS NOT NULL THEN {a}_{b}.n END) AS graph_n_unique_{b}_per_{a}" for a, b in CROSS) + " FROM tx " + " ".join(f"LEFT JOIN (SELECT {a} AS g, count(DISTINCT {b}) AS n FROM tx GROUP BY 1) {a}_{b} ON {a}_{b}.g = tx.{a}" for a, b in CROSS)
_COUNTS = "a AS (SELECT tx, sum(degree)::BIGINT AS t, count(*) AS c FROM e GROUP BY tx)"
_COUNTED = "SELECT k.tx, coalesce(t, 0) AS graph_two_hop_count, coalesce(c, 0) AS graph_n_attributes, round(coalesce(t / c, 0), 6) AS graph_avg_neighbors_per_attr FROM k LEFT JOIN a ON a.tx = k.tx"
_ENTROPY = "a0 AS (SELECT e0.tx, sum(degree) AS t FROM e0 JOIN deg USING (node_col, node_val) GROUP BY e0.tx), h0 AS (SELECT e0.tx, -sum(degree / t * ln(degree / t)) AS h FROM e0 JOIN deg USING (node_col, node_val) JOIN a0 ON a0.tx = e0.tx GROUP BY e0.tx)"
_ENTROPIES = "SELECT k.tx, round(coalesce(h, 0), 6) + 0.0 AS graph_attr_entropy FROM k LEFT JOIN h0 ON h0.tx = k.tx"
_ACTIVITY = f"""c AS (SELECT *, {_CLIENT} AS client FROM tx), ca AS (SELECT client, count(*) AS n, avg(TransactionAmt) AS m, stddev_samp(TransactionAmt) AS d, count(DISTINCT DeviceInfo) AS u, max(tx_day) - min(tx_day) AS w FROM c WHERE client IS NOT NULL GROUP BY client)"""


def _active(digits: int) -> str:
    return f"SELECT TransactionID, n AS uid_size, round(m, {digits}) AS uid_amt_mean, round(d, {digits}) AS uid_amt_std, u AS uid_n_unique_device, w AS uid_span_days, round(n / (w + 1), {digits}) AS uid_tx_per_day, round(TransactionAmt / nullif(m, 0), {digits}) AS uid_amt_ratio FROM c LEFT JOIN ca ON ca.client = c.client"


ORACLE = {
    "q_g1_edges": f"{_E} SELECT tx, node_col, node_val FROM e0",
    "q_a13_degrees": f"{_E} SELECT * FROM deg",
    "q_p11_cap": f"{_capped(LOW_CAP)} SELECT node_col, count(*) AS n_edges, count(DISTINCT node_val) AS n_nodes FROM e GROUP BY 1",
    "q_p11_cap_5000": f"{_capped(CAP)} SELECT node_col, count(*) AS n_edges, count(DISTINCT node_val) AS n_nodes FROM e GROUP BY 1",
    "q_a9_degree": f"WITH {TX_SQL} {_DEGREES}",
    "q_a10_cross": f"WITH {TX_SQL} {_CROSS}",
    "q_a11_counts": f"{_capped(CAP)}, {_COUNTS} {_COUNTED}",
    "q_a12_entropy": f"{_capped(None)}, {_ENTROPY} {_ENTROPIES}",
    "q_j6_neighbour_sum": f"{_capped(CAP)}, nn AS (SELECT node_col, node_val, sum(cents) AS c FROM e JOIN tx ON tx.TransactionID = e.tx GROUP BY ALL) SELECT e.tx, sum(c)::BIGINT AS cents FROM e JOIN nn USING (node_col, node_val) GROUP BY e.tx",
    "q_j7_projection": f"{_capped(CAP)}, f AS (SELECT tx, node_col || '=' || node_val AS node FROM e) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM f x JOIN f y ON x.tx = y.tx AND x.node < y.node GROUP BY 1, 2",
    "q_a15_largest": f"{_capped(CAP)}, a AS (SELECT tx, max(degree) AS d FROM e GROUP BY tx) SELECT k.tx, coalesce(d, 0) AS degree FROM k LEFT JOIN a ON a.tx = k.tx",
    "q_p13_client": f"WITH {TX_SQL} SELECT TransactionID, {_CLIENT} AS client FROM tx",
    "q_a14_activity": f"WITH {TX_SQL}, {_ACTIVITY} {_active(9)}",
    "q_g2_pagerank": f"{_capped(CAP)}{_RANK} {_RANKS}",
    "q_g3_components": f"{_capped(CAP)}{_COMP} {_COMPONENT}",
    "q_g5_cores": f"{_capped(CAP)}{_CORE} {_CORES}",
    "q_l3_neighbours": f"{_capped(CAP)}{_VALUES}{_hop('v', 'h1')} {_stats('h1')}",
    "q_l4_two_hop": f"{_capped(CAP)}{_VALUES}{_hop('v', 'h1')}{_hop('h1', 'h2')} {_stats('h2')}",
    "q_w1_client_labels": f"WITH {TX_SQL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tx){_VALUES}{_groups(_CLIENT, 'gu')} SELECT tx, pos, lab FROM gu",
    "q_l5_features": f"{_FEATURES} SELECT tx, round(graph_nb_fraud_rate_1hop, 6) AS graph_nb_fraud_rate_1hop, graph_nb_labeled_count, round(graph_nb_fraud_rate_2hop, 6) AS graph_nb_fraud_rate_2hop, round(graph_community_fraud_rate, 6) AS graph_community_fraud_rate, round(uid_fraud_rate, 6) AS uid_fraud_rate, uid_labeled_count FROM feat",
    "q_a22_spearman": f"{_FEATURES}, {_spearman(_RATE_PAIRS, 'level3_feature')}",
    "q_d8_counter_degrees": f"WITH {TX_SQL}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tx), dg AS ({_DEGREES}), {_spearman(_DEGREE_PAIRS, 'degree_feature')}",
    "q_d2_client_labels": f"WITH {TX_SQL}, c AS (SELECT {_CLIENT} AS client, isFraud FROM tx), g AS (SELECT client, min(isFraud) AS a, max(isFraud) AS b FROM c WHERE client IS NOT NULL GROUP BY client HAVING count(*) > 1) SELECT count(*) AS n_clients, count(*) FILTER (a = b) AS n_same FROM g",
    "q_d3_evidence": f"{_capped(CAP)}{_VALUES}{_hop('v', 'h1')}, st AS ({_stats('h1')}) SELECT split, count(*) AS n, round(avg(lab), 6) AS mean_labelled, round(quantile_cont(lab, 0.5)::DOUBLE, 6) AS median_labelled, count(*) FILTER (lab = 0) AS n_without FROM st JOIN s ON s.TransactionID = st.tx GROUP BY split",
    "q_d2_blind_auc": f"""{_capped(CAP)}{_VALUES}{_hop('v', 'h1')}, st AS ({_stats('h1')}), pr AS (SELECT sum(y) / sum(m) AS prior FROM v), r AS (SELECT split, isFraud, lab, round({_rate('st')}, 12) AS x FROM st JOIN s ON s.TransactionID = st.tx, pr WHERE split <> 'gap'),
        d AS (SELECT split, x, count(*) AS n, sum(isFraud) AS pos FROM r WHERE lab > 0 GROUP BY ALL), c AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY x DESC) AS cp, sum(n) OVER (PARTITION BY split) AS tn, sum(pos) OVER (PARTITION BY split) AS tp FROM d)
        SELECT c.split, round(sum((c.n - pos) * (cp - pos / 2)) / nullif(any_value(tp::DOUBLE * (tn - tp)), 0), 6) AS auc, any_value(tn)::BIGINT AS n_seen, any_value(a.n) AS n, round(any_value(tn / a.n), 6) AS share_seen
        FROM c JOIN (SELECT split, count(*) AS n FROM r GROUP BY 1) a ON a.split = c.split GROUP BY 1""",
    "q_d7_client_sizes": f"""WITH {TX_SQL}, c AS (SELECT {_CLIENT} AS client, {SPLIT_SQL} AS split FROM tx), g AS (SELECT count(*) FILTER (split = 'train') AS t, count(*) AS n FROM c WHERE client IS NOT NULL GROUP BY client HAVING count(*) FILTER (split = 'train') > 0)
        SELECT count(*) AS n_clients, round(avg(t), 6) AS mean_train, round(avg(n), 6) AS mean_all, count(*) FILTER (n > t) AS n_larger FROM g""",
    "q_l6_structure": f"""{_capped(CAP)}, dg AS ({_DEGREES}), cx AS ({_CROSS}), {_COUNTS}, ct AS ({_COUNTED}), {_ENTROPY}, en AS ({_ENTROPIES}){_RANK}, ra AS ({_RANKS}){_COMP}, sz2 AS ({_COMPONENT}){_CORE.replace(_LINKS, '')}, cs AS ({_CORES}), {_ACTIVITY}, ac AS ({_active(6)})
        SELECT dg.* RENAME (TransactionID AS tx), cx.* EXCLUDE (TransactionID), ct.* EXCLUDE (tx), en.* EXCLUDE (tx), rank_millionths AS graph_pagerank, sz2.* EXCLUDE (tx), cs.* EXCLUDE (tx), ac.* EXCLUDE (TransactionID)
        FROM dg JOIN cx ON cx.TransactionID = dg.TransactionID JOIN ct ON ct.tx = dg.TransactionID JOIN en ON en.tx = dg.TransactionID JOIN ra ON ra.tx = dg.TransactionID JOIN sz2 ON sz2.tx = dg.TransactionID JOIN cs ON cs.tx = dg.TransactionID JOIN ac ON ac.TransactionID = dg.TransactionID""",
}
