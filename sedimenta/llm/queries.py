"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import domain as D
from sedimenta.llm.components import components
from sedimenta.llm.distinct import bits_for, estimates, merge_bitmaps, merge_sets, most_items, partial_bitmaps
from sedimenta.llm.mixing import Share, sample_mix, water_fill
from sedimenta.llm.splits import split_records
from sedimenta.llm.subjects import subject_posteriors, subjects_of
from sedimenta.llm.tokenizer import check_round_trip, count_tokens, encode_texts, vocabulary
from sedimenta.operators.skew import heavy_keys, skew_join
from sedimenta.operators.versions import latest_rows
from sedimenta.plans.transactions import TX_SQL, days, latest
from sedimenta.session import cut_lineage
from sedimenta.sources.tables import bounded, table

CLIENT = ["card", "addr", "start_day"]
#: Card mappings of more rows than this are joined by a shuffle.
MOST_CARDS = 200_000


# Problem 1


def _client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with the parts of their client: reissued cards under one number, address, start day."""
    stored = table(spark, sf_dir, "merged_train", ["TransactionID", "loaded_at", "card1", "addr1", "D1", "TransactionDT"])
    keyed = stored.select(
        "TransactionID",
        "loaded_at",
        "card1",
        D.present(F.col("addr1")).alias("addr"),
        (D.day_of(F.col("TransactionDT")) - D.present(F.col("D1"))).alias("start_day"),
    )
    same = components(table(spark, sf_dir, "card_reissues"), "old_card1", "new_card1").withColumnsRenamed({"node": "card1"})
    if same.limit(MOST_CARDS + 1).count() <= MOST_CARDS:
        joined = keyed.join(F.broadcast(same), "card1", "left")
    else:
        joined = skew_join(keyed, same, ["card1"], heavy_keys(keyed, ["card1"]), "left")
    return joined.select("TransactionID", "loaded_at", F.coalesce("root", "card1").alias("card"), "addr", "start_day")


def _with_first(keyed: DataFrame) -> DataFrame:
    """Each transaction once, with the smallest TransactionID and the number of transactions of its client; both NULL if a part is missing."""
    heavy = heavy_keys(keyed.select(*CLIENT).dropna(), CLIENT)
    tx = latest_rows(keyed, "TransactionID", "loaded_at", CLIENT)
    clients = tx.dropna(subset=CLIENT).groupBy(*CLIENT).agg(F.min("TransactionID").alias("first_id"), F.count("*").alias("n"))
    if not heavy.collect():
        return tx.join(clients, CLIENT, "left")
    return skew_join(tx, clients, CLIENT, heavy, "left")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of clients with two or more, beside the client's first."""
    return _with_first(_client_keys(spark, sf_dir)).where("n >= 2 and TransactionID <> first_id").select("first_id", "TransactionID")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _with_first(_client_keys(spark, sf_dir)).select("TransactionID", F.coalesce("first_id", "TransactionID").alias("first_id"))
    targets = [(r["split_name"], r["target_share"]) for r in table(spark, sf_dir, "split_targets").orderBy("split_name").collect()]
    return split_records(cut_lineage(grouped), "TransactionID", "first_id", targets)


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every transaction; a client's transactions share it."""
    return _split(spark, sf_dir).select("TransactionID", "first_id", "split_name")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions and share of each split beside its target."""
    counts = _split(spark, sf_dir).groupBy("split_name").agg(F.count("*").alias("n"))
    every = cut_lineage(counts)
    total = every.agg(F.sum("n")).first()[0] or 0
    shares = table(spark, sf_dir, "split_targets").join(every, "split_name", "left")
    n = F.coalesce("n", F.lit(0))
    return shares.select("split_name", "target_share", n.alias("n"), (n / max(1, total)).alias("share"))


# Problem 3

GROUPS = ["tx_day", "DeviceInfo", "ProductCD"]
SETS = [[g for i, g in enumerate(GROUPS) if k >> i & 1] for k in range(8)]
#: The stated error: one standard error, relative, for up to MOST_CARDS_A_GROUP distinct cards in one group.
ERROR, MOST_CARDS_A_GROUP = 0.01, 100_000_000
BITS = bits_for(ERROR, MOST_CARDS_A_GROUP)


def _bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = days(latest(spark, sf_dir, "card1", "DeviceInfo", "ProductCD", "TransactionDT", "load_id"))
    return partial_bitmaps(tx, ["load_id", *GROUPS], "card1", BITS)


def p3_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results per load: the words of each group's bitmap."""
    return _bitmaps(spark, sf_dir)


def p3_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cards of each day, DeviceInfo, ProductCD and combination of these, with the error."""
    made = estimates(merge_sets(_bitmaps(spark, sf_dir), SETS, GROUPS), ["level", *GROUPS], BITS)
    return made.withColumns({"n_distinct": F.round("n_distinct", 6), "error": F.round("error", 12)})


def _nearly_all(spark: SparkSession, sf_dir: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Transactions per product group, and the groups that may have 25 cards and nine tenths as many as rows; ``sure`` if their bitmap proves it."""
    tx = days(latest(spark, sf_dir, "card1", "DeviceInfo", "ProductCD", "TransactionDT")).where(F.col("DeviceInfo").isNotNull())
    words = partial_bitmaps(tx, ["DeviceInfo", "ProductCD", "tx_day"], "card1", bits)
    group = F.explode(F.array_compact(F.array(F.lit("all"), F.col("ProductCD")))).alias("product_group")
    keys = ["DeviceInfo", "product_group", "tx_day"]
    merged = merge_bitmaps(words.select("DeviceInfo", group, "tx_day", "word", "bits", "n"), keys)
    enough = lambda cards: (cards >= 25) & (10 * cards >= 9 * F.col("n_rows"))
    known = estimates(merged, keys, bits).withColumns({"sure": enough(F.col("bits_set")), "may": enough(most_items(bits))})
    return tx.select("DeviceInfo", group, "tx_day", "card1"), cut_lineage(known.where("may").select(*keys, "sure"))


def p3_found(spark: SparkSession, sf_dir: str, bits: int = BITS) -> DataFrame:
    """Devices that nearly every transaction of a day used another card with.

    The bitmaps decide every group whose bits prove the case and every group
    whose upper bound falls short of it; only groups between these bounds, and
    full bitmaps, are counted again.
    """
    rows, near = _nearly_all(spark, sf_dir, bits)
    keys = ["DeviceInfo", "product_group", "tx_day"]
    proven, between = near.where("sure").select(*keys), near.where("not sure").select(*keys)
    if between.isEmpty():
        return proven
    exact = rows.join(bounded(between, 100_000), keys).groupBy(*keys, "card1").agg(F.count("*").alias("n"))
    counts = exact.groupBy(*keys).agg(F.count("card1").alias("cards"), F.sum("n").alias("n"))
    return proven.unionByName(counts.where("cards >= 25 and 10 * cards >= 9 * n").select(*keys))


# Problem 7


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text", vocabulary(spark))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return check_round_trip(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text", vocabulary(spark))


# Problem 8


def _plan(spark: SparkSession, sf_dir: str, counted: DataFrame) -> list[Share]:
    targets = [tuple(r) for r in table(spark, sf_dir, "mix_targets", ["source", "target_share", "max_repeats"]).orderBy("source").collect()]
    sums = counted.where(F.col("source").isin([t[0] for t in targets])).groupBy("source").agg(F.sum("n_tokens")).collect()
    return water_fill(targets, {r[0]: r[1] for r in sums})


def _counted(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", ["text", *keep]), "text", keep, vocabulary(spark))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their target even at the cap."""
    plan = _plan(spark, sf_dir, _counted(spark, sf_dir, ["source"]))
    return spark.createDataFrame([(p.source,) for p in plan if p.short], "source string")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, and how often each occurs."""
    counted = cut_lineage(_counted(spark, sf_dir, ["doc_id", "source"]))
    return sample_mix(counted, "doc_id", "source", _plan(spark, sf_dir, counted)).select("doc_id", "source", "n_tokens", "repeats")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, planned and reached share of each source of mix_targets."""
    counted = cut_lineage(_counted(spark, sf_dir, ["doc_id", "source"]))
    plan = _plan(spark, sf_dir, counted)
    reached = {r[0]: r[1] for r in sample_mix(counted, "doc_id", "source", plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats"))).collect()}
    total, planned = max(1, sum(reached.values())), sum(p.planned for p in plan) or 1.0
    rows = [(p.source, p.target, p.most, p.tokens, p.short, p.planned / planned, reached.get(p.source, 0), reached.get(p.source, 0) / total) for p in plan]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats long, tokens long, short boolean, planned_share double, mixed_tokens long, mixed_share double")


# Problem 9


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in table(spark, sf_dir, "subjects", ["subject"]).distinct().orderBy("subject").collect()]
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return subject_posteriors(docs, "doc_id", "text", table(spark, sf_dir, "doc_subject_labels", ["doc_id", "subject"]), names)


def p9_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated posterior of each subject of each document, where there is evidence for it."""
    return _posteriors(spark, sf_dir).select("doc_id", "subject", "posterior")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document, two at most."""
    return subjects_of(_posteriors(spark, sf_dir), "doc_id")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about each subject and their share of the corpus."""
    n = max(1, table(spark, sf_dir, "documents", ["doc_id"]).count())
    found = subjects_of(_posteriors(spark, sf_dir), "doc_id").groupBy("subject").agg(F.count("*").alias("n"))
    every = table(spark, sf_dir, "subjects", ["subject"]).distinct().join(found, "subject", "left")
    count = F.coalesce("n", F.lit(0))
    return every.select("subject", count.alias("n"), (count / n).alias("share"))


QUERIES = {q.__name__: q for q in (p1_found, p1_splits, p1_shares, p3_found, p3_partials, p3_distinct, p7_ids, p7_round_trip, p8_found, p8_mix, p8_shares, p9_found, p9_posteriors, p9_composition)}

_BITMAP = f"""WITH {TX_SQL}, h AS (SELECT *, CAST('0x' || substr(md5(CAST(card1 AS VARCHAR)), 1, 15) AS BIGINT) % {BITS} AS place FROM tx),
  w AS (SELECT *, place // 64 AS word, CASE WHEN place % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (place % 64)::INTEGER END AS bit FROM h)"""
_LEVELS = " UNION ALL ".join(
    f"SELECT '{'+'.join(s) or 'all'}' AS level, {', '.join(g if g in s else f'CAST(NULL AS {k}) AS {g}' for g, k in zip(GROUPS, ('BIGINT', 'VARCHAR', 'VARCHAR')))}, count(*) AS n_rows, count(DISTINCT place) AS bits_set FROM w GROUP BY ALL" for s in SETS
)
ORACLE = {
    "p1_shares": f"""WITH {TX_SQL}, t AS (SELECT count(*) AS every FROM tx), r AS (SELECT *, row_number() OVER (ORDER BY target_share DESC, split_name DESC) AS place FROM split_targets),
      w AS (SELECT *, CASE WHEN place > 1 THEN CAST(round_even(every * target_share / sum(target_share) OVER (), 0) AS BIGINT) END AS want FROM r, t),
      c AS (SELECT *, CAST(coalesce(want, every - sum(want) OVER ()) AS BIGINT) AS n FROM w) SELECT split_name, target_share, n, n / every::DOUBLE AS share FROM c""",
    "p3_partials": f"{_BITMAP} SELECT load_id, tx_day, DeviceInfo, ProductCD, word, bit_or(bit) AS bits, count(*) AS n FROM w GROUP BY ALL",
    "p3_distinct": f"""{_BITMAP}, l AS ({_LEVELS}), e AS (SELECT *, -{BITS} * ln(greatest({BITS} - bits_set, 1) / {BITS}::DOUBLE) + 0.0 AS d FROM l)
      SELECT level, tx_day, DeviceInfo, ProductCD, n_rows, bits_set, round(d, 6) AS n_distinct, CASE WHEN bits_set < {BITS} AND d > 0 THEN round(sqrt(greatest(exp(d / {BITS}) - d / {BITS} - 1, 0)) / (d / {BITS} * sqrt({BITS})), 12) END AS error FROM e""",
    "p1_found": f"""WITH RECURSIVE {TX_SQL}, e AS (SELECT old_card1 AS a, new_card1 AS b FROM card_reissues WHERE old_card1 IS NOT NULL AND new_card1 IS NOT NULL
        UNION SELECT new_card1, old_card1 FROM card_reissues WHERE old_card1 IS NOT NULL AND new_card1 IS NOT NULL),
      reach AS (SELECT a AS node, a AS low FROM e UNION SELECT e.b, reach.low FROM reach JOIN e ON e.a = reach.node),
      root AS (SELECT node, min(low) AS root FROM reach GROUP BY node),
      k AS (SELECT TransactionID, coalesce(root, card1) AS card, addr1 AS addr, tx_day - D1 AS start_day FROM tx LEFT JOIN root ON node = card1),
      f AS (SELECT TransactionID, min(TransactionID) OVER (PARTITION BY card, addr, start_day) AS first_id FROM k WHERE card IS NOT NULL AND addr IS NOT NULL AND start_day IS NOT NULL)
      SELECT first_id, TransactionID FROM f WHERE first_id <> TransactionID""",
    "p3_found": f"""WITH {TX_SQL}, g AS (SELECT DeviceInfo, 'all' AS product_group, tx_day, card1 FROM tx WHERE DeviceInfo IS NOT NULL
        UNION ALL SELECT DeviceInfo, ProductCD, tx_day, card1 FROM tx WHERE DeviceInfo IS NOT NULL AND ProductCD IS NOT NULL)
      SELECT DeviceInfo, product_group, tx_day FROM g GROUP BY ALL HAVING count(DISTINCT card1) >= 25 AND 10 * count(DISTINCT card1) >= 9 * count(*)""",
}
