"""Label features of neighbours. Labels outside the mask are never read, and a row's own label never counts for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sedimenta.functions.domain import smooth_rate
from sedimenta.operators.graph import neighbour_sums
from sedimenta.operators.skew import lookup


def masked(df: DataFrame, key: str, label: str, mask: str) -> DataFrame:
    """``tx``, ``y`` (the label where the mask holds, else 0) and ``m``; TypeError unless the mask is boolean, an error for NULLs in it."""
    if not isinstance(df.schema[mask].dataType, BooleanType):
        raise TypeError(f"{mask} must be boolean")
    sure = F.coalesce(F.col(mask), F.raise_error(F.lit(f"{mask} has NULLs")).cast("boolean"))
    return df.select(F.col(key).alias("tx"), F.when(sure, F.col(label).cast("double")).otherwise(0.0).alias("y"), F.when(sure, 1.0).otherwise(0.0).alias("m"))


def training_prior(values: DataFrame) -> float:
    """Mean label within the mask; ValueError if the mask is empty."""
    y, m = values.agg(F.sum("y"), F.sum("m")).first()
    if not m:
        raise ValueError("the mask has no rows")
    return y / m


def neighbour_label_stats(e: DataFrame, values: DataFrame, leave_one_out: bool = True) -> DataFrame:
    """``pos`` and ``lab``: positive and labelled neighbours, weighted by shared attributes; 0 without edges."""
    sums = neighbour_sums(e, values, ["y", "m"], leave_one_out)
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    return values.select("tx").join(sums, "tx", "left").select("tx", zero("y").alias("pos"), zero("m").alias("lab"))


def two_hop_label_stats(e: DataFrame, values: DataFrame) -> DataFrame:
    """The same step taken twice; own parts are taken away in each, negative sums become 0 at the end only."""
    first = neighbour_sums(e, values, ["y", "m"], True)
    second = neighbour_sums(e, first, ["y", "m"], True)
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    return values.select("tx").join(second, "tx", "left").select("tx", zero("y").alias("pos"), zero("m").alias("lab"))


def group_label_stats(values: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """``pos`` and ``lab`` of the other rows of each row's group (``groups``: ``tx`` and ``group``); 0 if the group is NULL."""
    rows = values.join(groups, "tx")
    totals = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum("y").alias("__y"), F.sum("m").alias("__m"))
    joined = lookup(rows, totals, [group])
    return joined.select("tx", F.greatest(F.coalesce(F.col("__y") - F.col("y"), F.lit(0.0)), F.lit(0.0)).alias("pos"), F.greatest(F.coalesce(F.col("__m") - F.col("m"), F.lit(0.0)), F.lit(0.0)).alias("lab"))


def label_features(e: DataFrame, values: DataFrame, communities: DataFrame, clients: DataFrame, alpha: float = 20.0, two_hop: bool = True) -> DataFrame:
    """The six features: one- and two-hop rates, labelled neighbours, community and client rates, labelled client rows.

    ``communities`` and ``clients`` have ``tx`` and ``community`` or
    ``client``, NULL for a row that has none.
    """
    prior = training_prior(values)
    parts = {"1hop": neighbour_label_stats(e, values), "c": group_label_stats(values, communities, "community"), "u": group_label_stats(values, clients, "client")}
    if two_hop:
        parts["2hop"] = two_hop_label_stats(e, values)
    out = values.select("tx")
    for name, part in parts.items():
        out = out.join(part.select("tx", smooth_rate(F.col("pos"), F.col("lab"), prior, alpha).alias(f"rate_{name}"), F.col("lab").alias(f"lab_{name}")), "tx")
    made = [F.col("rate_1hop").alias("graph_nb_fraud_rate_1hop"), F.col("lab_1hop").alias("graph_nb_labeled_count")]
    made += [F.col("rate_2hop").alias("graph_nb_fraud_rate_2hop")] if two_hop else []
    made += [F.col("rate_c").alias("graph_community_fraud_rate"), F.col("rate_u").alias("uid_fraud_rate"), F.col("lab_u").alias("uid_labeled_count")]
    return out.select("tx", *made)
