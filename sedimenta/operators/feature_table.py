"""One row per entity from events of many types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.skew import heavy_keys


def entity_type_stats(events: DataFrame, entity: str, kind: str, event_id: str, day: str, amount: str, salts: int = 16, share: float = 0.005, sampled: DataFrame | None = None) -> DataFrame:
    """``n``, ``last_day`` and ``total`` for each entity and type that occur together.

    Two stages: a group that a sample shows to be heavy is spread over
    ``salts`` salts by a hash of the event; the partial counts, maxima and sums
    are then merged per entity and type. The sample is drawn from ``sampled``,
    if given: rows with the same groups that are cheaper to make. Events without entity or type have no
    group. A missing amount counts as 0; repeated events count as often as they
    are given.
    """
    rows = events.where(F.col(entity).isNotNull() & F.col(kind).isNotNull())
    heavy = heavy_keys(rows if sampled is None else sampled.dropna(subset=[entity, kind]), [entity, kind], share).withColumn("__heavy", F.lit(True))
    spread = F.when(F.col("__heavy"), F.pmod(F.xxhash64(event_id), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(heavy), [entity, kind], "left").withColumn("__salt", spread)
    partial = salted.groupBy(entity, kind, "__salt").agg(F.count("*").alias("n"), F.max(day).alias("last_day"), F.sum(F.coalesce(amount, F.lit(0))).alias("total"))
    return partial.groupBy(entity, kind).agg(F.sum("n").alias("n"), F.max("last_day").alias("last_day"), F.sum("total").alias("total"))


def entity_feature_table(stats: DataFrame, entity: str, kind: str, types: list[int], until_day: int) -> DataFrame:
    """One row per entity: arrays of counts, days since the last event and totals.

    Place i of each array belongs to ``types[i]``; a type without events has
    count 0, total 0 and NULL days. An entity's list holds one item per type
    at most, so the row is bounded. Entities without any event of the types
    have no row.
    """
    item = F.struct(F.col("n"), (F.lit(until_day) - F.col("last_day")).alias("since"), F.col("total"))
    known = stats.where(F.col(kind).isin(types))
    byrow = known.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(F.col(kind), item))).alias("__m"))
    full = F.transform(F.array(*[F.lit(t).cast("long") for t in types]), lambda t: F.try_element_at("__m", t))
    wide = byrow.select(entity, full.alias("__f"))
    return wide.select(
        entity,
        F.transform("__f", lambda x: F.coalesce(x["n"], F.lit(0).cast("long"))).alias("counts"),
        F.transform("__f", lambda x: x["since"]).alias("days_since"),
        F.transform("__f", lambda x: F.coalesce(x["total"], F.lit(0).cast("long"))).alias("totals"),
    )
