"""Per-key processing when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from sedimenta.operators.profiling import as_text
from sedimenta.session import cut_lineage


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01, fraction: float = 0.02, seed: int = 11) -> DataFrame:
    """Keys that hold about ``share`` of the rows or more, found in a sample.

    A key is taken if it holds at least half of ``share`` of the sampled rows,
    so the result has at most 2 / ``share`` rows whatever the input; it is
    collected and given back as a local table, the same for every use. One job:
    the sampled rows are counted as they pass. NULL is a key like any other.
    The choice only decides how rows are routed: both routes of the operators
    below are exact.
    """
    seen = Observation()
    sampled = df.select(*keys).sample(fraction=fraction, seed=seed).observe(seen, F.count(F.lit(1)).alias("n"))
    top = sampled.groupBy(*keys).agg(F.count("*").alias("__n")).orderBy(F.col("__n").desc()).limit(int(2 / share) + 1).collect()
    least = max(2.0, seen.get["n"] * share / 2) if top else 0.0
    return df.sparkSession.createDataFrame([tuple(r)[:-1] for r in top if r["__n"] >= least], StructType([df.schema[k] for k in keys]))


def split_by_weight(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys, with their number ``__heavy``, and the other rows.

    ``heavy`` is the bounded table of :func:`heavy_keys`; it is broadcast.
    """
    side, same, drop = _numbered(df, keys, heavy)
    return df.join(F.broadcast(side), same, "inner").drop(*drop), df.join(F.broadcast(side), same, "left_anti")


def _numbered(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """Heavy keys under names of their own with a number, the condition that a row has one (NULL equals NULL), and those names."""
    numbered = [tuple(row) + (i,) for i, row in enumerate(heavy.collect())]
    schema = StructType([df.schema[k] for k in keys]).add("__heavy", IntegerType())
    side = df.sparkSession.createDataFrame(numbered, schema).select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__heavy")
    return side, _all([F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]), [f"__h_{k}" for k in keys]


def skew_aggregate(df: DataFrame, keys: Sequence[str], within: Sequence[str], first: dict[str, Column], last: dict[str, Column], heavy: DataFrame, salt: Column, salts: int = 32) -> DataFrame:
    """``last`` over ``first`` per ``keys`` and ``within``, without one task getting a heavy key.

    Every row meets the broadcast table of heavy keys. One shuffle takes the
    rows of heavy keys by key and salt and all others by key; rows are
    aggregated before it. The heavy keys' parts are then merged per key in a
    second, small stage, the other keys' groups are complete as they are; both
    are the result, by union. ``first`` aggregates rows, ``last`` merges what
    ``first`` named (column names as in ``first``).
    """
    side, same, drop = _numbered(df, keys, heavy)
    met = df.join(F.broadcast(side), same, "left").drop(*drop)
    salted = met.withColumn("__salt", F.when(F.col("__heavy").isNotNull(), F.pmod(F.xxhash64(salt), F.lit(salts))).otherwise(F.lit(0)))
    # the mark is an aggregate, so that the two routes below part after the shuffle and share it
    staged = salted.groupBy(*keys, *within, "__salt").agg(F.count("__heavy").alias("__mark"), *[c.alias(n) for n, c in first.items()])
    merged = staged.where("__mark > 0").groupBy(*keys, *within).agg(*[c.alias(n) for n, c in last.items()])
    return merged.unionByName(staged.where("__mark = 0").select(*merged.columns))


def skew_join(facts: DataFrame, side: DataFrame, keys: Sequence[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``facts`` joined with ``side``, which has one row per key at most.

    Rows of heavy keys meet the few rows of ``side`` that they need by
    broadcast (no more than ``heavy`` has rows); all others shuffle. NULL keys
    meet nothing, as in SQL.
    """
    of_heavy, others = split_by_weight(facts, keys, heavy)
    few = side.join(F.broadcast(heavy), list(keys), "left_semi")
    joined = of_heavy.drop("__heavy").join(F.broadcast(few), list(keys), how)
    return joined.unionByName(others.join(side, list(keys), how))


def lookup(facts: DataFrame, side: DataFrame, keys: Sequence[str], most_rows: int = 200_000) -> DataFrame:
    """``facts`` with the row of ``side`` of their key, if there is one; ``side`` has one row per key at most.

    ``side`` is written to the checkpoint folder and counted: up to
    ``most_rows`` it is broadcast and ``facts`` isn't shuffled; beyond,
    :func:`skew_join` keeps heavy keys, NULL among them, out of the shuffle.
    """
    side = cut_lineage(side)
    if side.limit(most_rows + 1).count() <= most_rows:
        return facts.join(F.broadcast(side), list(keys), "left")
    return skew_join(facts, side, keys, heavy_keys(facts, keys), "left")


def lookup_columns(df: DataFrame, key: str, columns: dict[str, str], dictionary: DataFrame, values: Sequence[str], most_rows: int = 200_000) -> DataFrame:
    """``key`` and, for each name of ``columns`` and each of ``values``, ``{value}~{name}``: what ``dictionary`` has for the row's value.

    ``columns`` gives each name the column it looks up; ``dictionary`` has
    ``column_name`` (the name), ``value`` (as :func:`unpivot` writes it) and
    ``values``, one row per name and value. Up to ``most_rows`` it is broadcast
    and no row is shuffled. Beyond, all columns are looked up by one join of
    the unpivoted table and put together again by key: two shuffles, however
    many columns there are; values that a sample shows heavy stay out of the
    first. ``key`` must be unique.
    """
    known = cut_lineage(dictionary.select("column_name", "value", *values))
    if known.limit(most_rows + 1).count() <= most_rows:
        out = df.select(key, *[as_text(df, c).alias(f"__v_{name}") for name, c in columns.items()])
        for name in columns:
            side = known.where(F.col("column_name") == name).select(F.col("value").alias(f"__v_{name}"), *[F.col(v).alias(f"{v}~{name}") for v in values])
            out = out.join(F.broadcast(side), f"__v_{name}", "left")
        return out.select(key, *[f"{v}~{name}" for name in columns for v in values])
    parts = [x for name, c in columns.items() for x in (F.lit(name), as_text(df, c))]
    long = df.select(key, F.stack(F.lit(len(columns)), *parts).alias("column_name", "value"))
    met = skew_join(long, known, ["column_name", "value"], heavy_keys(long, ["column_name", "value"]), "left")
    return met.groupBy(key).agg(*[F.max(F.when(F.col("column_name") == name, F.col(v))).alias(f"{v}~{name}") for name in columns for v in values])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
