"""Keyed joins with checks, and choices of columns and types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType

# Largest single-precision number, and the column blocks of the feature matrix.
FLOAT_MAX = 3.4028234663852886e38
EXACT_BLOCKS = {
    "base": ("TransactionAmt", "dist1", "dist2", "has_identity"),
    "derived": ("hour", "dayofweek", "amt_log", "amt_decimal"),
    "D": tuple(f"D{i}" for i in range(1, 16)),
    "C": tuple(f"C{i}" for i in range(1, 15)),
}
PREFIX_BLOCKS = {"label_encode": "le_", "frequency_encode": "freq_", "aggregations": "TransactionAmt_", "V": "V", "id": "id_", "graph": "graph_", "uid": "uid_"}
META = ("TransactionID", "isFraud", "TransactionDT")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` if no key occurs twice, else ValueError; one aggregation job."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0][key]}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Left join on a key that must be unique in ``right``; ``flag`` is 1 where ``right`` has a row, else 0.

    Columns of ``right`` that ``left`` has as well are taken from ``left``.
    Rows of ``right`` without partner go away.
    """
    fresh = [c for c in right.columns if c == key or c not in left.columns]
    marked = require_unique(right, key).select(*fresh).withColumn(flag, F.lit(1))
    return left.drop(flag).join(marked, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def narrow_report(df: DataFrame, protected: Iterable[str] = ()) -> DataFrame:
    """``column_name``, ``low``, ``high`` and ``target_type`` of each number column; one scan.

    Whole numbers get the smallest signed type that holds their range, doubles
    become floats if their largest finite value fits. Protected columns keep
    their type. A column without finite values becomes the smallest type.
    """
    whole = (ByteType, ShortType, IntegerType, LongType)
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (*whole, FloatType, DoubleType)) and f.name not in set(protected)}
    if not kinds:
        return df.sparkSession.createDataFrame([], "column_name string, low double, high double, target_type string")
    finite = {c: F.when(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(None))) <= 1.7976931348623157e308, F.col(c)) if isinstance(t, (FloatType, DoubleType)) else F.col(c) for c, t in kinds.items()}
    one = df.agg(*[F.min(v).cast("double").alias(f"lo_{c}") for c, v in finite.items()], *[F.max(v).cast("double").alias(f"hi_{c}") for c, v in finite.items()])
    parts = [x for c, t in kinds.items() for x in (F.lit(c), F.lit("int" if isinstance(t, whole) else "real"), F.col(f"lo_{c}"), F.col(f"hi_{c}"))]
    long = one.select(F.stack(F.lit(len(kinds)), *parts).alias("column_name", "kind", "low", "high"))
    within = lambda n: (F.coalesce("low", F.lit(0.0)) >= -(2.0 ** (n - 1))) & (F.coalesce("high", F.lit(0.0)) < 2.0 ** (n - 1))
    ints = F.when(within(8), "tinyint").when(within(16), "smallint").when(within(32), "int").otherwise("bigint")
    reals = F.when(F.coalesce(F.greatest(F.abs("low"), F.abs("high")), F.lit(0.0)) <= FLOAT_MAX, "float").otherwise("double")
    return long.select("column_name", "low", "high", F.when(F.col("kind") == "int", ints).otherwise(reals).alias("target_type"))


def narrow(df: DataFrame, protected: Iterable[str] = ()) -> DataFrame:
    """The table cast as :func:`narrow_report` says; texts and protected columns stay."""
    to = {r["column_name"]: r["target_type"] for r in narrow_report(df, protected).collect()}
    return df.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in df.columns])


def raw_block(columns: Sequence[str], wanted: Sequence[str] | None, prefix: str, encoded: Iterable[str] = ()) -> list[str]:
    """Columns of a raw block: those wanted, or all with the prefix, without encoded and missing ones."""
    chosen = [c for c in columns if c.startswith(prefix)] if wanted is None else wanted
    return [c for c in chosen if c in set(columns) and c not in set(encoded)]


def block_of(column: str, blocks: Sequence[str]) -> str | None:
    """The first of ``blocks`` that a column belongs to; meta columns belong to none."""
    if column in META:
        return None
    for b in blocks:
        if column in EXACT_BLOCKS[b] if b in EXACT_BLOCKS else column.startswith(PREFIX_BLOCKS[b]):
            return b
    return None


def select_features(columns: Sequence[str], blocks: Sequence[str], excluded: Iterable[str] = ()) -> list[str]:
    """Feature columns of some blocks, in the table's order."""
    return [c for c in columns if c not in set(excluded) and block_of(c, blocks)]
