"""Scans and sinks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of one table of a folder, pruned to ``columns`` if given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Broadcast hint for a side whose size was looked at.

    One counting job that stops after ``most_rows`` + 1 rows decides. A larger
    side is returned without the hint, so that the join shuffles.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV scan with a header; a schema is inferred only if none is given. NaN becomes NULL."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float NaN of the table becomes NULL, the only missing value downstream."""
    kinds = dict(df.dtypes)
    return df.select(*[_no_nan(F.col(f"`{c}`"), kinds[c]).alias(c) for c in df.columns])


def _no_nan(column: Column, kind: str) -> Column:
    return F.nanvl(column, F.lit(None).cast(kind)) if kind in ("double", "float") else column


def normalise_identity_columns(df: DataFrame) -> DataFrame:
    """Columns that start with ``id`` are spelled with ``_`` instead of ``-``; others stay."""
    spelled = ["_".join(f.name.split("-")) if f.name.startswith("id") else f.name for f in df.schema.fields]
    return df.toDF(*spelled)


def write_parquet(df: DataFrame, path: str) -> None:
    """Stage boundary: overwrite a Parquet table."""
    df.write.mode("overwrite").parquet(path)


def write_json_documents(df: DataFrame, path: str) -> None:
    """Compact JSON sink, one document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
