"""Counts and rates of a stream of transactions, as :func:`sedimenta.operators.profiling.rate_by` has them of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive; a streaming source needs its schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_rate(stream: DataFrame, at: Column, label: str, length: str = "7 days", late: str = "28 days", key: str | None = None) -> DataFrame:
    """Rows and mean label per window of event time, and of ``key`` if given.

    A row later than ``late`` behind the latest seen is left out; state of
    windows older than that goes away.
    """
    timed = stream.withColumn("__at", at).withWatermark("__at", late)
    windows = [F.window("__at", length, startTime="0 seconds").alias("w"), *([F.col(key)] if key else [])]
    each = timed.groupBy(*windows).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    return each.select(F.col("w.start").alias("window_start"), *([key] if key else []), "n", "rate")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off what is there into the in-memory table ``name``, then stops."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(600)
    return query
