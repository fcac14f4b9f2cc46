from pyspark.sql import functions as F

from sedimenta.operators.profiling import rate_by
from sedimenta.streaming.rates import read_stream, run_to_end, windowed_rate


def test_windowed_rate_equals_the_batch_one(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 3600).alias("t"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    run_to_end(windowed_rate(stream, F.timestamp_seconds("t"), "y"), "rates", str(tmp_path / "state"))
    got = sorted((r.n, round(r.rate, 9)) for r in spark.table("rates").collect())
    week = df.withColumn("week", F.floor((F.col("t") - 0) / (7 * 86400)))
    want = sorted((r.n, round(r.rate, 9)) for r in rate_by(week, "week", "y").collect())
    assert got == want
