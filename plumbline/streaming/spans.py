"""Live aggregates over arriving trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.schemas import SPAN


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SPAN).json(path)


def by_stage(spans: DataFrame) -> DataFrame:
    """For complete mode. Percentiles are approximate here: exact ones would keep all values as state."""
    p = F.approx_percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(1000))
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), p.alias("approx_p50_p95_p99_ms"), F.max("duration_ms").alias("max_ms"))


def windowed(spans: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spans and errors per window and name; rows later than ``late`` are dropped, so state is bounded."""
    timed = spans.withColumn("ts", F.timestamp_seconds("start_time")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors")).select(F.col("window.start").alias("start"), "name", "n", "errors")
