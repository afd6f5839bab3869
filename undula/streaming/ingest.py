"""Streaming additions: long-form points into windowed curves, and labels by nearest cached centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import evaluate


def read_points(spark: SparkSession, path: str, schema: str = "sample_id long, feature string, ts timestamp, value double", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_curves(points: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(window, sample_id, feature, value, n): sums of tumbling windows; points later than the watermark are dropped."""
    return (
        points.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("window"), "sample_id", "feature")
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    )


def label_stream(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(sample_id, label) of streamed codes (sample_id, z), by the nearest of static centroids."""
    return evaluate.nearest_centroid(points, centroids)
