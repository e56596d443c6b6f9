"""The stateless filters over streams, and windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.quality import in_range, text_code, text_metrics, with_defaults


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def range_filtered(clips: DataFrame) -> DataFrame:
    """The range filter, unchanged, on a stream or a table."""
    return in_range(with_defaults(clips))


def text_gated(clips: DataFrame) -> DataFrame:
    """Layer 1 with the first failing check as ``code``."""
    base = clips.withColumn("text", F.coalesce("text", F.lit("")))
    return base.withColumns(text_metrics(F.col("text"))).withColumn("code", text_code(F.col("duration")))


def counts(clips: DataFrame, time: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Clips per source and event-time window; rows later than the watermark are dropped by the stream."""
    # event time is an instant for the stream; the window start goes back to what the table has
    kind = dict(clips.dtypes)[time]
    w = clips.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.window(time, every), "dataset_source")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast(kind).alias("start"), "dataset_source", "n")
