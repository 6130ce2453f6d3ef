"""Continuous ingest: new raw rows of a folder are cleaned, repeated ids are dropped, and records are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reedmill.operators.ingest import PreprocessConfig, articles
from reedmill.sources.readers import RAW


def raw_stream(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """New JSON-line files of a folder, with the time of their arrival."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).json(folder).withColumn("arrived", F.current_timestamp())


def records(stream: DataFrame, config: PreprocessConfig = PreprocessConfig(), late: str = "1 day") -> DataFrame:
    """Cleaned records, each id once within the watermark; state older than that is dropped."""
    out = articles(stream, config, extra=("arrived",)).drop("raw_content")
    return out.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["article_id"])


def start(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the available records as Parquet; runs again continue from the checkpoint."""
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, window: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """Records and flagged records per window of arrival and category."""
    rows = stream.withWatermark("arrived", late)
    return rows.groupBy(F.window("arrived", window), "category").agg(F.count("*").alias("records"), F.count_if(F.size("quality_flags") > 0).alias("flagged"))
