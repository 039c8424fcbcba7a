"""Streaming file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens import schemas
from loadlens.sources.readers import RAGGED, drop_surplus, ragged_layout


def stream_host_metrics(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Host-metrics CSV files of ``folder`` as a stream; ``names`` are the header's columns.

    A file with another header stops the stream, as its columns would be taken for others.
    """
    layout = schemas.layout(names, schemas.host_column_type)
    return spark.readStream.schema(layout).csv(
        folder, header=True, enforceSchema=False).withColumn(
        "datetime", F.timestamp_millis("timestamp"))


def stream_load_samples(
    spark: SparkSession, folder: str, names: list[str] | None = None
) -> DataFrame:
    """Load-sample CSV files of ``folder`` as a stream of text columns."""
    layout = ragged_layout(names or schemas.SAMPLE_COLUMNS)
    return drop_surplus(
        spark.readStream.schema(layout).csv(folder, multiLine=True, **RAGGED))
