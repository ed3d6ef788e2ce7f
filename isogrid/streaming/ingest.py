"""New point files of a folder as they arrive, cleaned and appended; their grids follow from the appended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import drop_invalid
from ..sources.points import POINTS


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of cleaned points with the file that each came from."""
    rows = spark.readStream.schema(POINTS).option("header", True).csv(folder)
    return drop_invalid(rows.withColumn("source_id", F.col("_metadata.file_name")))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """All files that are new since the last call, once each."""
    return arrivals(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
