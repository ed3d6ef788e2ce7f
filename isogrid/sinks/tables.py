"""Text and Parquet sinks."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import CompressionConfig, archive_name, crs_label
from ..sources.raster import Raster


def write_csv(cells: DataFrame, path: str) -> None:
    """x, y, value (unsmoothed) in row order, with the row's number."""
    cells.orderBy("row", "col").select("x", "y", "value").write.option("header", True).csv(path)


def write_archive(stream: DataFrame, header: Raster, cfg: CompressionConfig, path: str, raster_id: str) -> str:
    """Blocks and a one-row header with all that decoding needs, as Parquet by raster_id. What is there of that raster is replaced. Returns its full name.

    The largest error is taken while the blocks are written; it is stored once, in the header."""
    spark = stream.sparkSession
    seen = Observation()
    blocks = stream.observe(seen, F.max("max_error").alias("top")).drop("max_error").sortWithinPartitions("block_idx").withColumn("raster_id", F.lit(raster_id))
    replace = {"partitionOverwriteMode": "dynamic", "compression": "zstd"}
    blocks.write.mode("overwrite").options(**replace).partitionBy("raster_id").parquet(f"{path}/blocks")
    top = float(seen.get["top"] or 0.0)
    crs, valid = header.crs or cfg.force_crs, not top >= cfg.accuracy
    name = archive_name(raster_id, cfg, crs_label(header.crs, cfg.force_crs), valid)
    h = (raster_id, name, header.height, header.width, *map(float, header.transform), crs, header.nodata, top, valid, str(asdict(cfg)), cfg.block, cfg.accuracy, cfg.decimal, cfg.dct_type)
    schema = "raster_id string, name string, height int, width int, a double, b double, c double, d double, e double, f double, crs string, nodata double, max_error double, valid boolean, settings string, block int, accuracy double, decimal int, dct_type int"
    spark.createDataFrame([h], schema).write.mode("overwrite").options(**replace).partitionBy("raster_id").parquet(f"{path}/headers")
    return name


def read_archive(spark: SparkSession, path: str, raster_id: str) -> tuple[DataFrame, Raster, CompressionConfig]:
    """The stream (without its blocks' own errors), the header and the settings."""
    h = spark.read.parquet(f"{path}/headers").filter(F.col("raster_id") == raster_id).first()
    if h is None:
        raise KeyError(raster_id)
    stream = spark.read.parquet(f"{path}/blocks").filter(F.col("raster_id") == raster_id).drop("raster_id").withColumn("max_error", F.lit(None).cast("double"))
    return stream, Raster(h.height, h.width, (h.a, h.b, h.c, h.d, h.e, h.f), h.crs, h.nodata), CompressionConfig(accuracy=h.accuracy, block=h.block, decimal=h.decimal, dct_type=h.dct_type)
