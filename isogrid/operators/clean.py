"""Cleaning of point sets, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_missing, is_missing


def drop_invalid(points: DataFrame, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Rows in which no column is null, NaN or NoData."""
    return points.filter(~any_missing([F.col(c) for c in columns]))


def keep_classes(points: DataFrame, classes: Sequence[int] | None, column: str = "classification") -> DataFrame:
    return points if classes is None else points.filter(F.col(column).isin(*classes))


def statistics(points: DataFrame) -> DataFrame:
    """One row: extremes of x, y and z, and the number of points."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("n"))


def raster_nodata(cells: DataFrame) -> DataFrame:
    """Missing cell values become NoData."""
    return cells.withColumn("value", F.when(is_missing(F.col("value")), F.lit(-9999.0)).otherwise(F.col("value")))


def valid_range(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min(F.when(F.col("value") > -9999, F.col("value"))).alias("low"), F.max("value").alias("high"))
