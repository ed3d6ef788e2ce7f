"""Descriptors of a raster's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe(cells: DataFrame, decimals: int = 2) -> DataFrame:
    """One row: number, mean, standard deviation, range, quartile distance, skewness, kurtosis (population), distinct values and entropy in bits of the rounded values, and the mean absolute step to the next cell along either axis."""
    v = cells.filter("value > -9999")
    q = v.agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("stddev"), (F.max("value") - F.min("value")).alias("value_range"),
        (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
    )
    p = v.groupBy(F.round("value", decimals).alias("r")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    e = p.agg(F.count(F.lit(1)).alias("n_unique"), (F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("entropy"))
    step = lambda line, along: F.abs(F.lead("value").over(Window.partitionBy(line).orderBy(along)) - F.col("value"))
    g = cells.select(step("row", "col").alias("a"), step("col", "row").alias("b")).agg(((F.coalesce(F.sum("a"), F.lit(0.0)) + F.coalesce(F.sum("b"), F.lit(0.0))) / F.nullif(F.count("a") + F.count("b"), F.lit(0))).alias("gradient"))
    return q.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(g))
