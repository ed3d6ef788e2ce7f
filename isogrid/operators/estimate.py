"""Values of grid nodes from their neighbours, in long form (one row a neighbour, d its distance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("row", "col")


def reduce_r_min(pairs: DataFrame, r_min: float, key: tuple[str, ...] = KEY) -> DataFrame:
    """Distances below r_min become half of the node's least distance above r_min; without one they stay."""
    least = F.min(F.when(F.col("d") > r_min, F.col("d"))).over(Window.partitionBy(*key))
    return pairs.withColumn("_m", least).withColumn("d", F.when((F.col("d") < r_min) & F.col("_m").isNotNull(), F.col("_m") / 2).otherwise(F.col("d"))).drop("_m")


def replace_zero(pairs: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Distances of zero become half of the node's least other distance; where all are zero, one, so that all weigh the same."""
    least = F.min(F.when(F.col("d") > 0, F.col("d"))).over(Window.partitionBy(*key))
    return pairs.withColumn("_m", least).withColumn("d", F.when(F.col("d") == 0, F.coalesce(F.col("_m") / 2, F.lit(1.0))).otherwise(F.col("d"))).drop("_m")


def idw(pairs: DataFrame, power: float = 2.0, weights: float = 1.0, epsilon: float = 0.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """key, value, n. weights is a constant factor; zero makes all values null. epsilon is added to the distance's power."""
    grown = F.col("d") * F.col("d") if power == 2 else F.pow("d", F.lit(power))
    w = F.lit(float(weights)) / (grown + epsilon)
    total = F.sum(w)
    return pairs.groupBy(*key).agg(F.try_divide(F.sum(w * F.col("z")), F.nullif(total, F.lit(0.0))).alias("value"), F.count(F.lit(1)).alias("n"))


def idw_missing_as_zero(pairs: DataFrame, k: int, weights: float = 1.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """As idw with epsilon 1e-10, but each neighbour short of k weighs in at distance zero with value zero; a zero result is null."""
    w = F.lit(float(weights)) / (F.col("d") * F.col("d") + 1e-10)
    short = (k - F.count(F.lit(1))) * F.lit(float(weights)) / F.lit(1e-10)
    found = pairs.groupBy(*key).agg((F.sum(w * F.col("z")) / (F.sum(w) + short)).alias("value"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))


def idw_poisoned(pairs: DataFrame, k: int, power: float = 2.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """If any node of the whole grid is hit exactly, nodes with fewer than k neighbours are null."""
    hit = pairs.agg(F.coalesce(F.bool_or(F.col("d") == 0), F.lit(False)).alias("_hit"))
    found = idw(replace_zero(pairs, key), power, key=key)
    return found.crossJoin(F.broadcast(hit)).withColumn("value", F.when(F.col("_hit") & (F.col("n") < k), F.lit(None)).otherwise(F.col("value"))).drop("_hit")


def knn_mean(pairs: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return pairs.groupBy(*key).agg(F.avg("z").alias("value"), F.count(F.lit(1)).alias("n"))


def on_grid(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """All nodes; those without a value have null."""
    return nodes.join(values, list(KEY), "left")
