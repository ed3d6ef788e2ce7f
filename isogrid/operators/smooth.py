"""Gaussian smoothing of a raster, one axis after the other.

Rows of the window are read in place: the stencil along an axis is a sum of lags and leads over a line of the raster, with
lines mirrored at their ends first. So each axis costs one shuffle of the cells and none of the (2r + 1) products.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(cells: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """row, col, value of a full raster. NaN spreads over the kernel's square; null counts as NaN."""
    k = kernel(sigma)
    out = cells.select("row", "col", F.coalesce(F.col("value"), F.lit(float("nan"))).alias("value"))
    for line, along, n in (("col", "row", height), ("row", "col", width)):
        out = _axis(out, line, along, n, k)
    return out


def _axis(cells: DataFrame, line: str, along: str, n: int, k: list[float]) -> DataFrame:
    r = len(k) // 2
    # positions before 0 and from n on that mirror a cell; only cells near the ends have any
    turns = range(-(r // (2 * n)) - 1, r // (2 * n) + 2)
    images = F.array(*[i + 2 * n * t for t in turns for i in (F.col(along), 2 * n - 1 - F.col(along))])
    outside = F.filter(images, lambda i: ((i < 0) | (i >= n)) & (i >= -r) & (i < n + r))
    mirrored = cells.withColumn("_i", F.explode(outside))
    wide = cells.withColumn("_i", F.col(along)).unionByName(mirrored)
    w = Window.partitionBy(line).orderBy("_i")
    total = None
    for j, weight in enumerate(k):
        v = F.col("value") if j == r else F.lag("value", r - j).over(w) if j < r else F.lead("value", j - r).over(w)
        total = v * weight if total is None else total + v * weight
    return wide.withColumn("_s", total).filter((F.col("_i") >= 0) & (F.col("_i") < n)).select("row", "col", F.col("_s").alias("value"))
