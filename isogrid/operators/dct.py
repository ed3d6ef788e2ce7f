"""Two-dimensional cosine transforms of blocks, relational and by matrices, and the zig-zag order."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import zigzag_key


@lru_cache
def basis(n: int, kind: int = 2) -> np.ndarray:
    """Orthonormal matrix C of the transform: coefficients are C a C', the inverse is C' c C."""
    u, x = np.mgrid[0:n, 0:n].astype(float)
    if kind == 1:
        if n < 2:
            raise ValueError("type 1 takes two samples at least")
        end = np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), np.sqrt(0.5), 1.0)
        return np.sqrt(2 / (n - 1)) * end[:, None] * end[None, :] * np.cos(np.pi * u * x / (n - 1))
    c = np.sqrt(np.where(u == 0, 1.0, 2.0) / n) * np.cos(np.pi * (2 * x + 1) * u / (2 * n))
    return c if kind == 2 else c.T


def basis_table(spark: SparkSession, n: int, kind: int = 2) -> DataFrame:
    """u, x, w in expressions."""
    ids = spark.range(n * n)
    u, x = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    return ids.select(u.alias("u"), x.alias("x"), _weight(F.col("id"), n, kind).alias("w"))


def _weight(i: Column, n: int, kind: int) -> Column:
    u, x = F.floor(i / n), i % n
    if kind == 1:
        end = lambda k: F.when((k == 0) | (k == n - 1), F.lit(0.5**0.5)).otherwise(1.0)
        return F.sqrt(F.lit(2.0 / (n - 1))) * end(u) * end(x) * F.cos(F.pi() * u * x / (n - 1))
    a, b = (u, x) if kind == 2 else (x, u)
    return F.sqrt(F.when(a == 0, 1.0).otherwise(2.0) / n) * F.cos(F.pi() * (2 * b + 1) * a / (2 * n))


def transform(blocks: DataFrame, n: int, kind: int = 2, inverse: bool = False) -> DataFrame:
    """block_idx, pos, value to block_idx, pos, value, columns first, then rows. The basis has n * n rows and is broadcast."""
    spark = blocks.sparkSession
    b = basis_table(spark, n, kind)
    b = b.select(F.col("x").alias("u"), F.col("u").alias("x"), "w") if inverse else b
    i, j = F.floor(F.col("pos") / n).cast("int"), (F.col("pos") % n).cast("int")
    cells = blocks.select("block_idx", i.alias("i"), j.alias("j"), "value")
    rows = cells.join(F.broadcast(b.select(F.col("x").alias("j"), "u", "w")), "j").groupBy("block_idx", "i", F.col("u").alias("v")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    both = rows.join(F.broadcast(b.select(F.col("x").alias("i"), "u", "w")), "i").groupBy("block_idx", "u", "v").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return both.select("block_idx", (F.col("u") * n + F.col("v")).alias("pos"), "value")


@lru_cache
def zigzag(rows: int, cols: int | None = None) -> np.ndarray:
    """Positions (row-major) in zig-zag order."""
    cols = cols or rows
    return np.array([i * cols + j for i, j in sorted(((i, j) for i in range(rows) for j in range(cols)), key=lambda p: (p[0] + p[1], -p[0] if (p[0] + p[1]) % 2 == 0 else p[0]))])


def zigzag_table(spark: SparkSession, n: int) -> DataFrame:
    """n, pos, zz (from 0)."""
    i, j = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    return spark.range(n * n).select(F.lit(n).alias("n"), F.col("id").cast("int").alias("pos"), (F.row_number().over(Window.partitionBy(F.lit(n)).orderBy(*zigzag_key(i, j))) - 1).alias("zz"))
