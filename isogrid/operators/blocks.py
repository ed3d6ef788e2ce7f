"""Rasters as N x N blocks, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODATA = -9999.0


def padded(n: int, block: int) -> int:
    return (n + block - 1) // block * block


def split(cells: DataFrame, height: int, width: int, block: int) -> DataFrame:
    """block_idx, pos, value of all cells of the padded raster; missing cells inside are NoData, the padding is zero."""
    h, w = padded(height, block), padded(width, block)
    ids = cells.sparkSession.range(h * w)
    row, col = F.floor(F.col("id") / w).cast("int"), (F.col("id") % w).cast("int")
    full = ids.select(row.alias("row"), col.alias("col"))
    inside = (F.col("row") < height) & (F.col("col") < width)
    value = F.when(inside, F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(NODATA))).otherwise(F.lit(0.0))
    idx = (F.floor(F.col("row") / block) * (w // block) + F.floor(F.col("col") / block)).cast("int")
    pos = ((F.col("row") % block) * block + F.col("col") % block).cast("int")
    return full.join(cells.select("row", "col", "value"), ["row", "col"], "left").select(idx.alias("block_idx"), pos.alias("pos"), value.alias("value"))


def merge(blocks: DataFrame, height: int, width: int, block: int) -> DataFrame:
    """row, col, value of the raster without its padding."""
    across = padded(width, block) // block
    row = F.floor(F.col("block_idx") / across) * block + F.floor(F.col("pos") / block)
    col = (F.col("block_idx") % across) * block + F.col("pos") % block
    return blocks.select(row.cast("int").alias("row"), col.cast("int").alias("col"), "value").filter((F.col("row") < height) & (F.col("col") < width))


def tiles(blocks: DataFrame, *keys: str) -> DataFrame:
    """One row a block, its pixels in an array by position."""
    keys = keys or ("block_idx",)
    return blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("pixels"))


def kinds(blocks: DataFrame) -> DataFrame:
    """zero (all zero), nodata (all NoData), mixed (some of either) or data, by block."""
    v = F.col("value")
    zero, none = F.count_if(v == 0), F.count_if(v == NODATA)
    counted = blocks.groupBy("block_idx").agg(zero.alias("n_zero"), none.alias("n_nodata"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n_zero") == F.col("n"), "zero").when(F.col("n_nodata") == F.col("n"), "nodata").when(F.col("n_zero") + F.col("n_nodata") > 0, "mixed").otherwise("data")
    return counted.select("block_idx", kind.alias("kind"), "n_zero", "n_nodata")


def fill(blocks: DataFrame, block: int) -> DataFrame:
    """In blocks with other values, zero and NoData cells take the value of the nearest other cell, ties by position. The others become zero."""
    v = blocks.withColumn("value", F.when(F.col("value") == NODATA, 0.0).otherwise(F.col("value")))
    empty = v.filter("value = 0").select("block_idx", "pos")
    full = v.filter("value <> 0").select("block_idx", F.col("pos").alias("_p"), F.col("value").alias("_v"))
    dy = F.floor(F.col("pos") / block) - F.floor(F.col("_p") / block)
    dx = F.col("pos") % block - F.col("_p") % block
    near = empty.join(full, "block_idx").groupBy("block_idx", "pos").agg(F.min_by("_v", F.struct(dy * dy + dx * dx, F.col("_p"))).alias("_f"))
    return v.join(near, ["block_idx", "pos"], "left").select("block_idx", "pos", F.coalesce("_f", "value").alias("value"))
