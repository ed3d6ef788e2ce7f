"""Masks as runs, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode(marked: DataFrame, key: tuple[str, ...], pos: str = "pos", mask: str = "mask") -> DataFrame:
    """key, start, len of each run of positions where mask holds."""
    w = Window.partitionBy(*key).orderBy(pos)
    runs = marked.filter(mask).withColumn("_g", F.col(pos) - F.row_number().over(w))
    return runs.groupBy(*key, "_g").agg(F.min(pos).alias("start"), F.count(F.lit(1)).alias("len")).drop("_g")


def decode(runs: DataFrame, pos: str = "pos") -> DataFrame:
    """All positions of the runs."""
    keep = [c for c in runs.columns if c not in ("start", "len")]
    return runs.select(*keep, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias(pos))
