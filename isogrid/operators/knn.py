"""Bounded nearest-neighbour joins as bucketed equi-joins.

Buckets are squares of the search radius, so all neighbours of a place lie in its bucket or the eight around it. The point side is
sent to these nine; the query side, usually larger, to its own only. The rank window then runs within (bucket, query), which the
join's partitioning satisfies: no second shuffle of the pairs, unless a bucket is dense. Such buckets are split by the adaptive skew join, which knn_join
allows at the price of a shuffle for the window (by default Spark gives the split up instead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(float(side))).cast("long")


def around(points: DataFrame, side: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each point under its own bucket and the eight around it, as (bx, by)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = points.withColumn("_s", F.explode(steps))
    return spread.withColumn("bx", bucket(F.col(x), side) + F.col("_s.i")).withColumn("by", bucket(F.col(y), side) + F.col("_s.j")).drop("_s")


def radius_join(queries: DataFrame, points: DataFrame, radius: float, qx: str = "gx", qy: str = "gy") -> DataFrame:
    """Pairs nearer than radius: all columns of queries, id and z of points, d2. Keeps bx and by, the query's bucket."""
    q = queries.withColumns({"bx": bucket(F.col(qx), radius), "by": bucket(F.col(qy), radius)})
    p = around(points.select("id", F.col("x").alias("_px"), F.col("y").alias("_py"), "z"), radius, "_px", "_py")
    dx, dy = F.col(qx) - F.col("_px"), F.col(qy) - F.col("_py")
    return q.join(p, ["bx", "by"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") < float(radius) ** 2).drop("_px", "_py")


def knn_join(queries: DataFrame, points: DataFrame, k: int, radius: float, key: tuple[str, ...] = ("row", "col"), qx: str = "gx", qy: str = "gy") -> DataFrame:
    """The k nearest of these pairs for each query, ties by id, with rank (from 1) and d."""
    queries.sparkSession.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    near = Window.partitionBy("bx", "by", *key).orderBy("d2", "id")
    pairs = radius_join(queries, points, radius, qx, qy).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    return pairs.withColumn("d", F.sqrt("d2")).drop("bx", "by", "d2")


def nearest(points: DataFrame, model: DataFrame, radius: float, value: str) -> DataFrame:
    """points with the value of the nearest row (x, y, value) of model within radius, null where there is none."""
    m = model.select(F.monotonically_increasing_id().alias("id") if "id" not in model.columns else F.col("id"), "x", "y", F.col(value).alias("z"))
    left = points.withColumnRenamed("z", "_z")
    pairs = radius_join(left.select(F.col("id").alias("_q"), F.col("x").alias("qx"), F.col("y").alias("qy")), m, radius, "qx", "qy")
    found = pairs.groupBy("bx", "by", "_q").agg(F.min_by("z", F.struct("d2", "id")).alias(value)).select("_q", value)
    return left.join(found, F.col("id") == F.col("_q"), "left").drop("_q").withColumnRenamed("_z", "z")
