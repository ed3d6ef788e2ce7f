"""Inputs of the registered queries, from the test tables: a DataFrame each, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i, s: (F.col("embedding")[i].cast("double") * s)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e(0, 100.0).alias("x"), e(1, 100.0).alias("y"), e(2, 1.0).alias("z"))


POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE * 100.0 AS x, embedding[2]::DOUBLE * 100.0 AS y, embedding[3]::DOUBLE AS z FROM embeddings"


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.round(F.col("l_discount") * 100)
    return table(spark, sf_dir, "lineitem").groupBy(x.alias("x"), y.alias("y")).agg(F.min("l_extendedprice").alias("z")).select((100 * F.col("x") + F.col("y")).cast("long").alias("id"), "x", "y", "z")


LATTICE = "SELECT (100 * x + y)::BIGINT AS id, x, y, z FROM (SELECT l_quantity AS x, round(l_discount * 100) AS y, min(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("cls"))  # as many rows as types
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9) - F.lit(473352.0)
    return e.join(kinds, "event_type").select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), hours.alias("y"), F.col("value").alias("z"), "cls")


EVENTS = """SELECT event_id AS id, user_id::DOUBLE AS x, epoch_us(ts) / 3.6e9::DOUBLE - 473352.0::DOUBLE AS y, value AS z, cls
FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type)::INT AS cls FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)"""


def geoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), (10.0 * (k % 5)).alias("x"), (10.0 * F.floor(k / 5)).alias("y"), (0.1 * k).alias("undulation"))


GEOID = "SELECT n_nationkey::BIGINT AS id, 10.0::DOUBLE * (n_nationkey % 5) AS x, 10.0::DOUBLE * (n_nationkey // 5) AS y, 0.1::DOUBLE * n_nationkey AS undulation FROM nation"


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(F.avg("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))


NOISE = "SELECT (l_orderkey % 64)::INT AS row, (l_partkey % 64)::INT AS col, avg(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2"

MASKED_H, MASKED_W, BLOCK = 61, 59, 8


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise cut to 61 x 59, with NoData, zeros, one block of zeros only and one of NoData only."""
    r, c = F.col("row"), F.col("col")
    v = F.when((r < 8) & (c < 8), 0.0).when((r < 8) & (c < 16), -9999.0).when(F.col("n") % 7 == 0, -9999.0).when(F.col("n") % 11 == 0, 0.0).otherwise(F.col("value"))
    return noise(spark, sf_dir).filter((r < MASKED_H) & (c < MASKED_W)).select("row", "col", v.alias("value"))


MASKED = f"""SELECT row, col, CASE WHEN row < 8 AND col < 8 THEN 0.0 WHEN row < 8 AND col < 16 THEN -9999.0 WHEN n % 7 = 0 THEN -9999.0 WHEN n % 11 = 0 THEN 0.0 ELSE value END::DOUBLE AS value
FROM ({NOISE}) WHERE row < {MASKED_H} AND col < {MASKED_W}"""


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane and a slow wave, 64 x 64."""
    r, c = F.floor(F.col("id") / 64), F.col("id") % 64
    value = 100 + 0.05 * r + 0.03 * c + 2 * F.sin(r / 9.0) * F.cos(c / 11.0)
    return spark.range(64 * 64).select(r.cast("int").alias("row"), c.cast("int").alias("col"), value.alias("value"))


SMOOTH = """SELECT (i // 64)::INT AS row, (i % 64)::INT AS col, 100::DOUBLE + 0.05::DOUBLE * (i // 64) + 0.03::DOUBLE * (i % 64) + 2 * sin((i // 64) / 9.0::DOUBLE) * cos((i % 64) / 11.0::DOUBLE) AS value FROM range(4096) t(i)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    z = F.when(k % 17 == 0, -9999.0).when(k % 19 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 50).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), z.alias("z"))


DIRTY = "SELECT c_custkey AS id, (c_custkey % 50)::DOUBLE AS x, c_nationkey::DOUBLE AS y, CASE WHEN c_custkey % 17 = 0 THEN -9999 WHEN c_custkey % 19 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS z FROM customer"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("block"), (F.row_number().over(w) - 1).alias("pos"), (F.col("event_type") == "error").alias("mask"))


MARKS = "SELECT user_id AS block, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type = 'error' AS mask FROM events"


def blocks_sql(cells: str, height: int, width: int, block: int) -> str:
    h, w = padded(height, block), padded(width, block)
    return f"""SELECT ((i // {w}) // {block} * {w // block} + (i % {w}) // {block})::INT AS block_idx, ((i // {w}) % {block} * {block} + (i % {w}) % {block})::INT AS pos,
CASE WHEN i // {w} < {height} AND i % {w} < {width} THEN coalesce(CASE WHEN isnan(c.value) THEN NULL ELSE c.value END, -9999.0) ELSE 0.0 END::DOUBLE AS value
FROM range({h * w}) t(i) LEFT JOIN ({cells}) c ON c.row = i // {w} AND c.col = i % {w}"""
