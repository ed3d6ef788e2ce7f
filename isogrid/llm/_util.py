"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word for the rules, mixing and SimHash operators: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local one, on one machine only (tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="isogrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bounds what a Python worker is sent at once, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(df: DataFrame, per_task: int = 256 << 20) -> int:
    """How many shuffle partitions a scan's rows need: those of the session, more where one would hold over per_task bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // per_task), 1_000_000))


def nested(docs: DataFrame, *names: str) -> DataFrame:
    """The row in a struct, _row, so that no column of it meets a helper's name; and the named columns beside it."""
    return docs.select(F.struct(*[_exact(c) for c in docs.columns]).alias("_row"), *[_exact(n).alias(n) for n in names])


def unnested(rows: DataFrame, columns: list[str], results: list[str]) -> DataFrame:
    """The columns of the rows in _row, without those named like a result, and the results."""
    own = {r.lower() for r in results}
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in own], *results)


def _exact(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: written once to the shared folder, read from there. A lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_for(rows: int, per_bucket: int = 100_000) -> int:
    """How many hash buckets keep each near per_bucket rows; it grows with the data."""
    return max(1, -(-rows // per_bucket))


def hash_bucket(h: Column, n: int) -> Column:
    """The bucket of a 64-bit hash among n, in the order of the hash: bucket order and hash order agree."""
    return F.least(F.floor((F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))) * n).cast("long"), F.lit(n - 1).cast("long"))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over the rows before this one within keys, by bucket, then by order. df has no columns _t, _base, _in, _k*.

    Two levels: totals by (keys, bucket) are summed first over that small table, then rows only
    within their bucket, so that a hot key spreads over all its buckets and no task orders a whole key.
    """
    value = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, bucket, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    names = [*keys, bucket]
    right = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    return held.join(right, on, "left").withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_in", "_base", *[f"_k{i}" for i in range(len(names))])
