"""Point files by their extension, one file, a folder or a pattern."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .las import LasSource
from .shapefile import ShapefileSource

POINTS = "x double, y double, z double"


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.monotonically_increasing_id())


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated x, y, z by position, one header line."""
    return with_ids(spark.read.schema(POINTS).option("header", True).csv(path).withColumn("source_id", F.col("_metadata.file_name")))


def read_geoid(spark: SparkSession, path: str) -> DataFrame:
    """Longitude, latitude and undulation, separated by spaces, no header."""
    return with_ids(spark.read.schema("x double, y double, undulation double").option("sep", " ").option("ignoreLeadingWhiteSpace", True).csv(path))


def read_shapefile(spark: SparkSession, path: str, z_field: str = "z") -> DataFrame:
    """The attribute table; x, y by name or else the first two numbers, z by name or else the third."""
    spark.dataSource.register(ShapefileSource)
    rows = spark.read.format("dbf").load(path)
    names = [n for n in rows.columns if n != "source_id"]
    lower = {n.lower(): n for n in names}
    pick = [lower.get(w, names[i]) for i, w in enumerate(("x", "y", z_field.lower()))]
    return with_ids(rows.select(*[F.col(f"`{n}`").cast("double").alias(a) for n, a in zip(pick, "xyz")], "source_id"))


def read_las(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes class filters
    spark.dataSource.register(LasSource)
    return with_ids(spark.read.format("las").load(path))


READERS = {".csv": read_text, ".txt": read_text, ".shp": read_shapefile, ".dbf": read_shapefile, ".las": read_las}


def read_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension, in either case. LAZ needs an arithmetic decoder that is not there: an error, never an empty result."""
    kind = PurePath(path).suffix.lower()
    if kind == ".laz":
        raise NotImplementedError("compressed LAS (.laz) is not supported; convert it to .las")
    if kind not in READERS:
        raise ValueError(f"no reader for {path!r}; known are {', '.join(READERS)}")
    return READERS[kind](spark, path, **options)
