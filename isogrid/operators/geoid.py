"""Heights corrected by the nearest value of a geoid model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crs import transform
from .knn import nearest


def to_crs(model: DataFrame, source: str, target: str) -> DataFrame:
    x, y = transform(F.col("x"), F.col("y"), source, target)
    return model.withColumns({"x": x, "y": y})


def correct(points: DataFrame, model: DataFrame, radius: float = 2000.0) -> DataFrame:
    """z less the undulation of the nearest model row within radius; z as it is where there is none."""
    found = nearest(points, model, radius, "undulation")
    return found.withColumn("z", F.col("z") - F.coalesce(F.col("undulation"), F.lit(0.0))).drop("undulation")
