"""Extent of a point set and the nodes of its grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cut_to_cells


@dataclass(frozen=True)
class Grid:
    """Regular grid. Steps follow from the extent and the number of cells, so they can differ from the resolution."""

    xmin: int
    ymin: int
    xmax: int
    ymax: int
    resolution: float

    @property
    def ncol(self) -> int:
        return int((self.xmax - self.xmin) / self.resolution) + 1

    @property
    def nrow(self) -> int:
        return int((self.ymax - self.ymin) / self.resolution) + 1

    @property
    def dx(self) -> float:
        return (self.xmax - self.xmin) / (self.ncol - 1) if self.ncol > 1 else 0.0

    @property
    def dy(self) -> float:
        return (self.ymax - self.ymin) / (self.nrow - 1) if self.nrow > 1 else 0.0

    @property
    def x0(self) -> float:
        return self.xmin + self.resolution / 2

    @property
    def y0(self) -> float:
        return self.ymin - self.resolution / 2

    @property
    def transform(self) -> tuple[float, ...]:
        """Affine a to f; rows run from south to north."""
        return (self.resolution, 0.0, float(self.xmin), 0.0, self.resolution, self.ymin - self.resolution)


def extent(points: DataFrame, resolution: float) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax, ncol, nrow."""
    ends = points.agg(*[cut_to_cells(f(c), resolution).alias(f"{c}{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    count = lambda c: (((F.col(f"{c}max") - F.col(f"{c}min")) / F.lit(float(resolution))).cast("long") + 1)
    return ends.select("xmin", "ymin", "xmax", "ymax", count("x").alias("ncol"), count("y").alias("nrow"))


def grid_of(points: DataFrame, resolution: float) -> Grid:
    r = extent(points, resolution).first()
    if r.xmin is None:
        raise ValueError("no points")
    return Grid(r.xmin, r.ymin, r.xmax, r.ymax, resolution)


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    """row, col, gx, gy of all nodes, generated where they are used."""
    n = spark.range(grid.nrow * grid.ncol)
    row, col = F.floor(F.col("id") / grid.ncol).cast("int"), (F.col("id") % grid.ncol).cast("int")
    return n.select(row.alias("row"), col.alias("col"), (F.lit(grid.x0) + col * F.lit(grid.dx)).alias("gx"), (F.lit(grid.y0) + row * F.lit(grid.dy)).alias("gy"))
