"""Surfer ASCII grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Grid


def lines(cells: DataFrame, value: str = "value") -> DataFrame:
    """row, line: a raster row's values with six decimals, by column."""
    held = F.array_sort(F.collect_list(F.struct("col", F.col(value).alias("v"))))
    return cells.groupBy("row").agg(F.array_join(F.transform(held, lambda x: F.format_string("%.6f", x["v"])), " ").alias("line"))


def write_surfer(cells: DataFrame, grid: Grid, path: str, value: str = "value_out", zline: str = "range") -> None:
    """One file from south to north. zline 'res' writes the resolution where the format wants the range of z. Rows are streamed to the driver one after the other."""
    if zline == "res":
        low = high = grid.resolution
    else:
        low, high = cells.filter(F.col(value) > -9999).agg(F.min(value), F.max(value)).first()
    with open(path, "w") as f:
        f.write(f"DSAA\n{grid.ncol} {grid.nrow}\n{grid.xmin} {grid.xmax}\n{grid.ymin} {grid.ymax}\n{float(low or 0)} {float(high or 0)}\n")
        for r in lines(cells, value).orderBy("row").toLocalIterator():
            f.write(r.line + "\n")
