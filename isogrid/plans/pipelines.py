"""The two pipelines: points to a grid, and rasters to compressed blocks and back."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CompressionConfig, InterpolationConfig
from ..functions.scalars import nodata_out
from ..operators import blocks, clean, codec, estimate, geoid, knn, smooth
from ..operators.grid import Grid, grid_of, nodes

MAX_POINTS = 1_000_000
TILES = (512, 256, 128, 64, 32, 16, 8)
SIDE = 4, 32  # nodes along a search block, least and most


def _spread(points: DataFrame, grid: Grid, radius: float, tile: int) -> DataFrame:
    """Points under each tile of nodes that they can reach: t, id, x, y, z."""
    across = -(-grid.ncol // tile)

    def reach(v: str, start: float, step: float, n: int):
        if not step:
            return F.sequence(F.lit(0), F.lit(0))
        first = F.greatest(F.ceil((F.col(v) - radius - start) / step), F.lit(0))
        last = F.least(F.floor((F.col(v) + radius - start) / step), F.lit(n - 1))
        return F.when(last >= first, F.sequence(F.floor(first / tile).cast("int"), F.floor(last / tile).cast("int")))

    c = points.select("id", "x", "y", "z", F.explode(reach("x", grid.x0, grid.dx, grid.ncol)).alias("_c"))
    r = c.select("*", F.explode(reach("y", grid.y0, grid.dy, grid.nrow)).alias("_r"))
    return r.select((F.col("_r").cast("long") * across + F.col("_c")).alias("t"), "id", "x", "y", "z")


def _nearest(nx, ny, px, py, pz, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and values of the k nearest points (in the order of their ids) below radius; inf and 0 where there are fewer."""
    d2 = (nx[:, None] - px[None, :]) ** 2 + (ny[:, None] - py[None, :]) ** 2
    d2[d2 >= radius * radius] = np.inf
    if d2.shape[1] > k:
        at = np.argpartition(d2, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(d2, at, 1).max(axis=1)
        tied = np.flatnonzero(np.isfinite(top) & ((d2 <= top[:, None]).sum(axis=1) > k))
        if len(tied):
            at[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :k]
        d2, z = np.take_along_axis(d2, at, 1), pz[at]
    else:
        z = np.broadcast_to(pz, d2.shape)
    return np.sqrt(d2), np.where(np.isfinite(d2), z, 0.0)


def estimate_rows(d: np.ndarray, z: np.ndarray, method: str, power: float, r_min: float | None) -> np.ndarray:
    """Values of nodes from their neighbours' distances (inf where absent) and values; NaN without any."""
    found = np.isfinite(d)
    n = found.sum(axis=1)
    if method == "knn":
        return np.where(n > 0, np.where(found, z, 0).sum(axis=1) / np.maximum(n, 1), np.nan)
    if r_min is not None:
        least = np.where(found & (d > r_min), d, np.inf).min(axis=1, initial=np.inf)[:, None]
        d = np.where((d < r_min) & np.isfinite(least), least / 2, d)
    if method == "idw":
        least = np.where(d > 0, d, np.inf).min(axis=1, initial=np.inf)[:, None]
        d = np.where(d == 0, np.where(np.isfinite(least), least / 2, 1.0), d)
    w = 1 / (d**power + (1e-10 if method == "idw_eps" else 0.0))
    total = w.sum(axis=1)
    return np.where(total > 0, (w * z).sum(axis=1) / np.where(total > 0, total, 1), np.nan)


def interpolate_tiles(points: DataFrame, grid: Grid, k: int, radius: float, method: str = "idw", power: float = 2.0, r_min: float | None = None) -> DataFrame:
    """row, col, value, n of all nodes.

    The fast path: nodes are never shuffled. Points go to the tiles of nodes that they can reach, one shuffle with little replication as
    a tile is much wider than the radius; each tile makes its nodes and searches in numpy, first within the radius that should hold k points, then,
    for nodes that it did not satisfy, twice as far, and so on up to the whole. The tile's size is the largest at which there are some tiles a core and none holds more than MAX_POINTS.
    """
    spark = points.sparkSession
    least = 4 * spark.sparkContext.defaultParallelism
    for tile in TILES:
        if tile > 64 and -(-grid.ncol // tile) * -(-grid.nrow // tile) < least:
            continue
        spread = _spread(points, grid, radius, tile)
        if tile == TILES[-1] or (spread.groupBy("t").count().agg(F.max("count")).first()[0] or 0) <= MAX_POINTS:
            break
    across, down = -(-grid.ncol // tile), -(-grid.nrow // tile)
    none = F.lit(None).cast("double")
    all_tiles = spark.range(across * down).select(F.col("id").alias("t"), F.lit(None).cast("long").alias("id"), none.alias("x"), none.alias("y"), none.alias("z"))

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.filter(pa.compute.is_valid(t["id"])).sort_by("id")
        px, py, pz = (t[c].to_numpy() for c in "xyz")
        r0, c0 = key[0].as_py() // across * tile, key[0].as_py() % across * tile
        rows, cols = np.arange(r0, min(r0 + tile, grid.nrow)), np.arange(c0, min(c0 + tile, grid.ncol))
        gx, gy = grid.x0 + cols * grid.dx, grid.y0 + rows * grid.dy
        value, count = np.full((len(rows), len(cols)), np.nan), np.zeros((len(rows), len(cols)), np.int64)
        area = max((gx[-1] - gx[0] + 2 * radius) * (gy[-1] - gy[0] + 2 * radius), 1e-9)
        first = min(radius, 1.5 * math.sqrt(k * area / (math.pi * max(len(px), 1))))
        reaches = [r for r in (first * 2.0**i for i in range(16)) if r < radius] + [radius]
        side = int(np.clip(2 * first / max(grid.dx, grid.dy, 1e-9), *SIDE))  # about as wide as the first search reaches
        by_y = np.argsort(py, kind="stable")
        sorted_y = py[by_y]
        for i in range(0, len(rows), side):
            y = gy[i : i + side]
            strips: dict[float, np.ndarray] = {}
            for j in range(0, len(cols), side):
                x = gx[j : j + side]
                nx, ny = np.tile(x, len(y)), np.repeat(y, len(x))
                d, z = np.full((len(nx), k), np.inf), np.zeros((len(nx), k))
                left = np.arange(len(nx))
                for reach in reaches:
                    if reach not in strips:
                        strips[reach] = by_y[slice(*np.searchsorted(sorted_y, [y[0] - reach, y[-1] + reach]))]
                    own = strips[reach]
                    ox = px[own]
                    near = np.sort(own[(ox > x[0] - reach) & (ox < x[-1] + reach)])  # in the order of the ids
                    some = max(1, 4_000_000 // max(1, len(near)))
                    for a in range(0, len(left) if len(near) else 0, some):
                        part = left[a : a + some]
                        dd, zz = _nearest(nx[part], ny[part], px[near], py[near], pz[near], k, reach)
                        d[part] = np.inf
                        d[part, : dd.shape[1]], z[part, : dd.shape[1]] = dd, zz
                    left = left[~np.isfinite(d[left]).all(axis=1)]
                    if not len(left):
                        break
                shape = (len(y), len(x))
                value[i : i + side, j : j + side] = estimate_rows(d, z, method, power, r_min).reshape(shape)
                count[i : i + side, j : j + side] = np.isfinite(d).sum(axis=1).reshape(shape)
        v = value.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(rows, len(cols)).astype(np.int32)), pa.array(np.tile(cols, len(rows)).astype(np.int32)), pa.array(v, mask=np.isnan(v)), pa.array(count.ravel())], names=["row", "col", "value", "n"]
        )

    # many small tasks, so that tiles that hash together don't make one core the last
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(across * down, 2 * least))
    return spread.unionByName(all_tiles).repartition(tasks, "t").groupBy("t").applyInArrow(work, "row int, col int, value double, n long")


def interpolate(points: DataFrame, cfg: InterpolationConfig, geoid_model: DataFrame | None = None, fast: bool = True) -> tuple[DataFrame, Grid]:
    """row, col, x, y, value (unsmoothed, null without neighbours) and value_out (smoothed if asked for, with NoData) of all nodes, and their grid.

    points have id, x, y, z, and classification if classes are chosen. The settings of the compatible forms take the relational path.
    """
    p = clean.drop_invalid(clean.keep_classes(points, cfg.classes))
    if geoid_model is not None:
        p = geoid.correct(p, geoid.to_crs(geoid_model, cfg.geoid_crs, cfg.source_crs), cfg.geoid_radius)
    grid = grid_of(p, cfg.resolution)
    if not cfg.weights and cfg.method != "knn":
        values = nodes(points.sparkSession, grid).select("row", "col", F.lit(None).cast("double").alias("value"))
    elif fast and cfg.missing == "skip" and cfg.zero == "node":
        values = interpolate_tiles(p, grid, cfg.neighbours, cfg.max_distance, cfg.method, cfg.power, cfg.r_min).drop("n")
    else:
        values = relational(p, grid, cfg)
    place = lambda c, start, step: (F.lit(start) + F.col(c) * F.lit(step))
    out = values.select("row", "col", place("col", grid.x0, grid.dx).alias("x"), place("row", grid.y0, grid.dy).alias("y"), "value")
    if cfg.smooth_sigma is None:
        return out.withColumn("value_out", nodata_out(F.col("value"))), grid
    smoothed = smooth.gaussian(out.select("row", "col", "value"), cfg.smooth_sigma, grid.nrow, grid.ncol).withColumnRenamed("value", "_s")
    return out.join(smoothed, ["row", "col"]).withColumn("value_out", nodata_out(F.col("_s"))).drop("_s"), grid


def relational(points: DataFrame, grid: Grid, cfg: InterpolationConfig) -> DataFrame:
    """row, col, value of all nodes by joins and aggregates only."""
    g = nodes(points.sparkSession, grid)
    pairs = knn.knn_join(g, points, cfg.neighbours, cfg.max_distance)
    if cfg.r_min is not None and cfg.method != "knn":
        pairs = estimate.reduce_r_min(pairs, cfg.r_min)
    if cfg.method == "knn":
        values = estimate.knn_mean(pairs)
    elif cfg.zero == "poison":
        values = estimate.idw_poisoned(pairs, cfg.neighbours, cfg.power)
    elif cfg.missing == "zero":
        values = estimate.idw_missing_as_zero(pairs, cfg.neighbours, cfg.weights)
    elif cfg.method == "idw_eps":
        values = estimate.idw(pairs, cfg.power, epsilon=1e-10)
    else:
        values = estimate.idw(estimate.replace_zero(pairs), cfg.power)
    return estimate.on_grid(g.select("row", "col"), values.select("row", "col", "value"))


def compress_raster(cells: DataFrame, height: int, width: int, cfg: CompressionConfig) -> DataFrame:
    """The stream of a raster's blocks (see the codec)."""
    return codec.compress(blocks.tiles(blocks.split(cells, height, width, cfg.block)), cfg)


def decompress_raster(stream: DataFrame, height: int, width: int, cfg: CompressionConfig) -> DataFrame:
    """row, col, value."""
    return blocks.merge(codec.decompress(stream, cfg), height, width, cfg.block)
