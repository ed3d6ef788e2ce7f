"""Files in, files out: each point file or raster on its own, several at a time.

Jobs of different files run side by side in one session, so small files fill the cluster too. Inputs are one file, a folder or a pattern.
Single-file outputs (all but CSV and archives) stream through the driver to a mounted folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CompressionConfig, InterpolationConfig, grid_name, resolve
from ..operators import clean
from ..sinks.geotiff import write_geotiff
from ..sinks.shapefile import write_shapefile
from ..sinks.surfer import write_surfer
from ..sinks.tables import read_archive, write_archive, write_csv
from ..sources.files import expand
from ..sources.points import READERS, read_geoid, read_points
from ..sources.raster import header, read_raster
from .pipelines import compress_raster, decompress_raster, interpolate

OUTPUTS = ("tif", "csv", "grd", "shp")


def _each(paths: list[str], work: Callable[[str], list[str]], at_once: int) -> list[str]:
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return [x for found in pool.map(work, paths) for x in found]


def _base(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def interpolate_files(spark: SparkSession, path: str, cfg: InterpolationConfig, out: str, outputs: tuple[str, ...] = ("tif",), on_geoid_error: str = "raise", root: str = ".", at_once: int = 4) -> list[str]:
    """A grid for each point file, under the name that states its settings; the written paths.

    The heights come from the field cfg.z_field where the file has fields, less the undulation of cfg.geoid_file if that is set. A geoid file that
    can't be read is an error, or, with on_geoid_error 'skip', leaves the heights as they are. shp writes the corrected points.
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    os.makedirs(out, exist_ok=True)
    geoid = None
    if cfg.geoid_file:
        try:
            geoid = read_geoid(spark, resolve(cfg.geoid_file, root))
            geoid.limit(1).count()
        except Exception:
            if on_geoid_error != "skip":
                raise
            geoid = None

    def one(file: str) -> list[str]:
        by_field = file.lower().endswith((".shp", ".dbf"))
        points = read_points(spark, file, **({"z_field": cfg.z_field} if by_field else {}))
        if cfg.classes and "classification" not in points.columns:  # only LAS files have classes; of others all points count
            points = points.withColumn("classification", F.lit(cfg.classes[0]))
        cells, grid = interpolate(points, cfg, geoid)
        base, written = os.path.join(out, grid_name(_base(file), cfg)), []
        cells = cells.persist()
        try:
            for kind in outputs:
                at = f"{base}.{kind}"
                if kind == "tif":
                    write_geotiff(cells, grid.nrow, grid.ncol, grid.transform, cfg.source_crs, at, "value_out")
                elif kind == "csv":
                    write_csv(cells, at)
                elif kind == "grd":
                    write_surfer(cells, grid, at)
                else:
                    write_shapefile(clean.drop_invalid(clean.keep_classes(points, cfg.classes)), at)
                written.append(at)
        finally:
            cells.unpersist()
        return written

    files = [f for f in expand(path, *READERS) if not (f.lower().endswith(".dbf") and os.path.exists(f[:-4] + ".shp"))]
    return _each(files, one, at_once)


def compress_files(spark: SparkSession, path: str, cfg: CompressionConfig, archive: str, at_once: int = 4) -> list[str]:
    """Each raster into the archive, under its file's name; the full names, which state the settings and whether the accuracy is met."""

    def one(file: str) -> list[str]:
        h = header(file)
        return [write_archive(compress_raster(read_raster(spark, file).drop("source_id"), h.height, h.width, cfg), h, cfg, archive, _base(file))]

    return _each(expand(path, ".tif", ".tiff", ".asc"), one, at_once)


def decompress_files(spark: SparkSession, archive: str, out: str, only: list[str] | None = None, at_once: int = 4) -> list[str]:
    """A GeoTIFF for each raster of the archive, or for those named, with the transform and CRS of the original; the written paths."""
    os.makedirs(out, exist_ok=True)
    heads: DataFrame = spark.read.parquet(f"{archive}/headers").select("raster_id", "name")
    names = {str(r.raster_id): r.name for r in (heads if only is None else heads.filter(F.col("raster_id").isin(only))).collect()}

    def one(raster_id: str) -> list[str]:
        stream, h, cfg = read_archive(spark, archive, raster_id)
        at = os.path.join(out, f"{names[raster_id]}.tif")
        write_geotiff(decompress_raster(stream, h.height, h.width, cfg), h.height, h.width, h.transform, h.crs, at)
        return [at]

    return _each(sorted(names), one, at_once)
