"""Rasters (GeoTIFF, ASCII grid) as a Python data source of cells, a partition for some strips or tiles of one file."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.packing import unpack_bits, unpack_lzw
from .files import expand

SCHEMA = "source_id string, row int, col int, value double"
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: TIFF's compressions that are read: none, LZW, deflate, PackBits, deflate by its old number.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


@dataclass
class Raster:
    """Header of a raster: its size, affine a to f, CRS, NoData value, and, for TIFF, its layout."""

    height: int
    width: int
    transform: tuple[float, ...]
    crs: str | None = None
    nodata: float | None = None
    tags: dict = field(default_factory=dict)
    order: str = "<"


def tiff_header(path: str) -> Raster:
    """Of a TIFF with offsets of four bytes or, BigTIFF, of eight."""
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        version = struct.unpack(order + "H", f.read(2))[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path}: not a TIFF")
        big = version == 43
        count, entry, word = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
        held = struct.calcsize(word)
        if big:
            f.seek(8)
        f.seek(struct.unpack(order + word, f.read(held))[0])
        tags = {}
        number = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
        entries = [f.read(struct.calcsize("<" + entry) + held) for _ in range(number)]
        for e in entries:
            tag, kind, n = struct.unpack(order + entry, e[:-held])
            size = SIZES.get(kind, 1) * n
            if size <= held:
                raw = e[-held:][:size]
            else:
                f.seek(struct.unpack(order + word, e[-held:])[0])
                raw = f.read(size)
            tags[tag] = raw.rstrip(b"\0").decode("latin1") if kind == 2 else struct.unpack(f"{order}{n}{CODES[kind]}", raw) if kind in CODES else raw
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    if 34264 in tags:
        m = tags[34264]
        at = (m[0], m[1], m[3], m[4], m[5], m[7])
    else:
        at = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
    keys = tags.get(34735, ())
    crs = next((f"epsg:{keys[i + 3]}" for i in range(4, len(keys), 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    nodata = float(tags[42113]) if tags.get(42113) else None
    return Raster(tags[257][0], tags[256][0], at, crs, nodata, tags, order)


def tiff_part(path: str, r: Raster, k: int) -> tuple[int, int, np.ndarray]:
    """First row and column of a strip or tile, and its values (band 1)."""
    t = r.tags
    bits, samples, kind = t[258][0], t.get(277, (1,))[0], t.get(339, (1,))[0]
    dtype = np.dtype(f"{r.order}{ {1: 'u', 2: 'i', 3: 'f'}[kind]}{bits // 8}")
    tiled = 324 in t
    h, w = (t[323][0], t[322][0]) if tiled else (min(t.get(278, (r.height,))[0], r.height), r.width)
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    with open(path, "rb") as f:
        f.seek(offsets[k])
        data = f.read(counts[k])
    packing = t.get(259, (1,))[0]
    if packing not in UNPACK:
        raise NotImplementedError(f"{path}: TIFF compression {packing}")
    data = UNPACK[packing](data)
    across = -(-r.width // w)
    row, col = (k // across * h, k % across * w) if tiled else (k * h, 0)
    rows = h if tiled else min(h, r.height - row)
    planes = samples if t.get(284, (1,))[0] == 1 else 1
    predictor = t.get(317, (1,))[0]
    if predictor == 3:
        raw = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
        a = np.ascontiguousarray(raw.reshape(rows, bits // 8, w * planes).transpose(0, 2, 1)).view(f">f{bits // 8}")[..., 0].reshape(rows, w, planes)
    else:
        whole = np.frombuffer(data, f"{r.order}u{bits // 8}" if predictor == 2 else dtype).reshape(rows, w, planes)
        if predictor == 2:
            whole = np.cumsum(whole.astype(f"u{bits // 8}"), axis=1, dtype=f"u{bits // 8}").astype(f"{r.order}u{bits // 8}").view(dtype)
        a = whole
    return row, col, a[: r.height - row, : r.width - col, 0].astype(float)


def ascii_header(path: str) -> tuple[Raster, int]:
    """Header, and the lines that it takes."""
    head: dict[str, float] = {}
    with open(path) as f:
        n = 0
        while m := re.match(r"\s*([A-Za-z_]+)\s+(\S+)\s*$", line := f.readline()):
            head[m[1].lower()] = float(m[2])
            n += 1
        del line
    size, rows, cols = head["cellsize"], int(head["nrows"]), int(head["ncols"])
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
    return Raster(rows, cols, (size, 0.0, x0, 0.0, -size, y0 + rows * size), None, head.get("nodata_value")), n


def header(path: str) -> Raster:
    return ascii_header(path)[0] if path.lower().endswith(".asc") else tiff_header(path)


@dataclass
class Parts(InputPartition):
    path: str
    first: int
    last: int
    at: int

    def __init__(self, path: str, first: int, last: int, at: int = 0):
        self.path, self.first, self.last, self.at = path, first, last, at


def _line_starts(path: str, step: int) -> list[int]:
    """Where each step-th row of an ASCII grid begins; the lines are only counted."""
    skip, at, out = ascii_header(path)[1], 0, []
    with open(path, "rb") as f:
        for i, line in enumerate(f):
            if i >= skip and (i - skip) % step == 0:
                out.append(at)
            at += len(line)
    return out


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.per = expand(options["path"], ".tif", ".tiff", ".asc"), int(options.get("cellsperpartition", 1 << 22))

    def partitions(self) -> list[Parts]:
        out = []
        for path in self.files:
            r = header(path)
            n = r.height if path.lower().endswith(".asc") else len(r.tags.get(324) or r.tags[273])
            step = max(1, self.per * n // max(1, r.height * r.width))
            at = _line_starts(path, step) if path.lower().endswith(".asc") else [0] * -(-n // step)
            out += [Parts(path, a, min(n, a + step), at[a // step]) for a in range(0, n, step)]
        return out

    def read(self, p: Parts) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(p.path)
        if p.path.lower().endswith(".asc"):
            r, _ = ascii_header(p.path)
            with open(p.path, "rb") as f:
                f.seek(p.at)
                for i in range(p.first, p.last):
                    yield self._batch(name, r, i, 0, np.array(f.readline().split(), float)[None, : r.width])
        else:
            r = tiff_header(p.path)
            for k in range(p.first, p.last):
                yield self._batch(name, r, *tiff_part(p.path, r, k))

    @staticmethod
    def _batch(name: str, r: Raster, row: int, col: int, a: np.ndarray) -> pa.RecordBatch:
        h, w = a.shape
        v = np.where(np.isnan(a) | (a == r.nodata if r.nodata is not None else False), -9999.0, a).ravel()
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * (h * w), pa.string()), pa.array(np.repeat(np.arange(row, row + h), w).astype(np.int32)), pa.array(np.tile(np.arange(col, col + w), h).astype(np.int32)), pa.array(v)], names=["source_id", "row", "col", "value"]
        )


class RasterSource(DataSource):
    """spark.read.format("raster"): cells with source_id, row, col, value; NaN and the file's NoData value become -9999."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").load(path)
