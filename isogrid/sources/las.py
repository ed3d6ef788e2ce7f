"""LAS point clouds as a Python data source, by record ranges; a pushed class filter skips records before they are scaled."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .files import expand

SCHEMA = "x double, y double, z double, classification int, source_id string"


@dataclass
class Header:
    offset: int
    format: int
    length: int
    count: int
    scale: tuple[float, ...]
    shift: tuple[float, ...]


def header(f) -> Header:
    h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, _, fmt, length, count = struct.unpack_from("<IIBHI", h, 96)
    if fmt & 0x80:
        raise NotImplementedError("compressed LAS (.laz) is not supported; convert it to .las")
    if h[25] >= 4 and len(h) >= 255:
        count = struct.unpack_from("<Q", h, 247)[0] or count
    return Header(offset, fmt, length, count, struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155))


@dataclass
class Records(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per = options["path"], int(options.get("recordsperpartition", 2_000_000))
        self.classes: set | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("classification",) and self.classes is None:
                self.classes = {f.value} if isinstance(f, EqualTo) else set(f.value)
            else:
                yield f

    def partitions(self) -> list[Records]:
        out = []
        for path in expand(self.path, ".las"):
            with open(path, "rb") as f:
                n = header(f).count
            out += [Records(path, a, min(self.per, n - a)) for a in range(0, n, self.per)] or [Records(path, 0, 0)]
        return out

    def read(self, p: Records) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(p.path)
        with open(p.path, "rb") as f:
            h = header(f)
            kind = 16 if h.format >= 6 else 15
            for a in range(0, p.count, 100_000):
                n = min(100_000, p.count - a)
                f.seek(h.offset + (p.first + a) * h.length)
                raw = np.frombuffer(f.read(n * h.length), np.uint8).reshape(n, h.length)
                cls = raw[:, kind] if h.format >= 6 else raw[:, kind] & 31
                if self.classes is not None:
                    keep = np.isin(cls, list(self.classes))
                    raw, cls = raw[keep], cls[keep]
                xyz = np.ascontiguousarray(raw[:, :12]).view("<i4").reshape(len(raw), 3)
                columns = [pa.array(xyz[:, i] * h.scale[i] + h.shift[i]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cls.astype(np.int32)), pa.array([name] * len(raw), pa.string())], names=["x", "y", "z", "classification", "source_id"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)
