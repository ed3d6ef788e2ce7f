"""Attribute tables of shapefiles (dBASE) as a Python data source, by record ranges. Geometry is not read."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import expand


def table_of(path: str) -> str:
    """The .dbf beside a .shp."""
    if path.lower().endswith(".dbf"):
        return path
    base = path[:-4]
    return next((base + e for e in (".dbf", ".DBF") if os.path.exists(base + e)), base + ".dbf")


def layout(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, header's length, record's length, and fields (name, kind, length, decimals)."""
    with open(path, "rb") as f:
        count, head, length = struct.unpack("<4xIHH20x", f.read(32))
        fields = []
        while (d := f.read(32)) and d[0] != 0x0D:
            fields.append((d[:11].split(b"\0")[0].decode(), chr(d[11]), d[16], d[17]))
    return count, head, length, fields


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    count: int

    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.per = [table_of(p) for p in expand(options["path"], ".shp", ".dbf")], int(options.get("recordsperpartition", 500_000))

    def partitions(self) -> list[Rows]:
        out = []
        for path in dict.fromkeys(self.files):
            n = layout(path)[0]
            out += [Rows(path, a, min(self.per, n - a)) for a in range(0, n, self.per)] or [Rows(path, 0, 0)]
        return out

    def read(self, p: Rows) -> Iterator[tuple]:
        _, head, length, fields = layout(p.path)
        name = os.path.basename(p.path)
        with open(p.path, "rb") as f:
            f.seek(head + p.first * length)
            for _ in range(p.count):
                r, at, out = f.read(length), 1, []
                if r[:1] == b"*":  # deleted
                    continue
                for _, kind, size, _ in fields:
                    v = r[at : at + size].strip(b" \0")
                    out.append((float(v) if v and not v.startswith(b"*") else None) if kind in "NF" else v.decode("utf-8", "replace") or None)
                    at += size
                yield (*out, name)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> T.StructType:
        fields = layout(table_of(expand(self.options["path"], ".shp", ".dbf")[0]))[3]
        return T.StructType([*[T.StructField(n, T.DoubleType() if k in "NF" else T.StringType()) for n, k, _, _ in fields], T.StructField("source_id", T.StringType())])

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)
