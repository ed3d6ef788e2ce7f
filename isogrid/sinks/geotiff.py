"""GeoTIFF: 32-bit floats, deflate or LZW with a horizontal predictor, tiles of 256 x 256 that the executors compress."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packing import pack_lzw

TILE = 256


def _pack(a: np.ndarray, lzw: bool = False) -> bytes:
    """Differences along rows of the values' bits, compressed."""
    bits = a.astype("<f4").view("<u4")
    d = bits.copy()
    d[:, 1:] -= bits[:, :-1]
    return pack_lzw(d.tobytes()) if lzw else zlib.compress(d.tobytes(), 6)


def tiles(cells: DataFrame, height: int, width: int, value: str, lzw: bool = False) -> DataFrame:
    """tile, data (compressed) of all tiles that have cells."""
    across = -(-width // TILE)
    t = (F.floor(F.col("row") / TILE) * across + F.floor(F.col("col") / TILE)).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((TILE, TILE), -9999.0)
        a[pdf["row"] % TILE, pdf["col"] % TILE] = pdf["v"].fillna(-9999.0)
        return pd.DataFrame({"tile": [int(pdf["tile"].iloc[0])], "data": [_pack(a, lzw)]})

    return cells.select(t.alias("tile"), "row", "col", F.col(value).cast("double").alias("v")).groupBy("tile").applyInPandas(pack, "tile int, data binary")


def write_geotiff(cells: DataFrame, height: int, width: int, transform: tuple[float, ...], crs: str | None, path: str, value: str = "value", lzw: bool = False) -> None:
    """One file; compressed tiles stream to the driver one partition at a time."""
    n = -(-width // TILE) * -(-height // TILE)
    empty = _pack(np.full((TILE, TILE), -9999.0), lzw)
    offsets, counts = [0] * n, [0] * n
    with open(path, "wb") as f:
        f.write(b"II*\0\0\0\0\0")
        for t, data in _stream(tiles(cells, height, width, value, lzw)):
            offsets[t], counts[t] = f.tell(), len(data)
            f.write(data)
        if 0 in counts:
            at = f.tell()
            f.write(empty)
            offsets, counts = [o or at for o in offsets], [c or len(empty) for c in counts]
        f.write(b"\0" * (f.tell() % 2))
        a, b, c, d, e, g = transform
        code = re.search(r"(\d{4,5})", crs or "")
        keys = [1, 1, 0, 3, 1024, 0, 1, 2 if code and code[1] == "4326" else 1, 1025, 0, 1, 1, 2048 if code and code[1] == "4326" else 3072, 0, 1, int(code[1]) if code else 32767]
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [32]), (259, 3, [5 if lzw else 8]), (262, 3, [1]), (277, 3, [1]), (317, 3, [2]), (322, 3, [TILE]), (323, 3, [TILE]), (324, 4, offsets), (325, 4, counts), (339, 3, [3]), (34264, 12, [a, b, 0.0, c, d, e, 0.0, g, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (34735, 3, keys), (42113, 2, b"-9999\0")]
        entries, late, base = b"", b"", f.tell() + 2 + 12 * len(tags) + 4
        for tag, kind, v in tags:
            raw = v if kind == 2 else struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *v)
            entries += struct.pack("<HHI", tag, kind, len(v))
            entries += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", base + len(late))
            late += (raw + b"\0" * (len(raw) % 2)) if len(raw) > 4 else b""
        at = f.tell()
        f.write(struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + late)
        f.seek(4)
        f.write(struct.pack("<I", at))


def _stream(rows: DataFrame) -> Iterator[tuple[int, bytes]]:
    for r in rows.toLocalIterator():
        yield r.tile, bytes(r.data)
