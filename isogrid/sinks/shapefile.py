"""Point shapefiles: .shp, .shx and .dbf with fields x, y, z."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame


def write_shapefile(points: DataFrame, path: str) -> None:
    """Rows stream to the driver one partition at a time; the three files are bounded by the format's 2 GB."""
    base = path[:-4] if path.lower().endswith(".shp") else path
    n, box = 0, [float("inf"), float("inf"), float("-inf"), float("-inf")]
    with open(base + ".shp", "wb") as shp, open(base + ".shx", "wb") as shx, open(base + ".dbf", "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        dbf.write(b"\0" * (32 + 3 * 32 + 1))
        for r in points.select("x", "y", "z").toLocalIterator():
            shx.write(struct.pack(">ii", shp.tell() // 2, 10))
            shp.write(struct.pack(">ii", n + 1, 10) + struct.pack("<idd", 1, r.x, r.y))
            dbf.write(b" " + b"".join(f"{v:.10f}".rjust(24)[:24].encode() for v in r))
            box = [min(box[0], r.x), min(box[1], r.y), max(box[2], r.x), max(box[3], r.y)]
            n += 1
        dbf.write(b"\x1a")
        for f, size in ((shp, 50 + 14 * n), (shx, 50 + 4 * n)):
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<ii8d", 1000, 1, *(box if n else [0.0] * 4), 0, 0, 0, 0))
        dbf.seek(0)
        dbf.write(struct.pack("<B3BIHH20x", 3, 24, 1, 1, n, 32 + 3 * 32 + 1, 1 + 3 * 24))
        for name in "xyz":
            dbf.write(struct.pack("<11sc4xBB14x", name.encode(), b"F", 24, 10))
        dbf.write(b"\x0d")
