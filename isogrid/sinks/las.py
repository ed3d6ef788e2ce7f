"""LAS point clouds, version 1.2, format 0."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_las(points: DataFrame, path: str, scale: float = 0.001) -> None:
    """x, y, z to multiples of scale, and classification (0 where points have none). Rows stream to the driver one partition at a time."""
    ends = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(n + c) for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = [float(ends[f"lo{c}"] or 0.0) for c in "xyz"]
    kind = F.coalesce(F.col("classification").cast("int"), F.lit(0)) if "classification" in points.columns else F.lit(0)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HIIBHI", head, 94, len(head), len(head), 0, 0, 20, ends.n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *low)
    struct.pack_into("<6d", head, 179, *[float(ends[f"{n}{c}"] or 0.0) for c in "xyz" for n in ("hi", "lo")])
    with open(path, "wb") as f:
        f.write(head)
        for r in points.select("x", "y", "z", kind.alias("k")).toLocalIterator():
            f.write(struct.pack("<3i3xB4x", *[round((v - o) / scale) for v, o in zip(r, low)], r.k))
