"""Folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded(rows: DataFrame, by: str, counts: dict, limit: int, key: Column) -> DataFrame:
    """At most about limit rows for each value of by, chosen by a hash of key; counts has the number of rows of each value."""
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, limit / max(1, n)))])
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 11) / F.lit(float(1 << 53))
    return rows.filter(u < share[F.col(by)])
