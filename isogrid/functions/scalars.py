"""Column-valued functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0


def cut_to_cells(v: Column, res: Column | float) -> Column:
    """v plus its floored remainder by res, cut towards zero."""
    res = res if isinstance(res, Column) else F.lit(float(res))
    return (v + F.pmod(v, res)).cast("long")


def is_missing(c: Column) -> Column:
    """Null, NaN or the NoData value."""
    return c.isNull() | F.isnan(c) | (c == NODATA)


def any_missing(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(c) for c in columns])


def nodata_out(v: Column) -> Column:
    """What a raster sink writes: NoData for null, NaN and anything below -9995."""
    return F.when(v.isNull() | F.isnan(v) | (v < -9995), F.lit(NODATA)).otherwise(v)


def reflect(i: Column, n: Column | int) -> Column:
    """Index mirrored at both ends, the edge sample repeated, as often as needed."""
    n = n if isinstance(n, Column) else F.lit(n)
    m = F.pmod(i, 2 * n)
    return F.when(m >= n, 2 * n - 1 - m).otherwise(m)


def zigzag_key(i: Column, j: Column) -> list[Column]:
    """Sort keys of the diagonal scan: even diagonals go up, odd ones down."""
    return [i + j, F.when((i + j) % 2 == 0, -i).otherwise(i)]


def quantise(c: Column, decimal: int) -> Column:
    """Coefficient rounded half to even at so many decimals, as a whole number."""
    return F.rint(F.round(c * 10**decimal, 6)).cast("long")
