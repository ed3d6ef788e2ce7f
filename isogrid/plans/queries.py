"""The registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CompressionConfig, InterpolationConfig
from ..functions import crs
from ..functions.scalars import nodata_out, quantise
from ..operators import blocks, clean, codec, dct, descriptors, estimate, geoid, grid, knn, masks, prune, smooth
from . import fixtures as fx
from .pipelines import compress_raster, decompress_raster, interpolate, interpolate_tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RES, RADIUS, K = 2.0, 5.0, 10
R_MIN = 1.5
GEOID_RADIUS = 15.0
SIGMA = 1.0
N = fx.BLOCK
ACCURACY, DECIMAL = 0.05, 2


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- points: cleaning, statistics, extent, grid

STATS = "min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n"
VALID = "NOT (isnan(x) OR x = -9999 OR isnan(y) OR y = -9999 OR isnan(z) OR z = -9999)"


@query("clean_points", f"SELECT id, x, y, z FROM ({fx.DIRTY}) WHERE {VALID}")
def clean_points(spark, sf):
    return clean.drop_invalid(fx.dirty(spark, sf))


@query("point_stats", f"SELECT {STATS} FROM ({fx.DIRTY}) WHERE {VALID}")
def point_stats(spark, sf):
    return clean.statistics(clean.drop_invalid(fx.dirty(spark, sf)))


@query("class_filter", f"SELECT id, x, round(y, 6) AS y, z, cls FROM ({fx.EVENTS}) WHERE cls IN (2, 3)")
def class_filter(spark, sf):
    return clean.keep_classes(fx.events(spark, sf), (2, 3), "cls").select("id", "x", *r6("y"), "z", "cls")


def near_sql(v: str, res: float) -> str:
    return f"trunc({v} + ({v} - floor({v} / {res}) * {res}))::BIGINT"


def extent_sql(points: str, res: float) -> str:
    ends = ", ".join(f"{near_sql(f'{f}({c})', res)} AS {c}{f}" for c in "xy" for f in ("min", "max"))
    return f"SELECT *, trunc((xmax - xmin) / {res})::BIGINT + 1 AS ncol, trunc((ymax - ymin) / {res})::BIGINT + 1 AS nrow FROM (SELECT {ends} FROM ({points}))"


def nodes_sql(points: str, res: float) -> str:
    return f"""SELECT (i // ncol)::INT AS row, (i % ncol)::INT AS col,
xmin + {res / 2}::DOUBLE + (i % ncol) * CASE WHEN ncol > 1 THEN (xmax - xmin)::DOUBLE / (ncol - 1) ELSE 0 END AS gx,
ymin - {res / 2}::DOUBLE + (i // ncol) * CASE WHEN nrow > 1 THEN (ymax - ymin)::DOUBLE / (nrow - 1) ELSE 0 END AS gy
FROM (SELECT *, unnest(range(ncol * nrow)) AS i FROM ({extent_sql(points, res)}))"""


def pairs_sql(points: str, res: float, radius: float, k: int) -> str:
    return f"""SELECT *, sqrt(d2) AS d FROM (SELECT row, col, id, z, d2, row_number() OVER (PARTITION BY row, col ORDER BY d2, id)::INT AS rank FROM (
SELECT g.row, g.col, p.id, p.z, (gx - x) * (gx - x) + (gy - y) * (gy - y) AS d2 FROM ({nodes_sql(points, res)}) g JOIN ({points}) p ON (gx - x) * (gx - x) + (gy - y) * (gy - y) < {radius * radius})) WHERE rank <= {k}"""


def nodes_of(spark, points: DataFrame, res: float) -> DataFrame:
    return grid.nodes(spark, grid.grid_of(points, res))


def neighbours(spark, points: DataFrame, res: float = RES, radius: float = RADIUS, k: int = K) -> DataFrame:
    return knn.knn_join(nodes_of(spark, points, res), points, k, radius)


@query("grid_extent", extent_sql(fx.POINTS, 0.5))
def grid_extent(spark, sf):
    return grid.extent(fx.points(spark, sf), 0.5)


@query("grid_nodes", f"SELECT row, col, round(gx, 6) AS gx, round(gy, 6) AS gy FROM ({nodes_sql(fx.POINTS, 0.3)})")
def grid_nodes(spark, sf):
    return nodes_of(spark, fx.points(spark, sf), 0.3).select("row", "col", *r6("gx", "gy"))


# --- neighbours and estimates

PAIRS = pairs_sql(fx.POINTS, RES, RADIUS, K)
HITS = pairs_sql(fx.LATTICE, RES, RADIUS, K)


@query("radius_join", f"SELECT row, col, id, round(d2, 6) AS d2 FROM ({pairs_sql(fx.POINTS, RES, RADIUS, 1 << 30)})")
def radius_join(spark, sf):
    p = fx.points(spark, sf)
    return knn.radius_join(nodes_of(spark, p, RES), p, RADIUS).select("row", "col", "id", *r6("d2"))


@query("knn_topn", f"SELECT row, col, rank, id, z, round(d, 6) AS d FROM ({HITS})")
def knn_topn(spark, sf):
    return neighbours(spark, fx.lattice(spark, sf)).select("row", "col", "rank", "id", "z", *r6("d"))


@query("knn_skewed", f"SELECT row, col, rank, id, z, round(d, 6) AS d FROM ({pairs_sql(fx.EVENTS, 20.0, 15.0, 5)})")
def knn_skewed(spark, sf):
    return neighbours(spark, fx.events(spark, sf), 20.0, 15.0, 5).select("row", "col", "rank", "id", "z", *r6("d"))


def value_sql(value: str, pairs: str = PAIRS) -> str:
    return f"SELECT row, col, round({value}, 6) AS value, count(*) AS n FROM ({pairs}) GROUP BY row, col"


def rounded(values: DataFrame) -> DataFrame:
    return values.select("row", "col", *r6("value"), "n")


@query("knn_mean", value_sql("avg(z)"))
def knn_mean(spark, sf):
    return rounded(estimate.knn_mean(neighbours(spark, fx.points(spark, sf))))


@query("idw", value_sql("sum(z * (2.0::DOUBLE / (d * d))) / sum(2.0::DOUBLE / (d * d))"))
def idw(spark, sf):
    return rounded(estimate.idw(neighbours(spark, fx.points(spark, sf)), weights=2.0))


@query("idw_tiles", value_sql("sum(z / (d * d)) / sum(1 / (d * d))"))
def idw_tiles(spark, sf):
    p = fx.points(spark, sf)
    found = interpolate_tiles(p, grid.grid_of(p, RES), K, RADIUS)
    return rounded(found.filter("n > 0"))


@query("idw_power", value_sql("sum(z * d ^ -3.0::DOUBLE) / sum(d ^ -3.0::DOUBLE)"))
def idw_power(spark, sf):
    return rounded(estimate.idw(neighbours(spark, fx.points(spark, sf)), power=3.0))


@query("idw_eps", value_sql("sum(z / (d * d + 1e-10::DOUBLE)) / sum(1 / (d * d + 1e-10::DOUBLE))", HITS))
def idw_eps(spark, sf):
    return rounded(estimate.idw(neighbours(spark, fx.lattice(spark, sf)), epsilon=1e-10))


@query("idw_compat_missing", f"SELECT row, col, round(nullif(v, 0), 6) AS value, n FROM (SELECT row, col, sum(z * (1 / (d * d + 1e-10::DOUBLE))) / (sum(1 / (d * d + 1e-10::DOUBLE)) + ({K} - count(*)) * 1.0::DOUBLE / 1e-10::DOUBLE) AS v, count(*) AS n FROM ({PAIRS}) GROUP BY row, col)")
def idw_compat_missing(spark, sf):
    return rounded(estimate.idw_missing_as_zero(neighbours(spark, fx.points(spark, sf)), K))


def zero_sql(pairs: str) -> str:
    return f"SELECT row, col, rank, id, z, CASE WHEN d = 0 THEN coalesce(min(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY row, col) / 2, 1.0) ELSE d END AS d FROM ({pairs})"


@query("zero_distance", f"SELECT row, col, rank, id, round(d, 6) AS d FROM ({zero_sql(HITS)})")
def zero_distance(spark, sf):
    return estimate.replace_zero(neighbours(spark, fx.lattice(spark, sf))).select("row", "col", "rank", "id", *r6("d"))


@query("idw_compat_poison", f"SELECT row, col, CASE WHEN n < {K} AND (SELECT bool_or(d = 0) FROM ({HITS})) THEN NULL ELSE value END AS value, n FROM ({value_sql('sum(z / (d * d)) / sum(1 / (d * d))', zero_sql(HITS))})")
def idw_compat_poison(spark, sf):
    return rounded(estimate.idw_poisoned(neighbours(spark, fx.lattice(spark, sf)), K))


@query("rmin_reduce", f"SELECT row, col, rank, id, round(CASE WHEN d < {R_MIN} AND m IS NOT NULL THEN m / 2 ELSE d END, 6) AS d FROM (SELECT *, min(CASE WHEN d > {R_MIN} THEN d END) OVER (PARTITION BY row, col) AS m FROM ({PAIRS}))")
def rmin_reduce(spark, sf):
    return estimate.reduce_r_min(neighbours(spark, fx.points(spark, sf)), R_MIN).select("row", "col", "rank", "id", *r6("d"))


IDW_SQL = value_sql("sum(z / (d * d)) / sum(1 / (d * d))")


@query("grid_filled", f"SELECT g.row, g.col, coalesce(v.value, -9999.0) AS value FROM ({nodes_sql(fx.POINTS, RES)}) g LEFT JOIN ({IDW_SQL}) v USING (row, col)")
def grid_filled(spark, sf):
    p = fx.points(spark, sf)
    g = nodes_of(spark, p, RES)
    values = estimate.idw(knn.knn_join(g, p, K, RADIUS))
    return estimate.on_grid(g.select("row", "col"), values).select("row", "col", F.round(nodata_out(F.col("value")), 6).alias("value"))


GEOID_SQL = f"""SELECT p.id, p.x, p.y, p.z, arg_min(g.undulation, (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS undulation
FROM ({fx.POINTS}) p LEFT JOIN ({fx.GEOID}) g ON (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y) < {GEOID_RADIUS**2} GROUP BY ALL"""


@query("geoid_nearest", f"SELECT id, x, y, z, undulation FROM ({GEOID_SQL})")
def geoid_nearest(spark, sf):
    return knn.nearest(fx.points(spark, sf), fx.geoid(spark, sf), GEOID_RADIUS, "undulation").select("id", "x", "y", "z", "undulation")


@query("geoid_corrected", f"SELECT id, x, y, round(z - coalesce(undulation, 0), 6) AS z FROM ({GEOID_SQL})")
def geoid_corrected(spark, sf):
    return geoid.correct(fx.points(spark, sf), fx.geoid(spark, sf), GEOID_RADIUS).select("id", "x", "y", *r6("z"))


LONLAT = "SELECT n_nationkey AS id, 14 + n_nationkey % 11 AS lon, 49 + 0.25::DOUBLE * n_nationkey AS lat FROM nation"


def projected_sql() -> str:
    e = 2 * crs.N**0.5 / (1 + crs.N)
    atanh = lambda x: f"(0.5 * ln((1 + ({x})) / (1 - ({x}))))"
    east = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1)]])
    north = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1)]])
    k = f"{0.9993 * crs.RADIUS!r}::DOUBLE"
    return f"""SELECT id, round(500000 + {k} * ({east}), 3) AS x, round(-5300000 + {k} * ({north}), 3) AS y FROM (
SELECT id, atan2(t, cos(d)) AS xi, {atanh('sin(d) / sqrt(1 + t * t)')} AS eta FROM (
SELECT id, d, sinh({atanh('sin(p)')} - {e!r}::DOUBLE * {atanh(f'{e!r}::DOUBLE * sin(p)')}) AS t FROM (SELECT id, radians(lat) AS p, radians(lon - 19) AS d FROM ({LONLAT}))))"""


@query("crs_transform", projected_sql())
def crs_transform(spark, sf):
    k = F.col("n_nationkey")
    rows = fx.table(spark, sf, "nation").select(k.alias("id"), (14 + k % 11).alias("lon"), (49 + 0.25 * k).alias("lat"))
    x, y = crs.project(F.col("lon"), F.col("lat"), "epsg:2180")
    return rows.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


# --- smoothing and grid sinks

KERNEL = smooth.kernel(SIGMA)
R = len(KERNEL) // 2
KERNEL_SQL = "(VALUES " + ", ".join(f"({i - R}, {w!r}::DOUBLE)" for i, w in enumerate(KERNEL)) + ") k(o, w)"


def pass_sql(cells: str, along: str, n: int) -> str:
    other = "col" if along == "row" else "row"
    m = f"((t.i + k.o) % {2 * n} + {2 * n}) % {2 * n}"
    return f"SELECT t.i::INT AS {along}, c.{other}, sum(k.w * c.value) AS value FROM range({n}) t(i), {KERNEL_SQL}, ({cells}) c WHERE c.{along} = CASE WHEN {m} >= {n} THEN {2 * n - 1} - {m} ELSE {m} END GROUP BY 1, 2"


FULL_NOISE = f"SELECT (i // 64)::INT AS row, (i % 64)::INT AS col, coalesce(c.value, 'NaN'::DOUBLE) AS value FROM range(4096) t(i) LEFT JOIN ({fx.NOISE}) c ON c.row = i // 64 AND c.col = i % 64"


@query("gaussian_smooth", f"SELECT row, col, round(value, 6) AS value FROM ({pass_sql(pass_sql(FULL_NOISE, 'row', 64), 'col', 64)})")
def gaussian_smooth(spark, sf):
    cells = spark.range(4096).select(F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"))
    full = cells.join(fx.noise(spark, sf).select("row", "col", "value"), ["row", "col"], "left")
    return smooth.gaussian(full, SIGMA, 64, 64).select("row", "col", *r6("value"))


@query("surfer_rows", f"SELECT row, string_agg(printf('%.6f', value), ' ' ORDER BY col) AS line FROM ({fx.SMOOTH}) GROUP BY row")
def surfer_rows(spark, sf):
    from ..sinks.surfer import lines

    return lines(fx.smooth(spark, sf))


# --- rasters in blocks

BLOCKS = fx.blocks_sql(fx.MASKED, fx.MASKED_H, fx.MASKED_W, N)
SMOOTH_BLOCKS = fx.blocks_sql(fx.SMOOTH, 64, 64, N)


def masked_blocks(spark, sf) -> DataFrame:
    return blocks.split(fx.masked(spark, sf), fx.MASKED_H, fx.MASKED_W, N)


def smooth_blocks(spark, sf) -> DataFrame:
    return blocks.split(fx.smooth(spark, sf), 64, 64, N)


@query("raster_range", f"SELECT min(value) FILTER (value > -9999) AS low, max(value) AS high FROM ({fx.MASKED})")
def raster_range(spark, sf):
    return clean.valid_range(clean.raster_nodata(fx.masked(spark, sf)))


@query("raster_blocks", f"SELECT block_idx, pos, round(value, 6) AS value FROM ({BLOCKS})")
def raster_blocks(spark, sf):
    return masked_blocks(spark, sf).select("block_idx", "pos", *r6("value"))


@query("raster_merge", f"SELECT row, col, round(value, 6) AS value FROM ({fx.SMOOTH})")
def raster_merge(spark, sf):
    return blocks.merge(smooth_blocks(spark, sf), 64, 64, N).select("row", "col", *r6("value"))


@query("block_kind", f"SELECT block_idx, CASE WHEN z = n THEN 'zero' WHEN m = n THEN 'nodata' WHEN z + m > 0 THEN 'mixed' ELSE 'data' END AS kind, z AS n_zero, m AS n_nodata FROM (SELECT block_idx, count(*) FILTER (value = 0) AS z, count(*) FILTER (value = -9999) AS m, count(*) AS n FROM ({BLOCKS}) GROUP BY block_idx)")
def block_kind(spark, sf):
    return blocks.kinds(masked_blocks(spark, sf))


def runs_sql(marks: str, key: str) -> str:
    return f"SELECT {key}, min(pos) AS start, count(*) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY {key} ORDER BY pos) AS g FROM ({marks}) WHERE mask) GROUP BY {key}, g"


@query("mask_rle", runs_sql(fx.MARKS, "block"))
def mask_rle(spark, sf):
    return masks.encode(fx.marks(spark, sf), ("block",)).select("block", F.col("start").cast("long"), "len")


@query("mask_rle_blocks", runs_sql(f"SELECT block_idx, pos, CASE WHEN value = 0 THEN 'zero' ELSE 'nodata' END AS kind, value IN (0, -9999) AS mask FROM ({BLOCKS})", "block_idx, kind").replace("min(pos)", "min(pos)::BIGINT"))
def mask_rle_blocks(spark, sf):
    v = F.col("value")
    marked = masked_blocks(spark, sf).select("block_idx", "pos", F.when(v == 0, "zero").otherwise("nodata").alias("kind"), v.isin(0.0, -9999.0).alias("mask"))
    return masks.encode(marked, ("block_idx", "kind")).select("block_idx", "kind", F.col("start").cast("long"), "len")


@query("mask_rle_roundtrip", f"SELECT block, pos FROM ({fx.MARKS}) WHERE mask")
def mask_rle_roundtrip(spark, sf):
    return masks.decode(masks.encode(fx.marks(spark, sf), ("block",))).select("block", F.col("pos").cast("long"))


ZEROED = f"SELECT block_idx, pos, CASE WHEN value = -9999 THEN 0 ELSE value END AS value FROM ({BLOCKS})"
FILL_D = f"((a.pos // {N} - b.pos // {N}) * (a.pos // {N} - b.pos // {N}) + (a.pos % {N} - b.pos % {N}) * (a.pos % {N} - b.pos % {N})) * {N * N} + b.pos"


@query("nearest_fill", f"SELECT block_idx, pos, round(coalesce(f, value), 6) AS value FROM ({ZEROED}) LEFT JOIN (SELECT a.block_idx, a.pos, arg_min(b.value, {FILL_D}) AS f FROM ({ZEROED}) a JOIN ({ZEROED}) b ON a.block_idx = b.block_idx AND a.value = 0 AND b.value <> 0 GROUP BY 1, 2) USING (block_idx, pos)")
def nearest_fill(spark, sf):
    return blocks.fill(masked_blocks(spark, sf), N).select("block_idx", "pos", *r6("value"))


@query("zigzag_order", " UNION ALL ".join(f"SELECT {n} AS n, p::INT AS pos, row_number() OVER (ORDER BY p // {n} + p % {n}, CASE WHEN (p // {n} + p % {n}) % 2 = 0 THEN -(p // {n}) ELSE p // {n} END)::INT - 1 AS zz FROM range({n * n}) t(p)" for n in (4, 8, 16)))
def zigzag_order(spark, sf):
    return reduce(DataFrame.unionByName, [dct.zigzag_table(spark, n) for n in (4, 8, 16)])


def basis_sql(kind: int) -> str:
    a, b = ("u", "x") if kind != 3 else ("x", "u")
    if kind == 1:
        end = lambda k: f"CASE WHEN {k} IN (0, {N - 1}) THEN sqrt(0.5) ELSE 1 END"
        w = f"sqrt(2.0 / {N - 1}) * {end('u')} * {end('x')} * cos(pi() * u * x / {N - 1})"
    else:
        w = f"sqrt(CASE WHEN {a} = 0 THEN 1.0 ELSE 2.0 END / {N}) * cos(pi() * (2 * {b} + 1) * {a} / {2 * N})"
    return f"SELECT u, x, {w} AS w FROM range({N}) a(u), range({N}) b(x)"


def dct_sql(cells: str, kind: int, inverse: bool = False) -> str:
    b, (u, x) = basis_sql(kind), ("x", "u") if inverse else ("u", "x")
    return f"""SELECT block_idx, a.{u} * {N} + b.{u} AS pos, sum(c.value * a.w * b.w) AS value
FROM ({cells}) c JOIN ({b}) a ON a.{x} = c.pos // {N} JOIN ({b}) b ON b.{x} = c.pos % {N} GROUP BY 1, 2"""


@query("dct2_block", " UNION ALL ".join(f"SELECT {k} AS dct_type, block_idx, pos, round(value, 4) + 0.0 AS value FROM ({dct_sql(SMOOTH_BLOCKS, k)})" for k in (1, 2, 3)))
def dct2_block(spark, sf):
    return reduce(DataFrame.unionByName, [dct.transform(smooth_blocks(spark, sf), N, k).select(F.lit(k).alias("dct_type"), "block_idx", F.col("pos").cast("long").alias("pos"), (F.round("value", 4) + 0.0).alias("value")) for k in (1, 2, 3)])


@query("idct2_block", " UNION ALL ".join(f"SELECT {k} AS dct_type, block_idx, pos::BIGINT AS pos, round(value, 6) AS value FROM ({SMOOTH_BLOCKS})" for k in (1, 2, 3)))
def idct2_block(spark, sf):
    back = lambda k: dct.transform(dct.transform(smooth_blocks(spark, sf), N, k), N, k, inverse=True)
    return reduce(DataFrame.unionByName, [back(k).select(F.lit(k).alias("dct_type"), "block_idx", F.col("pos").cast("long").alias("pos"), *r6("value")) for k in (1, 2, 3)])


QUANTISED = f"SELECT block_idx, pos, round_even(round(value * {10**DECIMAL}, 6), 0)::BIGINT AS q FROM ({dct_sql(SMOOTH_BLOCKS, 2)})"


@query("quantised_coeffs", QUANTISED)
def quantised_coeffs(spark, sf):
    return dct.transform(smooth_blocks(spark, sf), N).select("block_idx", F.col("pos").cast("long").alias("pos"), quantise(F.col("value"), DECIMAL).alias("q"))


ZIGZAG = f"SELECT p AS pos, row_number() OVER (ORDER BY p // {N} + p % {N}, CASE WHEN (p // {N} + p % {N}) % 2 = 0 THEN -(p // {N}) ELSE p // {N} END) - 1 AS zz FROM range({N * N}) t(p)"
ERRORS = f"""SELECT block_idx, zz + 1 AS k, max(abs(value - made)) AS max_error, avg(abs(value - made)) AS mean_error FROM (
SELECT q.block_idx, a.x * {N} + b.x AS pixel, zz, sum(q.q / {10.0**DECIMAL}::DOUBLE * a.w * b.w) OVER (PARTITION BY q.block_idx, a.x * {N} + b.x ORDER BY zz) AS made
FROM ({QUANTISED}) q JOIN ({ZIGZAG}) z USING (pos) JOIN ({basis_sql(2)}) a ON a.u = pos // {N} JOIN ({basis_sql(2)}) b ON b.u = pos % {N}) m
JOIN (SELECT block_idx AS bi, pos AS pixel, value FROM ({SMOOTH_BLOCKS})) o ON o.bi = m.block_idx AND o.pixel = m.pixel GROUP BY 1, 2"""


def errors(spark, sf) -> DataFrame:
    b = smooth_blocks(spark, sf)
    c = dct.transform(b, N).select("block_idx", "pos", (quantise(F.col("value"), DECIMAL) / 10**DECIMAL).alias("value"))
    return prune.prefix_errors(b, c, N)


@query("prefix_error", f"SELECT block_idx, k, round(max_error, 6) AS max_error, round(mean_error, 6) AS mean_error FROM ({ERRORS})")
def prefix_error(spark, sf):
    return errors(spark, sf).select("block_idx", F.col("k").cast("long").alias("k"), *r6("max_error", "mean_error"))


MINIMAL = f"SELECT block_idx, coalesce(min(k) FILTER (max_error <= {ACCURACY}), {N * N}) AS k, coalesce(arg_min(max_error, k) FILTER (max_error <= {ACCURACY}), arg_max(max_error, k)) AS max_error FROM ({ERRORS}) GROUP BY 1"


@query("minimal_prefix", f"SELECT block_idx, k, round(max_error, 6) AS max_error FROM ({MINIMAL})")
def minimal_prefix(spark, sf):
    return prune.minimal_prefix(errors(spark, sf), ACCURACY, N * N).select("block_idx", F.col("k").cast("long").alias("k"), *r6("max_error"))


def config(**more) -> CompressionConfig:
    return CompressionConfig(accuracy=ACCURACY, block=N, decimal=DECIMAL, **more)


@query("codec_prefix", f"SELECT block_idx, k, round(max_error, 6) AS max_error FROM ({MINIMAL})")
def codec_prefix(spark, sf):
    """The prefix lengths of minimal_prefix by the numpy codec."""
    stream = codec.compress(blocks.tiles(smooth_blocks(spark, sf)), config())
    return stream.select("block_idx", F.size("coeffs").cast("long").alias("k"), *r6("max_error"))


@query("codec_valid", f"SELECT round(max(max_error), {DECIMAL + 2}) AS max_error, CASE WHEN max(max_error) >= {ACCURACY} THEN 'F' ELSE 'T' END AS valid FROM ({MINIMAL})")
def codec_valid(spark, sf):
    return codec.validity(codec.compress(blocks.tiles(smooth_blocks(spark, sf)), config()), config())


@query("roundtrip", f"SELECT (i // {fx.MASKED_W})::INT AS row, (i % {fx.MASKED_W})::INT AS col, true AS within FROM range({fx.MASKED_H * fx.MASKED_W}) t(i)")
def roundtrip(spark, sf):
    """Every cell of the masked raster comes back: NoData and zeros as they were, others within the accuracy."""
    source = masked_blocks(spark, sf)
    back = codec.decompress(codec.compress(blocks.tiles(source), config()), config())
    cells = blocks.merge(source, fx.MASKED_H, fx.MASKED_W, N).withColumnRenamed("value", "v")
    both = cells.join(blocks.merge(back, fx.MASKED_H, fx.MASKED_W, N), ["row", "col"])
    v, b = F.col("v"), F.col("value")
    return both.select("row", "col", F.when(v.isin(0.0, -9999.0), v == b).otherwise(F.abs(v - b) <= ACCURACY + 1e-9).alias("within"))


MOMENT = "avg((value - m) ^ {0})"


@query(
    "raster_descriptors",
    f"""WITH r AS (SELECT row, col, value FROM ({fx.SMOOTH})), v AS (SELECT value, avg(value) OVER () AS m FROM r WHERE value > -9999),
q AS (SELECT count(*) AS n, avg(value) AS mean, stddev_samp(value) AS stddev, max(value) - min(value) AS value_range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
avg((value - m) ^ 3) / avg((value - m) ^ 2) ^ 1.5 AS skewness, avg((value - m) ^ 4) / avg((value - m) ^ 2) ^ 2 - 3 AS kurtosis FROM v),
c AS (SELECT round(value, 2) AS r, count(*) AS c FROM v GROUP BY 1), e AS (SELECT count(*) AS n_unique, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM c),
g AS (SELECT (sum(a) + sum(b)) / (count(a) + count(b)) AS gradient FROM (SELECT abs(lead(value) OVER (PARTITION BY row ORDER BY col) - value) AS a, abs(lead(value) OVER (PARTITION BY col ORDER BY row) - value) AS b FROM r))
SELECT n, n_unique, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "stddev", "value_range", "iqr", "skewness", "kurtosis", "entropy", "gradient"))} FROM q, e, g""",
)
def raster_descriptors(spark, sf):
    d = descriptors.describe(fx.smooth(spark, sf))
    return d.select("n", "n_unique", *r6("mean", "stddev", "value_range", "iqr", "skewness", "kurtosis", "entropy", "gradient"))


NAME = "'r' || p_partkey || '_N' || (8 * (1 + p_size % 4)) || '_Acc' || round(0.01 * (1 + p_size % 9), 2) || '_tdct2_dec2'"


@query("archive_names", "SELECT p_partkey AS id, (8 * (1 + p_size % 4))::INT AS n, round(0.01 * (1 + p_size % 9), 2)::DOUBLE AS accuracy FROM part")
def archive_names(spark, sf):
    from ..sources.names import parse

    size = F.col("p_size")
    name = F.concat(F.lit("r"), F.col("p_partkey"), F.lit("_N"), 8 * (1 + size % 4), F.lit("_Acc"), F.round(0.01 * (1 + size % 9), 2), F.lit("_tdct2_dec2"))
    return parse(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))).select("id", "n", "accuracy")


# --- whole pipelines

RMIN_PAIRS = f"SELECT row, col, z, CASE WHEN d < {R_MIN} AND m IS NOT NULL THEN m / 2 ELSE d END AS d FROM (SELECT *, min(CASE WHEN d > {R_MIN} THEN d END) OVER (PARTITION BY row, col) AS m FROM ({PAIRS}))"


def filled_sql(value: str, pairs: str) -> str:
    return f"SELECT g.row, g.col, round(g.gx, 6) AS x, round(g.gy, 6) AS y, v.value, coalesce(v.value, -9999.0) AS value_out FROM ({nodes_sql(fx.POINTS, RES)}) g LEFT JOIN ({value_sql(value, pairs)}) v USING (row, col)"


def settings(**more) -> InterpolationConfig:
    return InterpolationConfig(neighbours=K, resolution=RES, max_distance=RADIUS, **more)


@query("interpolate_rmin", filled_sql("sum(z / (d * d)) / sum(1 / (d * d))", RMIN_PAIRS))
def interpolate_rmin(spark, sf):
    return interpolate(fx.points(spark, sf), settings(r_min=R_MIN))[0].select("row", "col", *r6("x", "y", "value", "value_out"))


@query("interpolate_knn", filled_sql("avg(z)", PAIRS))
def interpolate_knn(spark, sf):
    return interpolate(fx.points(spark, sf), settings(method="knn"))[0].select("row", "col", *r6("x", "y", "value", "value_out"))


@query("interpolate_relational", filled_sql("sum(z / (d * d)) / sum(1 / (d * d))", RMIN_PAIRS))
def interpolate_relational(spark, sf):
    return interpolate(fx.points(spark, sf), settings(r_min=R_MIN), fast=False)[0].select("row", "col", *r6("x", "y", "value", "value_out"))


@query("codec_bisect", f"SELECT block_idx, true AS within FROM (SELECT DISTINCT block_idx FROM ({SMOOTH_BLOCKS}))")
def codec_bisect(spark, sf):
    """The search by halving meets the accuracy too, with no shorter a prefix than the least one."""
    tiles = blocks.tiles(smooth_blocks(spark, sf))
    least = codec.compress(tiles, config()).select("block_idx", F.size("coeffs").alias("k"))
    found = codec.compress(tiles, config(search="bisect")).select("block_idx", F.size("coeffs").alias("n"), "max_error")
    return found.join(least, "block_idx").select("block_idx", (F.col("max_error").isNotNull() & (F.col("n") >= F.col("k"))).alias("within"))


# --- files: written below the shared folder, and read again


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return f"{at.rstrip('/')}/isogrid-{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix="isogrid-")


def mounted(folder: str) -> str:
    """The folder as a path for sinks that write a single file from the driver; made if need be."""
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"single-file sinks need a mounted folder, not {folder}")
    path = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
    os.makedirs(path, exist_ok=True)
    return path


WITHIN = "SELECT (i // 64)::INT AS row, (i % 64)::INT AS col, true AS within FROM range(4096) t(i)"


@query("csv_scan", f"SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({fx.POINTS})")
def csv_scan(spark, sf):
    from ..sources.points import read_points

    at = scratch(spark) + "/points.csv"
    fx.points(spark, sf).select("x", "y", "z").write.option("header", True).csv(at)
    return read_points(spark, at).select(*r6("x", "y", "z"))


@query("shapefile_roundtrip", f"SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({fx.LATTICE})")
def shapefile_roundtrip(spark, sf):
    from ..sinks.shapefile import write_shapefile
    from ..sources.points import read_points

    at = mounted(scratch(spark)) + "/points.shp"
    write_shapefile(fx.lattice(spark, sf), at)
    return read_points(spark, at).select(*r6("x", "y", "z"))


@query("geotiff_roundtrip", f"SELECT row, col, round(value::FLOAT::DOUBLE, 4) AS value FROM ({fx.SMOOTH})")
def geotiff_roundtrip(spark, sf):
    from ..sinks.geotiff import write_geotiff
    from ..sources.raster import read_raster

    at = mounted(scratch(spark)) + "/raster.tif"
    write_geotiff(fx.smooth(spark, sf), 64, 64, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "epsg:2180", at)
    return read_raster(spark, at).select("row", "col", F.round("value", 4).alias("value"))


@query("archive_roundtrip", WITHIN)
def archive_roundtrip(spark, sf):
    from ..sinks.tables import read_archive, write_archive
    from ..sources.raster import Raster

    at, source = scratch(spark) + "/archive", fx.smooth(spark, sf)
    write_archive(compress_raster(source, 64, 64, config()), Raster(64, 64, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "epsg:2180", -9999.0), config(), at, "r1")
    stream, head, cfg = read_archive(spark, at, "r1")
    back = decompress_raster(stream, head.height, head.width, cfg)
    return source.withColumnRenamed("value", "v").join(back, ["row", "col"]).select("row", "col", (F.abs(F.col("v") - F.col("value")) <= cfg.accuracy + 1e-9).alias("within"))


@query("archive_rewrite", f"SELECT count(*)::BIGINT AS n, count(DISTINCT block_idx)::BIGINT AS blocks FROM ({SMOOTH_BLOCKS}) WHERE pos = 0")
def archive_rewrite(spark, sf):
    """A raster that is written twice is there once."""
    from ..sinks.tables import read_archive, write_archive
    from ..sources.raster import Raster

    at = scratch(spark) + "/archive"
    for _ in range(2):
        write_archive(compress_raster(fx.smooth(spark, sf), 64, 64, config()), Raster(64, 64, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "epsg:2180", -9999.0), config(), at, "r1")
    return read_archive(spark, at, "r1")[0].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block_idx").alias("blocks"))


@query("geotiff_lzw", f"SELECT row, col, round(value::FLOAT::DOUBLE, 4) AS value FROM ({fx.SMOOTH})")
def geotiff_lzw(spark, sf):
    from ..sinks.geotiff import write_geotiff
    from ..sources.raster import read_raster

    at = mounted(scratch(spark)) + "/raster.tif"
    write_geotiff(fx.smooth(spark, sf), 64, 64, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "epsg:2180", at, lzw=True)
    return read_raster(spark, at).select("row", "col", F.round("value", 4).alias("value"))


@query("ascii_grid_scan", f"SELECT row, col, round(value, 6) AS value FROM ({fx.SMOOTH})")
def ascii_grid_scan(spark, sf):
    from ..sinks.surfer import lines
    from ..sources.raster import RasterSource

    at = mounted(scratch(spark)) + "/raster.asc"
    with open(at, "w") as f:
        f.write("ncols 64\nnrows 64\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n")
        for r in lines(fx.smooth(spark, sf)).orderBy("row").toLocalIterator():
            f.write(r.line + "\n")
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").option("cellsPerPartition", 640).load(at).select("row", "col", F.round("value", 6).alias("value"))


@query("las_scan", f"SELECT round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, (CASE WHEN id % 3 = 0 THEN 2 ELSE 5 END)::INT AS classification FROM ({fx.LATTICE}) WHERE id % 3 = 0")
def las_scan(spark, sf):
    from ..sinks.las import write_las
    from ..sources.points import read_points

    at = mounted(scratch(spark)) + "/points.las"
    write_las(fx.lattice(spark, sf).withColumn("classification", F.when(F.col("id") % 3 == 0, 2).otherwise(5)), at)
    return read_points(spark, at).filter("classification = 2").select(*[F.round(c, 3).alias(c) for c in "xyz"], "classification")


@query("geoid_scan", f"SELECT x, y, round(undulation, 6) AS undulation FROM ({fx.GEOID})")
def geoid_scan(spark, sf):
    from ..sources.points import read_geoid

    at = scratch(spark) + "/geoid"
    fx.geoid(spark, sf).selectExpr("x", "y", "undulation").write.option("sep", " ").csv(at)
    return read_geoid(spark, at).select("x", "y", F.round("undulation", 6).alias("undulation"))


@query("csv_result", filled_sql("avg(z)", PAIRS).replace(", v.value, coalesce(v.value, -9999.0) AS value_out", ", v.value").replace("SELECT g.row, g.col, ", "SELECT ", 1))
def csv_result(spark, sf):
    from ..sinks.tables import write_csv

    at = scratch(spark) + "/grid.csv"
    write_csv(interpolate(fx.points(spark, sf), settings(method="knn"))[0], at)
    return spark.read.schema("x double, y double, value double").option("header", True).csv(at).select(*r6("x", "y", "value"))


@query("files_end_to_end", f"SELECT row, col, true AS within FROM (SELECT row, col FROM ({nodes_sql(fx.POINTS, RES)}))")
def files_end_to_end(spark, sf):
    """Point file to GeoTIFF, that to an archive, and back: within the accuracy of the grid."""
    from ..sources.raster import read_raster
    from .files import compress_files, decompress_files, interpolate_files

    at = mounted(scratch(spark))
    fx.points(spark, sf).select("x", "y", "z").coalesce(1).write.option("header", True).csv(f"{at}/in")
    part = next(f for f in os.listdir(f"{at}/in") if f.endswith(".csv"))
    os.rename(f"{at}/in/{part}", f"{at}/in/points.csv")
    grid = interpolate_files(spark, f"{at}/in/points.csv", settings(method="knn"), f"{at}/grid")
    compress_files(spark, f"{at}/grid", config(), f"{at}/archive")
    back = decompress_files(spark, f"{at}/archive", f"{at}/back")
    one, two = read_raster(spark, grid[0]), read_raster(spark, back[0])
    return one.withColumnRenamed("value", "v").join(two, ["row", "col"]).select("row", "col", (F.abs(F.col("v") - F.col("value")) <= ACCURACY + 1e-4).alias("within"))
