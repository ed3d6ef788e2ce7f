"""Points, neighbours and estimates against brute force, and their properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isogrid.config import InterpolationConfig
from isogrid.functions.scalars import cut_to_cells
from isogrid.operators import clean, estimate, geoid, grid, knn, smooth
from isogrid.plans.pipelines import interpolate, interpolate_tiles, relational


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


def cloud(n=300, seed=1, side=30.0):
    r = np.random.default_rng(seed)
    return [(i, *(float(v) for v in r.uniform(0, side, 2)), float(r.normal())) for i in range(n)]


def brute(points, g, k, radius, method="idw", power=2.0, r_min=None):
    out = {}
    for i in range(g.nrow):
        for j in range(g.ncol):
            x, y = g.x0 + j * g.dx, g.y0 + i * g.dy
            near = sorted(((x - p[1]) ** 2 + (y - p[2]) ** 2, p[0], p[3]) for p in points if (x - p[1]) ** 2 + (y - p[2]) ** 2 < radius * radius)[:k]
            if not near:
                out[i, j] = None
                continue
            d, z = np.sqrt([q[0] for q in near]), np.array([q[2] for q in near])
            if method == "knn":
                out[i, j] = z.mean()
                continue
            if r_min is not None and (d > r_min).any():
                d = np.where(d < r_min, d[d > r_min].min() / 2, d)
            if (d == 0).any():
                d = np.where(d == 0, d[d > 0].min() / 2 if (d > 0).any() else 1.0, d)
            out[i, j] = float((z / d**power).sum() / (1 / d**power).sum())
    return out


def check(df, want):
    got = {(r.row, r.col): r.value for r in df.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9)), k


@pytest.mark.parametrize("v,res,want", [(10.3, 0.5, 10), (10.76, 0.5, 11), (17, 10, 24), (12, 10, 14), (-3.3, 0.5, -3), (-3.9, 0.5, -3), (10.95, 0.1, 10), (10.3, 0.3, 10)])
def test_cut_to_cells(spark, v, res, want):
    assert spark.range(1).select(cut_to_cells(F.lit(float(v)), res)).first()[0] == want


@pytest.mark.parametrize("method,r_min", [("idw", None), ("knn", None), ("idw", 1.0)])
@pytest.mark.parametrize("k,radius", [(1, 3.0), (5, 4.0), (500, 2.0)])
def test_both_paths_equal_brute_force(spark, method, r_min, k, radius):
    rows = cloud()
    p = frame(spark, rows)
    g = grid.grid_of(p, 2.0)
    want = brute(rows, g, k, radius, method, r_min=r_min)
    check(interpolate_tiles(p, g, k, radius, method, r_min=r_min), want)
    check(relational(p, g, InterpolationConfig(neighbours=k, resolution=2.0, max_distance=radius, method=method, r_min=r_min)), want)


def test_ties_and_exact_hits_follow_ids(spark):
    rows = [(i * 10 + j, float(i), float(j) - 0.5, float(i * j)) for i in range(10) for j in range(10)]
    p = frame(spark, rows[::-1])
    g = grid.grid_of(p, 1.0)
    for k in (1, 3, 4, 7):
        want = brute(rows, g, k, 2.0)
        check(interpolate_tiles(p, g, k, 2.0), want)
        check(relational(p, g, InterpolationConfig(neighbours=k, resolution=1.0, max_distance=2.0)), want)


def test_distance_equal_to_radius_is_out(spark):
    q = spark.createDataFrame([(0, 0, 0.0, 0.0)], "row int, col int, gx double, gy double")
    p = frame(spark, [(1, 3.0, 0.0, 1.0), (2, 0.0, -2.0, 2.0)])
    assert [r.id for r in knn.knn_join(q, p, 5, 3.0).collect()] == [2]


def test_r_min_itself_is_unchanged(spark):
    pairs = spark.createDataFrame([(0, 0, d, 1.0) for d in (0.5, 1.0, 3.0)] + [(0, 1, 0.2, 1.0)], "row int, col int, d double, z double")
    assert sorted(r.d for r in estimate.reduce_r_min(pairs, 1.0).collect()) == [0.2, 1.0, 1.5, 3.0]


def test_values_lie_between_neighbours_and_order_is_free(spark):
    rows = cloud(100, 3)
    a = {(r.row, r.col): r.value for r in interpolate(frame(spark, rows), InterpolationConfig(resolution=3.0))[0].collect()}
    b = {(r.row, r.col): r.value for r in interpolate(frame(spark, rows[::-1]), InterpolationConfig(resolution=3.0, weights=0.5))[0].collect()}
    z = [r[3] for r in rows]
    assert a == b and all(v is None or min(z) - 1e-9 <= v <= max(z) + 1e-9 for v in a.values())


def test_single_point_and_none(spark):
    out, g = interpolate(frame(spark, [(1, 5.0, 5.0, 2.0)]), InterpolationConfig(neighbours=1, resolution=1.0))
    assert [r.value for r in out.collect()] == [2.0] and (g.nrow, g.ncol) == (1, 1)
    with pytest.raises(ValueError):
        interpolate(frame(spark, []), InterpolationConfig())


def test_weights_zero_is_nodata(spark):
    out, _ = interpolate(frame(spark, cloud(20)), InterpolationConfig(resolution=5.0, weights=0))
    assert {r.value_out for r in out.collect()} == {-9999.0}


def test_clean_drops_null_nan_and_nodata(spark):
    rows = [(1, 1.0, 1.0, 1.0), (2, float("nan"), 1.0, 1.0), (3, 1.0, -9999.0, 1.0), (4, 1.0, 1.0, None)]
    assert [r.id for r in clean.drop_invalid(frame(spark, rows)).collect()] == [1]


def test_geoid(spark):
    model = spark.createDataFrame([(1, 0.0, 0.0, 0.5), (2, 10.0, 0.0, 2.0)], "id long, x double, y double, undulation double")
    got = {r.id: r.z for r in geoid.correct(frame(spark, [(1, 1.0, 0.0, 5.0), (2, 9.0, 0.0, 5.0), (3, 50.0, 50.0, 5.0)]), model, 5.0).collect()}
    assert got == {1: 4.5, 2: 3.0, 3: 5.0}


def test_compat_forms(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0, 10.0), (0, 0, 2.0, 20.0), (0, 1, 0.0, 3.0)], "row int, col int, d double, z double")
    missing = {r.col: r.value for r in estimate.idw_missing_as_zero(pairs, 3).collect()}
    assert abs(missing[0]) < 1e-8
    assert {r.value for r in estimate.idw_poisoned(pairs, 3).collect()} == {None}


@pytest.mark.parametrize("shape,sigma", [((9, 7), 1.0), ((3, 20), 1.0), ((2, 1), 2.0)])
def test_gaussian(spark, shape, sigma):
    h, w = shape
    a = np.random.default_rng(0).normal(size=shape)
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(h) for j in range(w)], "row int, col int, value double")
    k = np.array(smooth.kernel(sigma))
    r = len(k) // 2
    pad = np.pad(a, r, mode="symmetric")
    pad = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, pad)
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, pad)
    for x in smooth.gaussian(cells, sigma, h, w).collect():
        assert math.isclose(x.value, want[x.row, x.col], abs_tol=1e-12)


def test_gaussian_spreads_nan(spark):
    cells = spark.range(21 * 21).select((F.col("id") / 21).cast("int").alias("row"), (F.col("id") % 21).cast("int").alias("col")).withColumn("value", F.when((F.col("row") == 10) & (F.col("col") == 10), float("nan")).otherwise(1.0))
    out = {(r.row, r.col): r.value for r in smooth.gaussian(cells, 1.0, 21, 21).collect()}
    assert all(math.isnan(v) == (abs(i - 10) <= 4 and abs(j - 10) <= 4) for (i, j), v in out.items())
    assert all(math.isclose(v, 1.0) for v in out.values() if not math.isnan(v))
