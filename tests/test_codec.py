"""Transforms, prefixes and the codec."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isogrid.config import CompressionConfig
from isogrid.operators import blocks, codec, dct
from isogrid.operators.prune import Prefixes
from isogrid.plans.pipelines import compress_raster, decompress_raster


@pytest.mark.parametrize("kind", [1, 2, 3])
@pytest.mark.parametrize("n", [2, 4, 8, 16, 32, 64])
def test_basis_is_orthonormal(n, kind):
    c = dct.basis(n, kind)
    assert np.allclose(c @ c.T, np.eye(n))


def test_zigzag():
    assert [divmod(int(p), 4) for p in dct.zigzag(4)[:6]] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)]
    assert sorted(dct.zigzag(3, 5)) == list(range(15))


@given(st.lists(st.booleans(), max_size=80))
@settings(max_examples=60, deadline=None)
def test_runs(mask):
    found = codec.runs(np.array(mask, bool))
    out = np.zeros(len(mask), bool)
    for s, n in found:
        assert n > 0 and not out[s : s + n].any() and (s == 0 or not mask[s - 1])
        out[s : s + n] = True
    assert out.tolist() == mask


@pytest.mark.parametrize("kind", [1, 2, 3])
@pytest.mark.parametrize("n", [4, 8, 16])
def test_block_round_trip(n, kind):
    r = np.random.default_rng(n + kind)
    for tile in (r.normal(size=(n, n)) * 10, np.add.outer(np.arange(n), np.arange(n)) * 0.1 + 5, np.full((n, n), 3.0), np.indices((n, n)).sum(0) % 2 + 1.0):
        cfg = CompressionConfig(accuracy=0.1, block=n, decimal=3, dct_type=kind)
        coeffs, error = codec.encode_block(tile, cfg)
        back = codec.decode_block(coeffs, n, cfg.decimal, kind)
        assert error <= 0.1 and np.isclose(np.abs(back - tile).max(), error, atol=1e-9)


def test_search_by_halving_never_beats_the_minimum():
    r = np.random.default_rng(0)
    for n in (4, 8, 16):
        for _ in range(10):
            tile = np.cumsum(r.normal(size=(n, n)), axis=1)
            c = dct.basis(n)
            p = Prefixes(np.round(c @ tile @ c.T, 2), tile, 2)
            assert p.bisect(0.2)[0] >= p.minimal(0.2)[0] and min(p.errors[1 : p.minimal(0.2)[0]], default=1) > 0.2


def test_unreachable_accuracy_is_flagged(spark):
    tile = np.random.default_rng(2).normal(size=(8, 8))
    t = spark.createDataFrame([(0, tile.ravel().tolist())], "block_idx int, pixels array<double>")
    cfg = CompressionConfig(accuracy=0.001, block=8, decimal=0)
    s = codec.compress(t, cfg)
    assert codec.validity(s, cfg).first().valid == "F" and len(s.first().coeffs) == 64


def test_kinds(spark):
    plain = np.arange(1.0, 17.0)
    rows = [(0, [0.0] * 16), (1, [-9999.0] * 16), (2, [0.0] * 8 + [-9999.0] * 8), (3, [0.0, -9999.0, *plain[2:].tolist()]), (4, plain.tolist())]
    cfg = CompressionConfig(accuracy=0.05, block=4)
    stream = codec.compress(spark.createDataFrame(rows, "block_idx int, pixels array<double>"), cfg)
    got = {r.block_idx: r for r in stream.collect()}
    assert [got[i].kind for i in range(5)] == ["zero", "nodata", "mixed", "mixed", "data"]
    back = {i: [0.0] * 16 for i in range(5)}
    for r in codec.decompress(stream, cfg).collect():
        back[r.block_idx][r.pos] = r.value
    for i, pixels in rows:
        for a, b in zip(pixels, back[i]):
            assert a == b if a in (0.0, -9999.0) else abs(a - b) <= 0.05


@pytest.mark.parametrize("block", [4, 16, 32])
def test_raster_round_trip_with_holes(spark, block):
    h, w = 37, 50
    r = np.random.default_rng(block)
    a = np.cumsum(np.cumsum(r.normal(size=(h, w)), 0), 1) * 0.1 + 50
    cells = [(i, j, float(a[i, j])) for i in range(h) for j in range(w) if (i * j) % 11]
    cfg = CompressionConfig(accuracy=0.05, block=block)
    df = spark.createDataFrame(cells, "row int, col int, value double")
    back = {(x.row, x.col): x.value for x in decompress_raster(compress_raster(df, h, w, cfg), h, w, cfg).collect()}
    have = {(i, j): v for i, j, v in cells}
    assert len(back) == h * w
    for k, v in back.items():
        assert v == -9999.0 if k not in have else abs(v - have[k]) <= 0.05


def test_single_coefficient_of_minus_one_is_not_nodata(spark):
    cfg = CompressionConfig(accuracy=0.05, block=4, decimal=2)
    tile = np.full(16, -0.0025).tolist()
    s = codec.compress(spark.createDataFrame([(0, tile)], "block_idx int, pixels array<double>"), cfg)
    assert s.first().kind == "data" and all(abs(r.value) < 0.06 for r in codec.decompress(s, cfg).collect())


def test_empty_and_all_nodata_rasters(spark):
    cfg = CompressionConfig(block=8)
    none = spark.createDataFrame([], "row int, col int, value double")
    s = compress_raster(none, 8, 8, cfg)
    assert [r.kind for r in s.collect()] == ["nodata"] and codec.validity(s, cfg).first().valid == "T"
    assert blocks.kinds(blocks.split(none, 5, 5, 8)).first().kind == "mixed"
