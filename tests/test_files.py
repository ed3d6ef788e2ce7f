"""Sources and sinks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isogrid.config import CompressionConfig, InterpolationConfig, archive_name, crs_label, grid_name
from isogrid.operators.grid import Grid
from isogrid.plans.pipelines import compress_raster, decompress_raster
from isogrid.sinks.geotiff import write_geotiff
from isogrid.sinks.shapefile import write_shapefile
from isogrid.sinks.surfer import write_surfer
from isogrid.sinks.tables import read_archive, write_archive, write_csv
from isogrid.sources import points, raster
from isogrid.sources.names import parse


def cells_of(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "row int, col int, value double")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = r.value
    return out


def test_text_and_dispatch(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x,y,z\n1,2,3\n4,5,-9999\n")
    rows = points.read_points(spark, str(tmp_path / "a.TXT")).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.source_id) for r in rows] == [(1.0, 2.0, 3.0, "a.TXT"), (4.0, 5.0, -9999.0, "a.TXT")]
    with pytest.raises(ValueError):
        points.read_points(spark, "a.xyz")
    with pytest.raises(NotImplementedError):
        points.read_points(spark, "a.laz")


def test_geoid_file(spark, tmp_path):
    (tmp_path / "g.csv").write_text("19.0 52.0 34.5\n19.5 52.0 35.25\n")
    assert sorted((r.x, r.undulation) for r in points.read_geoid(spark, str(tmp_path / "g.csv")).collect()) == [(19.0, 34.5), (19.5, 35.25)]


def test_shapefile_round_trip(spark, tmp_path):
    want = [(1.5, -2.25, 3.125), (1000000.5, 0.0, -0.5)]
    write_shapefile(spark.createDataFrame(want, "x double, y double, z double"), str(tmp_path / "p.shp"))
    assert sorted((r.x, r.y, r.z) for r in points.read_points(spark, str(tmp_path / "p.shp")).collect()) == sorted(want)
    head = (tmp_path / "p.shp").read_bytes()
    assert struct.unpack(">i", head[:4])[0] == 9994 and struct.unpack(">i", head[24:28])[0] * 2 == len(head)


def las(path, xyz, cls, fmt=0):
    length = 20 if fmt == 0 else 30
    h = bytearray(227 if fmt == 0 else 375)
    h[:4], h[24], h[25] = b"LASF", 1, 2 if fmt == 0 else 4
    struct.pack_into("<HIIBHI", h, 94, len(h), len(h), 0, fmt, length, len(xyz) if fmt == 0 else 0)
    struct.pack_into("<6d", h, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    if fmt:
        struct.pack_into("<Q", h, 247, len(xyz))
    body = b""
    for (x, y, z), c in zip(xyz, cls):
        r = bytearray(length)
        struct.pack_into("<3i", r, 0, round((x - 100) * 100), round((y - 200) * 100), round(z * 100))
        r[15 if fmt == 0 else 16] = c
        body += r
    path.write_bytes(bytes(h) + body)


@pytest.mark.parametrize("fmt", [0, 6])
def test_las(spark, tmp_path, fmt):
    las(tmp_path / "c.las", [(101.5, 202.25, 7.0), (99.0, 199.0, -1.0), (100.0, 200.0, 0.0)], [2, 5, 2], fmt)
    df = points.read_points(spark, str(tmp_path / "c.las"))
    assert sorted((r.x, r.y, r.z, r.classification) for r in df.collect()) == [(99.0, 199.0, -1.0, 5), (100.0, 200.0, 0.0, 2), (101.5, 202.25, 7.0, 2)]
    assert points.read_points(spark, str(tmp_path / "c.las")).filter("classification = 2").count() == 2


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "r.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 0.5\nNODATA_value -1\n1 2 3\n4 -1 6\n")
    a = array_of(raster.read_raster(spark, str(tmp_path / "r.asc")), (2, 3))
    assert a.tolist() == [[1, 2, 3], [4, -9999, 6]]
    assert raster.header(str(tmp_path / "r.asc")).transform == (0.5, 0.0, 10.0, 0.0, -0.5, 21.0)


def test_geotiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(300, 270)).astype(np.float32).astype(float)
    a[5, 7] = -9999.0
    path = str(tmp_path / "t.tif")
    at = (0.5, 0.0, 100.0, 0.0, 0.5, 49.5)
    write_geotiff(cells_of(spark, a), 300, 270, at, "epsg:2180", path)
    h = raster.header(path)
    assert (h.height, h.width, h.transform, h.crs, h.nodata) == (300, 270, at, "epsg:2180", -9999.0)
    assert np.array_equal(array_of(raster.read_raster(spark, path), (300, 270)), a)


def strip_tiff(path, a, predictor):
    h, w = a.shape
    if predictor == 3:
        raw = np.ascontiguousarray(a.astype(">f4")).view(np.uint8).reshape(h, w, 4).transpose(0, 2, 1).reshape(h, w * 4)
        raw = np.c_[raw[:, :1], np.diff(raw.astype(np.int16), axis=1).astype(np.uint8)].tobytes()
    else:
        raw = a.astype("<f4").tobytes()
    data = zlib.compress(raw)
    tags = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (317, 3, predictor), (339, 3, 3)]
    data += b"\0" * (len(data) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    path.write_bytes(b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd)


@pytest.mark.parametrize("predictor", [1, 3])
def test_strip_tiff(spark, tmp_path, predictor):
    a = np.random.default_rng(2).normal(size=(6, 9)).astype(np.float32)
    strip_tiff(tmp_path / "s.tif", a, predictor)
    assert np.array_equal(array_of(raster.read_raster(spark, str(tmp_path / "s.tif")), a.shape), a.astype(float))


def test_surfer_and_csv(spark, tmp_path):
    g = Grid(0, 0, 2, 1, 1.0)
    df = spark.createDataFrame([(i, j, g.x0 + j, g.y0 + i, float(i * 3 + j), float(i * 3 + j)) for i in range(2) for j in range(3)], "row int, col int, x double, y double, value double, value_out double")
    write_surfer(df, g, str(tmp_path / "g.grd"))
    lines = (tmp_path / "g.grd").read_text().splitlines()
    assert lines == ["DSAA", "3 2", "0 2", "0 1", "0.0 5.0", "0.000000 1.000000 2.000000", "3.000000 4.000000 5.000000"]
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6


def test_archive_round_trip(spark, tmp_path):
    a = np.add.outer(np.arange(20) * 0.3, np.arange(30) * 0.2)
    cfg = CompressionConfig(block=8)
    head = raster.Raster(20, 30, (1.0, 0, 0, 0, 1.0, 0), "epsg:2180", -9999.0)
    write_archive(compress_raster(cells_of(spark, a), 20, 30, cfg), head, cfg, str(tmp_path / "arc"), "r1")
    stream, h, c = read_archive(spark, str(tmp_path / "arc"), "r1")
    assert (h.height, h.width, c.block, c.dct_type) == (20, 30, 8, 2)
    assert np.abs(array_of(decompress_raster(stream, h.height, h.width, c), (20, 30)) - a).max() <= cfg.accuracy


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"N": 7, "resolution": 2, "idw_dask": false, "idw_numpy": true, "smooth_result": true, "smooth_level": 2, "filter_las": true, "filter_classes": [2, 3], "r_min_function": false, "r_min": 0.5}')
    c = InterpolationConfig.load(str(tmp_path / "c.json"))
    assert (c.neighbours, c.method, c.smooth_sigma, c.classes, c.r_min) == (7, "idw", 2.0, (2, 3), None)
    (tmp_path / "d.json").write_text('{"accuracy": 0.1, "matrix": 32, "decimal": 1, "type_dct": 3, "sourceCrs_force_declare": "epsg:32633"}')
    d = CompressionConfig.load(str(tmp_path / "d.json"))
    assert (d.accuracy, d.block, d.decimal, d.dct_type) == (0.1, 32, 1, 3)
    assert crs_label("EPSG:2180", "") == "2180" and grid_name("b", c) == "b-N-7-R-2-dist-5.0"
    assert archive_name("b", d, "2180", True) == "b_N32_Acc0.1_tdct3_dec1_CRS2180_VT"
    with pytest.raises(ValueError):
        InterpolationConfig(neighbours=0)


def test_names(spark):
    df = spark.createDataFrame([("a_N16_Acc0.05_tdct2",), ("plain",)], "name string")
    assert [(r.n, r.accuracy) for r in parse(df).orderBy(F.col("n").desc_nulls_last()).collect()] == [(16, 0.05), (None, None)]


def test_ingest(spark, tmp_path):
    from isogrid.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("x,y,z\n1,1,1\n2,2,-9999\n")
    for k in (1, 2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == k
        (tmp_path / "in/b.csv").write_text("x,y,z\n3,3,3\n")


def packed_tiff(path, a, packing, big=False, order="<", strip=4):
    """Strips of `strip` rows under any of the packings, in a classic TIFF or a BigTIFF."""
    from isogrid.functions.packing import pack_lzw

    def packbits(b):
        out, i = b"", 0
        while i < len(b):
            n = 1
            while i + n < len(b) and n < 128 and b[i + n] == b[i]:
                n += 1
            out += bytes([257 - n, b[i]]) if n > 1 else bytes([0, b[i]])
            i += n
        return out + b"\x80"

    h, w = a.shape
    f = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: packbits}[packing]
    strips = [f(a[i : i + strip].astype(order + "f4").tobytes()) for i in range(0, h, strip)]
    head, word = (16, "Q") if big else (8, "I")
    at = np.cumsum([head, *map(len, strips)]).tolist()
    kind = 16 if big else 4
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32]), (259, 3, [packing]), (273, kind, at[:-1]), (277, 3, [1]), (278, 4, [strip]), (279, kind, [len(s) for s in strips]), (339, 3, [3])]
    late, entries, ifd = b"", b"", at[-1]
    size = struct.calcsize("<" + word)
    base = ifd + (8 if big else 2) + len(tags) * (12 if not big else 20) + size
    for tag, k, v in tags:
        raw = struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 16: 'Q'}[k]}", *v)
        entries += struct.pack(order + "HH" + word, tag, k, len(v))
        if len(raw) > size:
            entries += struct.pack(order + word, base + len(late))
            late += raw
        else:
            entries += raw.ljust(size, b"\0")
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, ifd) if big else struct.pack(order + "HI", 42, ifd))
    path.write_bytes(start + b"".join(strips) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * size + late)


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("big, order", [(False, "<"), (True, "<"), (True, ">")])
def test_packings_and_big_tiff(spark, tmp_path, packing, big, order):
    a = np.round(np.random.default_rng(packing).normal(size=(10, 37)), 1).astype(np.float32)
    a[3:6] = 0
    packed_tiff(tmp_path / "p.tif", a, packing, big, order)
    assert np.array_equal(array_of(raster.read_raster(spark, str(tmp_path / "p.tif")), a.shape), a.astype(float))


@pytest.mark.parametrize("size, letters", [(0, 1), (1, 2), (700, 1), (9000, 4), (60_000, 256)])
def test_lzw_round_trip(size, letters):
    from isogrid.functions.packing import pack_lzw, unpack_lzw

    data = np.random.default_rng(size).integers(0, letters, size).astype(np.uint8).tobytes()
    assert unpack_lzw(pack_lzw(data)) == data


def test_ascii_grid_in_parts(spark, tmp_path):
    a = np.arange(7 * 5, dtype=float).reshape(7, 5)
    (tmp_path / "r.asc").write_text("ncols 5\nnrows 7\nxllcorner 0\nyllcorner 0\ncellsize 1\n" + "\n".join(" ".join(map(str, r)) for r in a) + "\n")
    spark.dataSource.register(raster.RasterSource)
    df = spark.read.format("raster").option("cellsPerPartition", 10).load(str(tmp_path / "r.asc"))
    assert df.rdd.getNumPartitions() == 4 and np.array_equal(array_of(df, a.shape), a)


def test_files_end_to_end(spark, tmp_path):
    """A folder of point files: one grid each, less the geoid, and in each format; into one archive, and back."""
    import dataclasses

    from isogrid.plans.files import compress_files, decompress_files, interpolate_files

    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(3)
    for name, level in (("a.csv", 10.0), ("b.txt", 50.0)):
        rows = [f"{x},{y},{level + 0.1 * x}" for x, y in rng.uniform(0, 12, (150, 2))]
        (tmp_path / "in" / name).write_text("x,y,z\n" + "\n".join(rows) + "\n")
    write_shapefile(spark.createDataFrame([(float(x), float(y), 7.0) for x in range(6) for y in range(6)], "x double, y double, z double"), str(tmp_path / "in/c.shp"))
    cfg = InterpolationConfig(neighbours=5, resolution=1.0, max_distance=6.0)
    tifs = interpolate_files(spark, str(tmp_path / "in"), cfg, str(tmp_path / "out"), ("tif", "csv", "grd", "shp"))
    assert sorted(p.rsplit("/", 1)[1] for p in tifs if p.endswith(".tif")) == [grid_name(b, cfg) + ".tif" for b in "abc"] and len(tifs) == 12
    means = [np.mean([r.value for r in raster.read_raster(spark, f"{tmp_path}/out/{grid_name(b, cfg)}.tif").collect()]) for b in "abc"]
    assert abs(means[1] - means[0] - 40) < 0.5 and abs(means[2] - 7) < 1e-6
    (tmp_path / "geoid.txt").write_text("".join(f"{x} {y} 3.0\n" for x in range(0, 13, 4) for y in range(0, 13, 4)))
    lower = dataclasses.replace(cfg, geoid_file="./geoid.txt", geoid_crs="epsg:2180", geoid_radius=10.0)
    interpolate_files(spark, str(tmp_path / "in/c.shp"), lower, str(tmp_path / "low"), root=str(tmp_path))
    assert {r.value for r in raster.read_raster(spark, str(tmp_path / "low")).collect()} == {4.0}
    missing = dataclasses.replace(cfg, geoid_file="none.txt")
    with pytest.raises(Exception):
        interpolate_files(spark, str(tmp_path / "in/c.shp"), missing, str(tmp_path / "x"))
    interpolate_files(spark, str(tmp_path / "in/c.shp"), missing, str(tmp_path / "skip"), on_geoid_error="skip")
    assert {r.value for r in raster.read_raster(spark, str(tmp_path / "skip")).collect()} == {7.0}
    code = CompressionConfig(block=8)
    for _ in range(2):
        names = compress_files(spark, f"{tmp_path}/out/*.tif", code, str(tmp_path / "archive"))
    assert len(names) == 3 and all(n.endswith("_CRS2180_VT") for n in names)
    back = decompress_files(spark, str(tmp_path / "archive"), str(tmp_path / "back"))
    assert len(back) == 3
    for b, p in zip("abc", back):
        src = f"{tmp_path}/out/{grid_name(b, cfg)}.tif"
        h, g = raster.header(src), raster.header(p)
        assert (h.transform, h.crs) == (g.transform, g.crs)
        shape = (h.height, h.width)
        assert np.abs(array_of(raster.read_raster(spark, src), shape) - array_of(raster.read_raster(spark, p), shape)).max() <= code.accuracy + 1e-4
