"""Rules of rasters, tiles, terrain, sources and fingerprints, each against a plain version."""

import random
import struct
import zlib

import numpy as np
import pytest

from orelode.functions import RAMPS
from orelode.operators import grids, magnetics, tiles, versions


def pixels(data: bytes) -> np.ndarray:
    w, h = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += size + 12
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)


def colour(t, palette):
    stops = RAMPS[palette]
    t = min(max(t, 0.0), 1.0)
    for a, b in zip(stops, stops[1:]):
        if t <= b[0]:
            return [int(np.floor(a[k] + (t - a[0]) / (b[0] - a[0]) * (b[k] - a[k]) + 0.5)) for k in (1, 2, 3)]
    return list(stops[-1][1:])


def plain_tile(base, z, x, y, size):
    """One pixel after another: centres, two by two blend in single precision, half added and cut."""
    h, w, _ = base.shape
    out = np.zeros((size, size, 4), np.uint8)
    f32 = np.float32
    for j in range(size):
        for i in range(size):
            px, py = (max((t + (k + 0.5) / size) / 2**z * n - 0.5, 0.0) for t, k, n in ((x, i, w), (y, j, h)))
            x0, y0 = min(int(px), w - 1), min(int(py), h - 1)
            x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
            fx, fy = f32(px - np.floor(px)), f32(py - np.floor(py))
            for c in range(4):
                top = f32(base[y0, x0, c]) * (1 - fx) + f32(base[y0, x1, c]) * fx
                low = f32(base[y1, x0, c]) * (1 - fx) + f32(base[y1, x1, c]) * fx
                out[j, i, c] = int(top * (1 - fy) + low * fy + f32(0.5))
    return out


@pytest.mark.parametrize(("nx", "ny", "block", "zoom", "gaps"), [(13, 9, 4, 2, True), (5, 7, 256, 3, True), (16, 16, 8, 1, False)])
def test_tiles_equal_blending_the_base_image(spark, nx, ny, block, zoom, gaps):
    r = random.Random(nx)
    # A whole corner is missing, so some deep tiles have no cell at all.
    v = {(i, j): r.uniform(-3, 9) for i in range(nx) for j in range(ny) if not gaps or (r.random() > 0.2 and not (i < nx / 2 and j < ny / 2))}
    grid = spark.createDataFrame([(i, j, x) for (i, j), x in v.items()] + ([(0, 0, None)] if gaps else []), "ix int, iy int, v double").repartition(3)
    lo, hi = min(v.values()), max(v.values())
    base = np.zeros((ny, nx, 4), np.uint8)
    for (i, j), x in v.items():
        base[ny - 1 - j, i] = [*colour((x - lo) / (hi - lo), "viridis"), 184]
    got = {(t.z, t.x, t.y): pixels(t.png) for t in tiles.tile_pyramid(grid, {"nx": nx, "ny": ny}, "viridis", 0.72, 8, zoom, block=block).collect()}
    assert len(got) == sum(4**z for z in range(zoom + 1))
    for (z, x, y), image in got.items():
        assert (image == plain_tile(base, z, x, y, 8)).all(), (z, x, y)
    assert not gaps or any(not image.any() for image in got.values())


def test_zooms_keep_both_bounds_and_equal_values_are_in_the_middle(spark):
    assert list(tiles.zooms(0, 5, 256, 100, 1 << 40)) == [0, 1, 2, 3] and list(tiles.zooms(0, 5, 256, 10**9, 21 * 256 * 256 * 4)) == [0, 1, 2] and list(tiles.zooms(2, 4, 256, 1, 1)) == [2]
    flat = spark.createDataFrame([(i, j, 4.0) for i in range(2) for j in range(2)], "ix int, iy int, v double")
    one = pixels(tiles.tile_pyramid(flat, {"nx": 2, "ny": 2}, "inferno", 1.0, 4, 0).first().png)
    assert (one == [*colour(0.5, "inferno"), 255]).all()
    empty = tiles.tile_pyramid(flat.where("v < 0"), {"nx": 2, "ny": 2}, "inferno", 1.0, 4, 1).collect()
    assert len(empty) == 5 and not any(pixels(t.png).any() for t in empty)


def test_raster_is_at_cell_centres_and_clips_the_result(spark):
    corner = spark.createDataFrame([(k, x, y, v) for k, (x, y, v) in enumerate([(0.0, 0.0, 0.0), (10.0, 0.0, 1.0), (0.0, 30.0, 2.0), (10.0, 30.0, 3.0)])], "pid long, x double, y double, v double")
    got = {(r.ix, r.iy): r.v for r in grids.raster_interpolate(corner, 2, 2, lo=0, hi=100).collect()}
    for (i, j), v in got.items():
        d = {(a, b): (i / 2 + 0.25 - a) ** 2 + (j / 2 + 0.25 - b) ** 2 for a in (0, 1) for b in (0, 1)}
        assert abs(v - sum((a + 2 * b) / x for (a, b), x in d.items()) / sum(1 / x for x in d.values())) < 1e-12
    clipped = [r.v for r in grids.raster_interpolate(corner, 2, 2, "nearest", lo=40, hi=60).collect()]
    assert sorted(clipped) == [1.0, 1.0, 2.0, 2.0]
    same = spark.createDataFrame([(1, 5.0, 5.0, 2.0), (2, 5.0, 5.0, 2.0)], "pid long, x double, y double, v double")
    assert {r.v for r in grids.raster_interpolate(same, 2, 3).collect()} == {2.0} and grids.raster_interpolate(same.where("v < 0"), 2, 3).where("v is null").count() == 6


def test_terrain_fills_from_the_nearest_by_squared_distance(spark):
    spec = {"nx": 20, "ny": 100, "xmin": 0.0, "xmax": 190.0, "ymin": 0.0, "ymax": 990.0}
    raster = spark.createDataFrame([(i, j, None if (i + j) % 11 == 0 else float(i * 7 % 5 + j * j % 9)) for i in range(20) for j in range(100)], "ix int, iy int, v double")
    got, own = grids.terrain_from_raster(raster, spec, None, 15.0, fit="none")
    raw = [r for r in grids.bilinear_sample(grids.make_grid(spark, own), raster, spec).collect()]
    known = sorted((r.iy, r.ix, r.x, r.y, r.v) for r in raw if r.v is not None)
    kx, ky, kv = (np.array([k[c] for k in known]) for c in (2, 3, 4))
    got = {(r.ix, r.iy): r.v for r in got.collect()}
    assert len(got) == len(raw) > len(known)
    for r in raw:
        d2 = (r.x - kx) ** 2 + (r.y - ky) ** 2
        near = np.argsort(d2, kind="stable")[:12]
        want = (kv[near] / d2[near]).sum() / (1 / d2[near]).sum() if r.v is None else r.v
        assert abs(got[r.ix, r.iy] - want) < 1e-9, (r.ix, r.iy)


def test_terrain_classes(spark):
    spec = {"nx": 41, "ny": 2, "xmin": 0.0, "xmax": 400.0, "ymin": 0.0, "ymax": 10.0}
    grid = spark.createDataFrame([(i, j, 10.0 * i, 10.0 * j, None if (i, j) == (3, 1) else 1.0, i % 2 == 1) for i in range(41) for j in range(2)], "ix int, iy int, x double, y double, v double, f boolean")
    control = spark.createDataFrame([(2.0, 0.0, 5.0)], "x double, y double, z double")
    scores = {0: 0.12, 1: 0.38, 2: 0.62, 3: 0.82, 4: 1.0, 5: 0.8}
    cell = 400 / 41
    for fallback, fitted, filled in ((False, True, None), (False, False, "f"), (True, True, None)):
        got = {(r.ix, r.iy): (r["class"], r.score) for r in grids.terrain_confidence(grid, control, spec, 8.0, 0.75, filled, fitted, fallback).collect()}
        for (i, j), (kind, score) in got.items():
            d = np.hypot(10.0 * i - 2, 10.0 * j)
            own = 5 if fallback else 1 if filled and i % 2 else 3 if fitted else 2
            want = 0 if (i, j) == (3, 1) else 4 if d <= 0.75 * cell else 0 if d > 8 * cell and not fallback else own
            assert (kind, score) == (want, scores[want]), (i, j)
    assert {r["class"] for r in grids.terrain_confidence(grid, control.where("x < 0"), spec).collect()} == {0, 3}


def test_sources_are_scaled_by_the_value_at_its_index(spark):
    s = spark.createDataFrame([(float(k), 0.0, 10.0, 0.0, 7.0, 0.1, float(k)) for k in range(1, 21)], "x double, y double, depth_m double, n double, background double, residual double, mean_abs double")
    got = {r.x: r for r in magnetics.euler_sources(s, 1.0).collect()}
    assert [round(got[k].proxy, 9) for k in (18.0, 19.0, 20.0)] == [0.9, 0.95, 1.0]
    assert (got[3.0].anomaly, got[3.0].background, got[3.0].z, got[3.0].size) == (3.0, 7.0, -10.0, 1.5)
    assert magnetics.euler_sources(s.where("x < 0"), 1.0).count() == 0
    assert magnetics.euler_sources(s.where("x = 1"), 1.0).first().proxy == 1.0


def test_fingerprint_is_of_the_multiset_of_exact_rows(spark):
    of = lambda rows, schema="a string, b string": versions.dataset_fingerprint(spark.createDataFrame(rows, schema).repartition(3), ["a", "b"]).first()[0]
    sets = [[(None, "x")], [("\x00", "x")], [("N", "x")], [("p\x1fq", "r")], [("p", "q\x1fr")], [("p1:q", "r")], [("p", "q"), ("p", "q")], [("p", "q")], [("p", "q"), ("r", "s")], [("p", "s"), ("r", "q")], []]
    assert len({of(s) for s in sets}) == len(sets)
    assert of([("p", "q"), ("r", "s"), ("p", "q")]) == of([("r", "s"), ("p", "q"), ("p", "q")])
    lists = "a array<string>, b binary"
    assert len({of(s, lists) for s in ([(["x, y"], b"1")], [(["x", "y"], b"1")], [(None, b"1")], [(["x, y"], None)])}) == 4


def test_fingerprint_sends_one_row_a_task(spark):
    df = spark.range(5000).selectExpr("id as a", "cast(id as string) as b").repartition(7)
    plan = versions.dataset_fingerprint(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect" not in plan
