"""Planted answers and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelode import functions as fn
from orelode import sources, streaming
from orelode.operators import blocks, contours, drillhole, grids, ingest, lines, magnetics, neighbours, stats, tiles, versions


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_parse_numeric(spark):
    d = spark.createDataFrame([(x,) for x in ("5d", "NaN", "1,5", "", " 7 ", "1e3", "inf", None)], "t string")
    assert [r[0] for r in d.select(fn.parse_numeric("t")).collect()] == [None, None, 1.5, None, 7.0, 1000.0, None, None]


def test_vertical_hole_and_stub(spark):
    c = spark.createDataFrame([("a", 1.0, 2.0, 100.0), ("b", 0.0, 0.0, 50.0)], "hole_id string, x double, y double, z double")
    s = spark.createDataFrame([("a", float(d), 0.0, -90.0) for d in (0, 10, 20)], "hole_id string, depth_m double, azimuth_deg double, dip_deg double")
    got = {(r.hole_id, r.depth_to): r for r in drillhole.desurvey(c, s).collect()}
    assert math.isclose(got["a", 20.0].z_to, 80.0) and math.isclose(got["a", 20.0].x_to, 1.0, abs_tol=1e-9)
    assert got["b", 1.0].z_to == 49.0 and got["b", 1.0].depth_from == 0.0


def test_composite_keeps_length_and_metal(spark):
    r = random.Random(4)
    data = [(h, float(k), float(k + r.choice([1, 2])), float(k), 0.0, 0.0, 0.0, r.random(), None if k % 3 else 2.5) for h in "abc" for k in range(0, 20, 2)]
    d = spark.createDataFrame(data, "hole_id string, from_m double, to_m double, depth_m double, x double, y double, z double, v double, sg double")
    out = drillhole.composite_intervals(d, 4.0).collect()
    assert math.isclose(sum(o.support_m for o in out), sum(x[2] - x[1] for x in data))
    assert math.isclose(sum(o.support_m * o.v for o in out), sum((x[2] - x[1]) * x[7] for x in data))
    thin = spark.createDataFrame([("a", float(k), float(k + 1), None, 0.0, 0.0, 0.0, 1.0, None) for k in range(3)], d.schema)
    assert sorted(o.support_m for o in drillhole.composite_intervals(thin, 2.0).collect()) == [1.0, 2.0]


def test_plane_fit_recovers_tilt(spark):
    g = spark.createDataFrame([(i, j, float(i), float(j), 0.0) for i in range(5) for j in range(5)], "ix int, iy int, x double, y double, v double")
    spec = {"nx": 5, "ny": 5, "xmin": 0.0, "xmax": 4.0, "ymin": 0.0, "ymax": 4.0}
    c = spark.createDataFrame([(float(x), float(y), 2 + 0.1 * x - 0.2 * y) for x in range(4) for y in range(4)], "x double, y double, z double")
    fit = grids.plane_fit(grids.terrain_control_match(c, g, spec), "affine_xy_z").first()
    assert math.isclose(fit.tilt_x, 0.1, abs_tol=1e-9) and math.isclose(fit.tilt_y, -0.2, abs_tol=1e-9) and fit.rmse_after < 1e-9
    bias = grids.plane_fit(grids.terrain_control_match(c, g, spec)).first()
    assert bias.rmse_after <= bias.rmse_before
    with pytest.raises(ValueError):
        grids.terrain_adjust(g, spec, c.limit(2))


def test_saddle_gives_two_segments(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (1, 1, 1.0), (0, 1, 0.0)], "ix int, iy int, v double")
    spec = {"nx": 2, "ny": 2, "xmin": 0.0, "xmax": 1.0, "ymin": 0.0, "ymax": 1.0}
    s = contours.marching_squares(g, spec, spark.createDataFrame([(0.5,)], "level double"))
    assert sorted(rows(s.select("x0", "y0", "x1", "y1"))) == [(0.5, 0.0, 1.0, 0.5), (0.5, 1.0, 0.0, 0.5)]


def test_cone_contours_are_closed_rings(spark):
    n = 21
    g = spark.createDataFrame([(i, j, 10 - math.hypot(i - 10.03, j - 10.01)) for i in range(n) for j in range(n)], "ix int, iy int, v double")
    spec = {"nx": n, "ny": n, "xmin": 0.0, "xmax": 20.0, "ymin": 0.0, "ymax": 20.0}
    s = contours.stitch_contours(contours.marching_squares(g, spec, spark.createDataFrame([(2.5,), (5.5,)], "level double")))
    got = rows(s.groupBy("level", "line_id", "closed").count().select("level", "closed"))
    assert sorted(got) == [(2.5, True), (5.5, True)]


def test_spike_goes(spark):
    r = random.Random(1)
    v = [10 + r.random() for _ in range(40)]
    v[20] = 500.0
    d = spark.createDataFrame([(1, k, 10.0 * k, 0.0, v[k], 10.0 * k) for k in range(40)], "line int, fid int, x double, y double, m double, along_m double")
    assert sorted(set(range(40)) - {x.fid for x in lines.despike(d).collect()}) == [20, 21]


def test_unit_cube(spark):
    q = [((0, 0, 0), (1, 0, 0), (1, 1, 0)), ((0, 0, 0), (1, 1, 0), (0, 1, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1)), ((0, 0, 1), (1, 1, 1), (0, 1, 1))]
    t = spark.createDataFrame([tuple(float(v) for p in tri for v in p) for tri in q], ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    p = spark.createDataFrame([(1, 0.5, 0.4, 0.5), (2, 0.5, 0.4, 1.5), (3, 2.0, 0.5, 0.5)], "id int, x double, y double, z double")
    assert dict(rows(blocks.point_in_mesh(p, t).select("id", "inside"))) == {1: True, 2: False, 3: False}


def test_neighbour_plans_agree(spark):
    r = random.Random(3)
    p = spark.createDataFrame([(k, r.gauss(0, 100), r.gauss(0, 100), r.random()) for k in range(300)], "pid long, x double, y double, v double")
    left = spark.createDataFrame([(k, r.gauss(0, 200), r.gauss(0, 200)) for k in range(60)], "id long, x double, y double")
    a = sorted(rows(neighbours.knn(left, p, 5).select("id", "pid", "rank")))
    assert a == sorted(rows(neighbours.knn(left, p, 5, broadcast_rows=0).select("id", "pid", "rank")))
    lo, hi = p.agg(F.min("v"), F.max("v")).first()
    for m in ("idw", "rbf", "kriging", "nearest"):
        assert all(lo - 1e-9 <= x.v <= hi + 1e-9 for x in neighbours.interpolate(neighbours.knn(left, p, 5), m).collect())
    at = p.select(F.col("pid").alias("id"), "x", "y")
    got = dict(rows(neighbours.interpolate(neighbours.knn(at, p, 5)).select("id", "v")))
    assert all(math.isclose(got[x.pid], x.v) for x in p.collect())


def test_hull_holds_all_points(spark):
    r = random.Random(8)
    pts = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(200)]
    d = spark.createDataFrame(pts, "x double, y double").repartition(5)
    h = sorted(rows(blocks.convex_hull(d)))
    ring = [(x, y) for _, x, y in h]
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in pts)


def test_merge_and_diff_laws(spark):
    a = spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, v int")
    b = spark.createDataFrame([(k, k % 4) for k in range(5, 40)], "k int, v int")
    assert versions.snapshot_diff(a, a, ["k"], ["v"]).count() == 0
    assert sorted(rows(versions.three_way_merge(a, b, a, ["k"], ["v"]).select("k", "v"))) == sorted(rows(b))
    assert versions.three_way_merge(a, b, a, ["k"], ["v"]).where("conflict is not null").count() == 0
    h = versions.dataset_fingerprint(a, ["k", "v"]).first()[0]
    assert h == versions.dataset_fingerprint(a.repartition(7), ["k", "v"]).first()[0] != versions.dataset_fingerprint(b, ["k", "v"]).first()[0]


def test_decimate_keeps_ends(spark):
    d = spark.createDataFrame([(1, k, float(k)) for k in range(23)], "line int, fid int, along_m double")
    got = {r.fid for r in lines.decimate(d, 25.0).collect()}
    assert {0, 22} <= got and len(got) == 7


def test_euler_finds_a_buried_source(spark):
    h, n, depth = 10.0, 31, 60.0
    data = []
    for i in range(n):
        for j in range(n):
            dx, dy = i * h - 150, j * h - 150
            r2 = dx * dx + dy * dy + depth * depth
            f = 1e9 / r2**1.5
            data.append((i, j, i * h, j * h, f, -3 * dx * 1e9 / r2**2.5, -3 * dy * 1e9 / r2**2.5, -3 * depth * 1e9 / r2**2.5))
    m = spark.createDataFrame(data, "ix int, iy int, x double, y double, v double, dmdx double, dmdy double, dmdz double")
    spec = {"nx": n, "ny": n, "xmin": 0.0, "xmax": 300.0, "ymin": 0.0, "ymax": 300.0}
    w = magnetics.euler_windows(m, 7, 2)
    got = magnetics.euler_solve(w, spec, h, n=3).where("residual < 0.2").collect()
    assert got and abs(np.median([abs(g.depth_m) for g in got]) - depth) < 12
    assert magnetics.euler_solve(w, spec, h, n=0).count() == 0


def test_utm_control_and_round_trip(spark):
    d = spark.createDataFrame([(3.0, 0.0, 32631), (5.0, 52.0, 32631), (-70.0, -33.0, 32719)], "lon double, lat double, e int")
    x, y = fn.lonlat_to_utm(F.col("lon"), F.col("lat"), F.col("e"))
    d = d.select("*", x.alias("x"), y.alias("y"))
    lon, lat = fn.utm_to_lonlat(F.col("x"), F.col("y"), F.col("e"))
    got = d.select("*", lon.alias("l2"), lat.alias("t2")).collect()
    assert math.isclose(got[0].x, 500000, abs_tol=1e-6) and abs(got[0].y) < 1e-6
    assert abs(got[1].x - 637294.37) < 0.05 and abs(got[1].y - 5762926.81) < 0.05
    assert all(abs(g.lon - g.l2) < 1e-8 and abs(g.lat - g.t2) < 1e-8 for g in got)


def test_mapping_by_alias():
    assert ingest.infer_mapping(["Hole ID", "EASTING", "Northing_m", "rl"], ["hole_id", "x", "y", "z"]) == {"hole_id": "Hole ID", "x": "EASTING", "y": "Northing_m", "z": "rl"}


class _Named:
    """A session that names this master and no shared folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"

    def getConf(self):
        return {}

    def get(self, key, default=None):
        return default


def test_scratch_folder_is_local_only_on_one_machine():
    from orelode.operators import shared

    at = shared.scratch_dir(_Named("local[4]"))
    assert at.startswith("file://") and shared.scratch_dir(_Named("local[4]")) == at
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.scratch_dir(_Named(master))


def test_every_header_alias():
    for field, names in {"x": "x X_WGS84 easting utm_e x_m fx", "y": "y y_wgs84 Northing utm_n y_m fy", "z": "z elevation alt gpsz fz", "lon": "lon longitude long", "lat": "lat Latitude", "ts": "utc time timestamp datetime", "segment_id": "line line_id flightline group segment"}.items():
        for n in names.split():
            assert ingest.infer_mapping(["other", n], ["x", "y", "z", "lon", "lat", "ts", "segment_id"]) == {field: n}, n
    interval = ["hole_id", "from_m", "to_m"]
    assert ingest.infer_mapping(["from_azimuth", "hole", "Depth From", "to"], interval) == {"hole_id": "hole", "from_m": "Depth From", "to_m": "to"}
    assert ingest.infer_mapping(["from_azimuth", "hole"], interval) == {"hole_id": "hole"}
    assert ingest.infer_mapping(["sample from (m)", "hole"], interval)["from_m"] == "sample from (m)"


def test_empty_tables(spark):
    e = spark.createDataFrame([], "pid long, x double, y double, z double, v double")
    assert neighbours.knn(e.withColumnRenamed("pid", "id"), e, 3).count() == 0
    assert stats.extent_2d(e).count() == 0 and stats.histogram(e, "v").count() == 0
    assert stats.percentile_nearest_rank(e, "v", 0.5).first()[0] is None
    assert blocks.convex_hull(e).count() == 0


def test_png_header():
    assert tiles.png(np.zeros((2, 3, 4), np.uint8))[:8] == b"\x89PNG\r\n\x1a\n"


def test_delimited_and_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b;c\n 1 ;x;2,5\n;;\n3\n")
    d = sources.read_delimited(spark, str(tmp_path / "a.csv"))
    assert sorted(rows(d)) == [("1", "x", "2,5"), ("3", None, None)]
    assert sources.detect_format("x.GeoJSON") == "geojson" and sources.detect_format("x", "", '[{"a":1}]') == "json"


def _stream(spark, df, path, make):
    df.repartition(1).sortWithinPartitions("ts").write.parquet(path)
    q = make(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName("s" + str(abs(hash(path)))).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("s" + str(abs(hash(path))))


def test_change_feed_stream_equals_batch(spark, tmp_path):
    d = spark.sql("select cast(id % 5 as string) key, cast((id div 15) % 3 as string) hash, timestamp_seconds(1000 + id) ts from range(200)")
    got = _stream(spark, d, str(tmp_path / "c"), streaming.change_feed)
    assert sorted(rows(got)) == sorted(rows(streaming.change_feed_batch(d)))


def test_ordered_lines_stream_equals_batch(spark, tmp_path):
    d = spark.sql("select id % 4 line, id, timestamp_seconds(1000 + (id * 37) % 101) ts from range(100)")
    got = _stream(spark, d, str(tmp_path / "o"), lambda s: streaming.ordered_line_ingest(s, "1 hour"))
    assert sorted(rows(got.select("line", "id", "ts"))) == sorted(rows(streaming.ordered_line_batch(d)))


def test_ordered_lines_keep_rows_that_share_an_id(spark, tmp_path):
    # Two rows of line 1 are called 5; only the one sent twice counts once.
    d = spark.sql("select * from values (1L, 5L, timestamp_seconds(1010)), (1L, 5L, timestamp_seconds(1020)), (1L, 5L, timestamp_seconds(1020)), (1L, 7L, timestamp_seconds(1015)), (1L, 9L, timestamp_seconds(1030)) as t(line, id, ts)")
    batch = sorted((r.id, r.ts.minute * 60 + r.ts.second) for r in streaming.ordered_line_batch(d).collect())
    assert batch == [(5, 1010 % 3600), (5, 1020 % 3600), (9, 1030 % 3600)]
    got = _stream(spark, d, str(tmp_path / "o"), lambda s: streaming.ordered_line_ingest(s, "1 hour"))
    assert sorted(rows(got.select("line", "id", "ts"))) == sorted(rows(streaming.ordered_line_batch(d)))


def test_spread_deals_a_key_over_more_tasks_only_for_many_rows(spark):
    from orelode.operators.shared import spread

    d = spark.range(1000).selectExpr("id % 100 as k")
    assert spread(d, "k", 1000) is d
    got = spread(d, "k", 50)
    assert got.rdd.getNumPartitions() == 20 and got.groupBy("k").count().where("count = 10").count() == 100


def test_stale_keys(spark, tmp_path):
    d = spark.sql("select cast(id % 3 as string) key, timestamp_seconds(1000 + id) ts from range(30) union all select 'late', timestamp_seconds(5000)")
    batch = {k for k, _ in rows(streaming.stale_key_batch(d))}
    assert batch == {"0", "1", "2"}
    got = _stream(spark, d, str(tmp_path / "s"), streaming.stale_key_detection)
    assert {r.key for r in got.collect()} <= batch


def test_long_bending_contour_is_one_line(spark):
    at = [(float(100 - abs(t - 100)), float(t)) for t in range(201)]
    s = spark.createDataFrame([(1.0, *a, *b) for a, b in zip(at, at[1:])], "level double, x0 double, y0 double, x1 double, y1 double")
    got = contours.stitch_contours(s.repartition(8)).collect()
    assert len({r.line_id for r in got}) == 1 and len(got) == 201 and not any(r.closed for r in got)
    order = [round(r.y) for r in sorted(got, key=lambda r: r.seq)]
    assert order in (list(range(201)), list(range(200, -1, -1)))


def test_fixed_values():
    from orelode.functions import RAMPS
    from orelode.operators.stats import MEASURE_WORDS

    assert RAMPS["inferno"][2] == (0.45, 120, 28, 109) and RAMPS["viridis"][3] == (0.75, 93, 200, 99) and RAMPS["default"][1] == (0.25, 0, 166, 202)
    assert len(MEASURE_WORDS) == 17 and "conc" not in MEASURE_WORDS
    assert all(r[0][0] == 0.0 and r[-1][0] == 1.0 and [x[0] for x in r] == sorted(x[0] for x in r) for r in RAMPS.values())


def test_colour_ramp_hits_its_stops(spark):
    from orelode.functions import RAMPS, colour_ramp

    for name, stops in RAMPS.items():
        got = spark.createDataFrame([(s[0],) for s in stops], "t double").select(colour_ramp(F.col("t"), name).alias("c")).collect()
        assert [tuple(r.c) for r in got] == [s[1:] for s in stops]


@pytest.mark.parametrize("most", [500_000, 40])
def test_components_equal_union_find(spark, monkeypatch, most):
    """Paths, a hub and random edges; contracted in one task, or in many with rounds after."""
    from orelode import components

    monkeypatch.setattr(components, "TASK_EDGES", most)
    r = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, 101 + k) for k in range(80)] + [tuple(map(int, e)) for e in r.integers(200, 400, (120, 2))] + [(7, 7), (7, 8)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    nodes, low = components.roots(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert sorted((x.node, x.component) for x in got) == list(zip(nodes.tolist(), low.tolist(), strict=True))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
