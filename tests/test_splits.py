"""Readers of one large file by many tasks, against json and plain splitting."""

import json
import random

import pytest

from orelode import sources
from orelode.sources import splits


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


NASTY = ['plain', 'a "quoted" {brace}', "}}{{[[", "back\\slash", "\\", 'ends with \\"', "é 漢 😀 }", "", "line\nbreak\t}", '"features":[{']


def collection(n=60, **head):
    r = random.Random(n)
    feats = []
    for k in range(n):
        line = k % 3 == 0
        at = [[r.uniform(-9, 9) for _ in range(3)] for _ in range(r.randint(2, 5))] if line else [r.uniform(-180, 180), r.uniform(-90, 90)] + ([5.0] if k % 2 else [])
        feats.append({"type": "Feature", "properties": {"name": r.choice(NASTY), "level": k, "deep": {"a": [{"b": "}"}]}}, "geometry": {"type": "LineString" if line else "Point", "coordinates": at}})
    return {"type": "FeatureCollection", **head, "features": feats}


@pytest.mark.parametrize("layout", [None, 1])
def test_features_of_one_file_in_many_ranges(spark, small_splits, tmp_path, layout):
    data = collection(crs={"type": "name", "properties": {"name": "urn:x {"}}, bbox=[1, 2, 3, 4])
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps(data, indent=layout, ensure_ascii=layout is None))
    rows = splits.pieces(spark, str(path), "}")
    assert rows.rdd.getNumPartitions() > 10 and rows.selectExpr("max(length(value))").first()[0] < 1500
    objects = [json.loads(r.value) for r in splits.json_objects(spark, str(path), 3, "features").collect()]
    assert [o for o in objects if "geometry" in o] and sorted(map(str, (o for o in objects if "geometry" in o))) == sorted(map(str, data["features"]))
    points = sources.read_geojson_points(spark, str(path)).collect()
    want = [f for f in data["features"] if f["geometry"]["type"] == "Point"]
    assert sorted((p.level, p.name, p.lon, p.lat, p.z) for p in points) == sorted((f["properties"]["level"], f["properties"]["name"], *(f["geometry"]["coordinates"] + [None])[:3]) for f in want)
    lines = sources.read_geojson_lines(spark, str(path)).collect()
    assert len(lines) == sum(len(f["geometry"]["coordinates"]) - 1 for f in data["features"] if f["geometry"]["type"] == "LineString") and all(s.has_z for s in lines)


def test_only_the_named_array_counts(spark, small_splits, tmp_path):
    data = collection(20, other=[{"type": "Feature", "properties": {"level": -k}, "geometry": {"type": "Point", "coordinates": [k, k]}} for k in range(30)])
    data["features"].insert(7, [{"type": "Feature", "deep": "x" * 3000}])  # an array is no feature
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps(data))
    objects = splits.json_objects(spark, str(path), 3, "features")
    want = [f for f in data["features"] if isinstance(f, dict)]
    assert sorted(str(json.loads(r.value)) for r in objects.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("form", ["array", "pretty", "lines"])
def test_json_rows_in_many_ranges(spark, small_splits, tmp_path, form):
    r = random.Random(3)
    data = [{"id": k, "t": r.choice(NASTY), "o": {"x": [1, {"y": "]"}]}} | ({"extra": 1.5} if k % 4 == 0 else {}) for k in range(80)]
    path = tmp_path / "rows.json"
    path.write_text("\n".join(map(json.dumps, data)) if form == "lines" else " " + json.dumps(data, indent=2 if form == "pretty" else None))
    got = sources.read_json_rows(spark, str(path))
    assert sorted((x.id, x.t, x.extra) for x in got.collect()) == [(d["id"], d["t"], d.get("extra")) for d in data]


@pytest.mark.parametrize("sep", [" ", "\n", " \t"])
def test_one_grid_in_many_ranges(spark, small_splits, tmp_path, sep):
    nx, ny = 40, 30
    values = [[-9999.0 if (i * j) % 17 == 3 else i + j / 100 for i in range(nx)] for j in range(ny)]
    path = tmp_path / "g.asc"
    body = "\n".join(sep.join(map(str, row)) for row in values)
    path.write_text(f"NCOLS {nx}\nnrows {ny}\nxllcorner 100\nyllcorner 200\ncellsize 5\nNODATA_value -9999\n{body} 77 78\n")
    grid, spec = sources.read_ascii_grid(spark, str(path))
    got = {(r.ix, r.iy): r.v for r in grid.collect()}
    assert got == {(i, ny - 1 - j): None if v == -9999 else v for j, row in enumerate(values) for i, v in enumerate(row)}
    assert (spec["nx"], spec["ny"], spec["xmin"], spec["ymax"]) == (nx, ny, 102.5, 347.5)
    assert splits.pieces(spark, str(path)).rdd.getNumPartitions() > 5
