"""Source and ingest queries: tables written as files of the accepted kinds, and read again."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .. import sources
from ..operators import ingest
from ..operators.shared import materialise
from .registry import query, r, rounded
from .views import collars, part_grid, survey_lines, table, with_views


def _folder(spark, name: str) -> str:
    """A new folder beside the scratch tables."""
    at = materialise(spark.range(1), name)
    return at.inputFiles()[0].rsplit("/", 1)[0] + f"-{uuid.uuid4().hex[:8]}"


@query("select c_custkey, trim(c_name) as c_name, c_acctbal from customer")
def read_delimited(spark, sf_dir):
    path = _folder(spark, "csv")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.regexp_replace(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "\\.", ",").alias("bal"), F.lit("").alias("blank"))
    c.write.csv(path, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    from ..functions import parse_numeric

    d = sources.read_delimited(spark, path)
    return d.select(F.col("key").cast("long").alias("c_custkey"), F.col("name").alias("c_name"), parse_numeric("bal").alias("c_acctbal"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def read_json_rows(spark, sf_dir):
    path = _folder(spark, "json")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    d = sources.read_json_rows(spark, path)
    return d.select("o_orderkey", "o_orderstatus", "o_totalprice")


def _collection(spark, features, path: str) -> None:
    """Feature collections as texts: each task's features between a head and a tail, one feature a line."""

    def wrap(batches):
        yield pa.RecordBatch.from_arrays([pa.array(['{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null,"properties":{}}'])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(",", b.column(0).cast(pa.string()), "")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    features.select("value").mapInArrow(wrap, "value string").write.text(path)


@query(f"{with_views('collars')} select hole_id, x as lon, y as lat, {r('z', 'z')} from collars")
def read_geojson_points(spark, sf_dir):
    path = _folder(spark, "geojson")
    _collection(spark, sources.geojson_features(collars(spark, sf_dir)), path)
    return rounded(sources.read_geojson_points(spark, path).select("hole_id", "lon", "lat", "z"), only=["z"])


@query(f"{with_views('segments')} select {r('x_from', 'x0')}, {r('y_from', 'y0')}, {r('x_to', 'x1')}, {r('y_to', 'y1')}, depth_from as level from segments")
def read_geojson_lines(spark, sf_dir):
    from .drillhole_queries import segments

    path = _folder(spark, "geojson")
    s = segments(spark, sf_dir).select(F.col("x_from").alias("x0"), F.col("y_from").alias("y0"), F.col("x_to").alias("x1"), F.col("y_to").alias("y1"), F.col("depth_from").alias("level"))
    _collection(spark, sources.geojson_features(s), path)
    return rounded(sources.read_geojson_lines(spark, path).select("x0", "y0", "x1", "y1", "level"), only=["x0", "y0", "x1", "y1"])


@query(f"{with_views('grid')} select ix, iy, {r('v', 'v')} from grid")
def read_ascii_grid(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    path = _folder(spark, "grid")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "v"))), lambda s: s["v"].cast("string")), " ")
    rows = g.groupBy("iy").agg(line.alias("value"))  # a row of the grid is a line
    head = f"ncols {spec['nx']}\nNROWS {spec['ny']}\nxllcorner 0\nyllcorner 0\ncellsize 10\nnodata_value -9999"
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/0-head")
    rows.repartitionByRange(4, F.desc("iy")).sortWithinPartitions(F.desc("iy")).select("value").write.text(f"{path}/1-rows")
    out, _ = sources.read_ascii_grid(spark, path)
    return rounded(out.select("ix", "iy", "v"))


@query("select l_orderkey as k, l_quantity as q from lineitem")
def explode_row_arrays(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    a = t.where("l_linenumber % 2 = 0").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))).alias("assays"))
    b = t.where("l_linenumber % 2 = 1").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))).alias("points"))
    return sources.explode_row_arrays([a, b])


@query(f"{with_views('collars')} select count(*) as n, sum(hole_id)::bigint as keys from collars")
def write_geojson(spark, sf_dir):
    path = _folder(spark, "geojson")
    sources.write_geojson(collars(spark, sf_dir), path)
    d = spark.read.text(path).select(F.get_json_object("value", "$.properties.hole_id").cast("long").alias("k"))
    return d.agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


_ROW = "sha256(" + " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, 'N')" for c in ("hole_id", "x", "y", "z")) + ")"
_LANES = ", ".join(f"(sum(('0x' || h[{16 * k + 1}:{16 * k + 16}])::ubigint::hugeint) % 18446744073709551616::hugeint)::varchar as s{k}" for k in range(4))


@query(f"{with_views('collars')}, h as (select {_ROW} as h from collars), s as (select count(*)::varchar as n, {_LANES} from h) select sha256(n || ',' || s0 || ',' || s1 || ',' || s2 || ',' || s3) as hash from s")
def write_rows(spark, sf_dir):
    return sources.write_rows(collars(spark, sf_dir), _folder(spark, "rows"))


def _raw_collars(spark, sf_dir):
    c = collars(spark, sf_dir)
    return c.select(F.when(F.col("hole_id") % 50 > 0, F.concat(F.lit(" H"), F.col("hole_id").cast("string"))).otherwise(F.lit(" ")).alias("Hole_ID"), F.when(F.col("hole_id") % 40 > 0, F.col("x").cast("string")).otherwise(F.lit("1,5")).alias("Easting"), F.col("y").cast("string").alias("Northing"), F.when(F.col("hole_id") % 3 > 0, F.col("z").cast("string")).alias("RL"))


@query(f"{with_views('collars')} select 'H' || hole_id as hole_id, x, y, {r('case when hole_id % 3 > 0 then z else 0 end', 'z', 3)}, 32630 as epsg, '' as flags from collars where hole_id % 50 > 0 and hole_id % 40 > 0")
def collar_ingest(spark, sf_dir):
    d = ingest.collar_ingest(_raw_collars(spark, sf_dir), source_epsg=32630, target_epsg=32630)
    return rounded(d.select("hole_id", "x", "y", "z", "epsg", F.array_join("qa_flags", ",").alias("flags")), 3, ["z"])


@query("select 'H' || l_orderkey as hole_id, l_quantity as depth_m, (l_partkey % 360)::double as azimuth_deg, (-(l_suppkey % 90))::double as dip_deg, 'segment_id:' || l_linenumber as flags from lineitem where l_linenumber % 4 > 0")
def survey_ingest(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    raw = t.select(F.concat(F.lit("H"), F.col("l_orderkey").cast("string")).alias("BHID"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity").cast("string")).otherwise("n/a").alias("Depth"), (F.col("l_partkey") % 360).cast("string").alias("Azi"), (-(F.col("l_suppkey") % 90)).cast("string").alias("Dip"), F.col("l_linenumber").cast("string").alias("Line ID"))
    return ingest.survey_ingest(raw).select("hole_id", "depth_m", "azimuth_deg", "dip_deg", F.array_join("qa_flags", ",").alias("flags"))


@query("select 'H' || l_orderkey as hole_id, 0.0::double as from_m, l_quantity as to_m, case when l_linenumber % 2 = 0 then l_partkey::double end as au, l_returnflag as rock from lineitem")
def assay_ingest(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    raw = t.select(F.concat(F.lit("H"), F.col("l_orderkey").cast("string")).alias("hole"), F.lit("0").alias("From"), F.col("l_quantity").cast("string").alias("To"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise(" ").alias("au"), F.col("l_returnflag").alias("rock"))
    return ingest.assay_ingest(raw).select("hole_id", "from_m", "to_m", F.col("num_attrs")["au"].alias("au"), F.col("text_attrs")["rock"].alias("rock"))


@query(f"{with_views('grid')} select 'S' || p.p_partkey as id, g.x, g.y, {r('case when p.p_partkey % 2 = 0 then p_size else v end', 'z')}, case when p.p_partkey % 2 = 0 then '' else 'z_from_terrain_grid' end as flags from part p join grid g on g.ix = p.p_partkey % 20 and g.iy = p.p_partkey // 20")
def surface_sample_ingest(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 20).cast("int").alias("ix"), F.floor(F.col("p_partkey") / 20).cast("int").alias("iy"))
    raw = p.join(g, ["ix", "iy"]).select(F.col("p_partkey").alias("n"), F.col("x").cast("string").alias("X"), F.col("y").cast("string").alias("Y"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).alias("Z"))
    d = ingest.surface_sample_ingest(raw, g, spec, epsg=32630, row_id="n")
    return rounded(d.select("id", "x", "y", "z", F.array_join("qa_flags", ",").alias("flags")), only=["z"])


def _observations(spark, sf_dir):
    s = survey_lines(spark, sf_dir)
    return s.select(F.when(F.col("fid") % 20 > 0, F.col("x").cast("string")).otherwise("bad").alias("Easting"), F.col("y").cast("string").alias("Northing"), F.lit("-1.5").alias("lon"), F.lit("5.5").alias("lat"), F.col("line").cast("string").alias("Line"), F.col("m").cast("string").alias("tmf"), F.col("fid").cast("string").alias("fid"))


@query(f"{with_views('lines')} select fid, {r('x', 'x')}, {r('y', 'y')}, line::varchar as segment_id, 32630 as epsg, m as tmf from lines where fid % 20 > 0")
def observation_ingest(spark, sf_dir):
    d = ingest.observation_ingest(_observations(spark, sf_dir), source_epsg=32630)
    return rounded(d.select(F.col("num_attrs")["fid"].cast("long").alias("fid"), "x", "y", "segment_id", "epsg", F.col("num_attrs")["tmf"].alias("tmf")), only=["x", "y"])


@query(f"{with_views('lines')} select count(*) as rows_in, count(*) filter (fid % 20 > 0) as points_out, count(*) filter (fid % 20 = 0) as malformed_dropped, 'projected' as mode, 32630 as epsg, count(*) filter (fid % 20 > 0) as seen, count(*) filter (fid % 20 > 0) as plausible from lines")
def ingest_report(spark, sf_dir):
    raw = _observations(spark, sf_dir)
    return ingest.ingest_report(raw, ingest.observation_ingest(raw, source_epsg=32630), _mode(raw))


def _mode(raw):
    from ..functions import parse_numeric

    rows = raw.select(parse_numeric("Easting").alias("x"), parse_numeric("Northing").alias("y"), parse_numeric("lon").alias("lon"), parse_numeric("lat").alias("lat"))
    return ingest.choose_coord_mode(rows, 32630)


@query("select 'projected' as mode, 32630 as target_epsg, count(*) filter (event_id % 20 > 0) as seen, count(*) filter (event_id % 20 > 0) as plausible from events")
def choose_coord_mode(spark, sf_dir):
    return _mode(_observations(spark, sf_dir))


@query("select event_id as fid from events where event_id % 4 > 0 and event_id % 5 > 0")
def magnetic_row_filter(spark, sf_dir):
    s = survey_lines(spark, sf_dir)
    s = s.select("fid", F.when(F.col("fid") % 4 > 0, F.col("x")).alias("x"), "y", F.when((F.col("fid") % 5 > 0) & (F.col("fid") % 2 == 0), F.col("m")).alias("tmf"), F.when((F.col("fid") % 5 > 0) & (F.col("fid") % 2 == 1), F.col("m")).alias("mag_lev"))
    return ingest.magnetic_row_filter(s).select("fid")


@query("select c_custkey as id, c_mktsegment as name, 'v1' as version from customer")
def table_transform(spark, sf_dir):
    return ingest.table_transform(table(spark, sf_dir, "customer"), {"c_custkey": "id", "c_mktsegment": "name"}, {"version": "v1"}, ["id", "name", "version", "absent"])


@query(f"{with_views('collars')} select hole_id, {r('x', 'x', 2)}, {r('y', 'y', 2)}, 32630 as epsg from collars")
def reproject_xy(spark, sf_dir):
    """UTM to degrees, to web Mercator and back to UTM: the same places."""
    c = collars(spark, sf_dir).select("hole_id", "x", "y", F.lit(32630).alias("epsg"))
    for target in (4326, 3857, 32630):
        c = ingest.reproject_xy(c, target)
    return rounded(c, 2)


