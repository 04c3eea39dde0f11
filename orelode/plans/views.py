"""Drill-hole, line and grid views of the driver's tables, for Spark and for DuckDB.

The tables hold no drill data, so operators run on these: collars are orders,
surveys and assays are line items in running depths, survey lines are events
of a user, points are embeddings, the grid is made of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import spread

GRID_NX = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("hole_id"), (500000.0 + (k % 100) * 50).alias("x"), (600000.0 + F.floor(k / 100) * 50).alias("y"), (200 + F.col("o_totalprice") / 10000).alias("z"))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("hole_id"), F.sum(10 + F.col("l_partkey") % 40).over(w).cast("double").alias("depth_m"), (F.col("l_partkey") % 360).cast("double").alias("azimuth_deg"), (-(45 + F.col("l_suppkey") % 45)).cast("double").alias("dip_deg"))


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("hole_id"), (F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("l_quantity")).alias("from_m"), F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("to_m"),
        (F.col("l_extendedprice") / 10000).alias("grade"), (2 + 10 * F.col("l_tax")).alias("sg"), F.col("l_returnflag").alias("rock"), F.row_number().over(w).cast("long").alias("sample_no"),
    )


def survey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 3.6e9
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("fid"), "ts", (500000 + 10 * hours).alias("x"), (600000.0 + 25 * F.col("user_id")).alias("y"), F.lit(0.0).alias("z"), F.col("value").alias("m"), F.get_json_object("props", "$.k").cast("double").alias("igrf"))


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *((1000 * e(k)).alias(c) for k, c in enumerate("xyz", 1)), (F.col("label") + e(4)).alias("v"))


def part_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The parts as a grid of GRID_NX columns, and its spec."""
    p = table(spark, sf_dir, "part")
    n = p.agg(F.max("p_partkey")).first()[0] + 1
    ny = -(-n // GRID_NX)
    ix, iy = F.col("p_partkey") % GRID_NX, F.floor(F.col("p_partkey") / GRID_NX)
    g = p.select(ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), (ix * 10.0).alias("x"), (iy * 10.0).alias("y"), (F.col("p_size") + F.col("p_retailprice") / 100).cast("double").alias("v"))
    return g, {"nx": GRID_NX, "ny": ny, "xmin": 0.0, "xmax": (GRID_NX - 1) * 10.0, "ymin": 0.0, "ymax": (ny - 1) * 10.0}


_W = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
SQL = {
    "collars": "select o_orderkey as hole_id, 500000.0::double + (o_orderkey % 100) * 50 as x, 600000.0::double + (o_orderkey // 100) * 50 as y, 200 + o_totalprice / 10000 as z from orders",
    "surveys": f"select l_orderkey as hole_id, (sum(10 + l_partkey % 40) over ({_W} rows unbounded preceding))::double as depth_m, (l_partkey % 360)::double as azimuth_deg, (-(45 + l_suppkey % 45))::double as dip_deg from lineitem",
    "assays": f"select l_orderkey as hole_id, sum(l_quantity) over ({_W} rows unbounded preceding) - l_quantity as from_m, sum(l_quantity) over ({_W} rows unbounded preceding) as to_m, l_extendedprice / 10000 as grade, 2 + 10 * l_tax as sg, l_returnflag as rock, row_number() over ({_W}) as sample_no from lineitem",
    "lines": "select user_id as line, event_id as fid, ts, 500000 + 10 * ((epoch_us(ts) - 1704067200000000)::double / 3.6e9::double) as x, 600000.0::double + 25 * user_id as y, 0.0::double as z, value as m, (props::json->>'k')::double as igrf from events",
    "points": "select vec_id as pid, 1000 * embedding[1]::double as x, 1000 * embedding[2]::double as y, 1000 * embedding[3]::double as z, label + embedding[4]::double as v from embeddings",
    "grid": f"select (p_partkey % {GRID_NX})::int as ix, (p_partkey // {GRID_NX})::int as iy, (p_partkey % {GRID_NX}) * 10.0::double as x, (p_partkey // {GRID_NX}) * 10.0::double as y, (p_size + p_retailprice / 100)::double as v from part",
    "segs": """select c.hole_id, case when s.depth_m is null then 0.0 else coalesce(lag(s.depth_m) over w, 0.0) end as depth_from, coalesce(s.depth_m, 1.0) as depth_to, c.x as cx, c.y as cy, c.z as cz, s.azimuth_deg, s.dip_deg,
      s.depth_m - coalesce(lag(s.depth_m) over w, 0.0) as d from collars c left join surveys s on c.hole_id = s.hole_id window w as (partition by c.hole_id order by s.depth_m, s.azimuth_deg, s.dip_deg)""",
    "steps": "select *, d * cos(radians(dip_deg)) * sin(radians(azimuth_deg)) as dx, d * cos(radians(dip_deg)) * cos(radians(azimuth_deg)) as dy, d * sin(radians(dip_deg)) as dz from segs",
    "segments": """select hole_id, depth_from, depth_to, coalesce(cx + sum(dx) over w - dx, cx) as x_from, coalesce(cy + sum(dy) over w - dy, cy) as y_from, coalesce(cz + sum(dz) over w - dz, cz) as z_from,
      coalesce(cx + sum(dx) over w, cx) as x_to, coalesce(cy + sum(dy) over w, cy) as y_to, coalesce(cz + sum(dz) over w, cz - 1) as z_to from steps window w as (partition by hole_id order by depth_to, azimuth_deg, dip_deg rows unbounded preceding)""",
}
#: What a view is made of.
NEEDS = {"segs": ("collars", "surveys"), "steps": ("segs",), "segments": ("steps",)}


def with_views(*names: str) -> str:
    """``with a as (...), b as (...)`` of the named views and what they need."""
    seen: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, ()):
            add(m)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in seen)
