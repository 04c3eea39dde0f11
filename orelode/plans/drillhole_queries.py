"""Drill-hole queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drillhole as d
from .registry import query, r, rounded
from .views import assays, collars, surveys, with_views

_ENDS = [f"{c}_{e}" for e in ("from", "to") for c in "xyz"]


def segments(spark, sf_dir):
    return d.desurvey(collars(spark, sf_dir), surveys(spark, sf_dir))


@query(f"{with_views('segments')} select hole_id, depth_from, depth_to, {', '.join(r(c, c) for c in _ENDS)} from segments")
def desurvey(spark, sf_dir):
    return rounded(segments(spark, sf_dir))


@query(f"{with_views('collars', 'surveys')} select c.hole_id, count(s.depth_m) as stations from collars c left join surveys s on c.hole_id = s.hole_id group by 1")
def desurvey_join(spark, sf_dir):
    return d.desurvey_join(collars(spark, sf_dir), surveys(spark, sf_dir)).groupBy("hole_id").agg(F.count("depth_m").alias("stations"))


@query(f"{with_views('segments')} select hole_id, depth_from, depth_to, row_number() over (partition by hole_id order by depth_from, depth_to) - 1 as idx from segments")
def segment_index(spark, sf_dir):
    return d.segment_index(segments(spark, sf_dir)).select("hole_id", "depth_from", "depth_to", F.col("idx").cast("long").alias("idx"))


@query("with a as (select * from lineitem where l_linenumber % 2 = 0), b as (select * from lineitem where l_linenumber % 2 = 1), u as (select l_orderkey as hole_id, l_quantity as q from a union all select l_orderkey, l_quantity from b) select hole_id, count(*) as n, sum(q) as q from u group by 1")
def drillhole_merge(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("hole_id"), F.col("l_quantity").alias("q"), "l_linenumber")
    shards = [t.where("l_linenumber % 2 = 0").drop("l_linenumber"), t.where("l_linenumber % 2 = 1").drop("l_linenumber")]
    return d.drillhole_merge(shards).groupBy("hole_id").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@query(f"{with_views('segments', 'assays')} select s.hole_id, depth_from, depth_to, sample_no, from_m, to_m from segments s left join assays a on s.hole_id = a.hole_id and a.to_m > s.depth_from and a.from_m < s.depth_to")
def segment_assay_overlap(spark, sf_dir):
    return d.segment_assay_overlap(segments(spark, sf_dir), assays(spark, sf_dir)).select("hole_id", "depth_from", "depth_to", "sample_no", "from_m", "to_m")


_POINTS = """, m as (select *, (from_m + to_m) * 0.5 as depth_m from assays),
 j as (select m.*, s.* exclude (hole_id), row_number() over (partition by m.hole_id, sample_no order by depth_from, depth_to) as k from m join segments s on m.hole_id = s.hole_id and depth_m between depth_from and depth_to),
 ap as (select hole_id, sample_no, from_m, to_m, grade, sg, rock, depth_m, x_from + t * (x_to - x_from) as x, y_from + t * (y_to - y_from) as y, z_from + t * (z_to - z_from) as z
   from (select *, case when depth_to > depth_from then (depth_m - depth_from) / (depth_to - depth_from) else 0 end as t from j where k = 1))"""
ASSAY_POINTS = with_views("segments", "assays") + _POINTS


def points(spark, sf_dir):
    return d.assay_points(segments(spark, sf_dir), assays(spark, sf_dir))


@query(f"{ASSAY_POINTS} select hole_id, sample_no, depth_m, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from ap")
def assay_points(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("hole_id", "sample_no", "depth_m", "x", "y", "z"), only=["x", "y", "z"])


@query(f"{ASSAY_POINTS} select floor(z / 100)::bigint as band, count(*) as n, {r('avg(grade)', 'mean_grade')} from ap group by 1")
def grade_by_elevation(spark, sf_dir):
    """Where in 3-D is the metal: mean grade by 100 m band of elevation."""
    return rounded(points(spark, sf_dir).groupBy(F.floor(F.col("z") / 100).alias("band")).agg(F.count("*").alias("n"), F.avg("grade").alias("mean_grade")))


_SOME = "select hole_id, sample_no from assays where hole_id {} in (select hole_id from segments where z_to < 150)"


@query(f"{with_views('segments', 'assays')} {_SOME.format('')}")
def assays_with_known_hole(spark, sf_dir):
    return d.assays_with_known_hole(assays(spark, sf_dir), segments(spark, sf_dir).where("z_to < 150")).select("hole_id", "sample_no")


@query(f"{with_views('segments', 'assays')} {_SOME.format('not')}")
def orphan_assays(spark, sf_dir):
    return d.assays_with_known_hole(assays(spark, sf_dir), segments(spark, sf_dir).where("z_to < 150"), anti=True).select("hole_id", "sample_no")


@query(f"""{with_views('segments', 'assays')}, o as (select s.hole_id, row_number() over (partition by s.hole_id order by depth_from, depth_to) - 1 as idx, depth_from, depth_to from segments s),
 v as (select o.hole_id, o.idx, case when rock <> 'N' then grade end as grade, case when rock <> 'N' then sg end as sg, rock from o join assays a on o.hole_id = a.hole_id and a.to_m > o.depth_from and a.from_m < o.depth_to),
 m as (select hole_id, idx, avg(grade) as grade, avg(sg) as sg from v group by all),
 n as (select hole_id, idx, 'grade' as field, floor(grade * 1e4 + 0.500001) / 1e4 as number, null as text from m where grade is not null union all select hole_id, idx, 'sg', floor(sg * 1e4 + 0.500001) / 1e4, null from m where sg is not null),
 c as (select hole_id, idx, rock, count(*) as k from v join m using (hole_id, idx) where m.grade is null and m.sg is null and rock is not null group by all),
 t as (select hole_id, idx, 'rock' as field, null::double as number, arg_min(rock, (-k, rock)) as text from c group by hole_id, idx)
 select * from n union all select * from t""")
def segment_measures(spark, sf_dir):
    a = assays(spark, sf_dir)
    for c in ("grade", "sg"):
        a = a.withColumn(c, F.when(F.col("rock") != "N", F.col(c)))
    o = d.segment_assay_overlap(d.segment_index(segments(spark, sf_dir)), a).withColumn("idx", F.col("idx").cast("long"))
    m = d.segment_measures(o, ["grade", "sg"], ["rock"])
    text = F.col("field") == "rock"
    return m.select("hole_id", "idx", "field", F.when(~text, F.floor(F.col("value").try_cast("double") * 1e4 + 0.500001) / 1e4).alias("number"), F.when(text, F.col("value")).alias("text"))


@query(f"""{with_views('segments')}, p as (select hole_id, depth_from as depth, x_from as x, y_from as y, z_from as z from segments union select hole_id, depth_to, x_to, y_to, z_to from segments),
 q as (select distinct hole_id, round(depth, 3) as depth, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from p)
 select hole_id, count(*) as vertices, {r('min(z)', 'low', 3)} from q group by 1""")
def trace_polylines(spark, sf_dir):
    s = segments(spark, sf_dir)
    s = s.select("hole_id", *(F.round(c, 3).alias(c) for c in s.columns if c != "hole_id"))
    t = d.trace_polylines(s)
    return rounded(t.select("hole_id", F.size("vertices").cast("long").alias("vertices"), F.array_min(F.transform("vertices", lambda v: v["z"])).alias("low")), 3)


@query(f"""with recursive {ASSAY_POINTS[5:]},
 o as (select *, row_number() over (partition by hole_id order by from_m, sample_no) as k, greatest(case when to_m > from_m then to_m - from_m else 1 end, 1e-6) as w from ap),
 f as (select hole_id, k, w as acc, 0 as g from o where k = 1
   union all select o.hole_id, o.k, case when f.acc >= 60 then o.w else f.acc + o.w end, f.g + case when f.acc >= 60 then 1 else 0 end from f join o on o.hole_id = f.hole_id and o.k = f.k + 1)
 select hole_id, min(from_m) as from_m, max(to_m) as to_m, {r('sum(w)', 'support_m')}, {r('sum(grade * w) / sum(w)', 'v')}, {r('sum(sg * w) / sum(w)', 'sg')}, {r('sum(z * w) / sum(w)', 'z')}, {r('(min(depth_m) + max(depth_m)) / 2', 'depth_m')}
 from o join f using (hole_id, k) group by hole_id, g""")
def composite_intervals(spark, sf_dir):
    s = points(spark, sf_dir).withColumnRenamed("grade", "v")
    return rounded(d.composite_intervals(s, 60.0).select("hole_id", "from_m", "to_m", "support_m", "v", "sg", "z", "depth_m"))
