"""Survey line and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..operators import ingest, lines, magnetics
from .registry import query, r, rounded
from .grid_queries import relaxed
from .views import survey_lines, table, with_views

_ALONG = ", st as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as st from lines window w as (partition by line order by fid)), al as (select *, sum(st) over (partition by line order by fid rows unbounded preceding) as along_m from st)"


def _along(spark, sf_dir):
    return lines.along_track_distance(survey_lines(spark, sf_dir))


@query(f"{with_views('lines')}{_ALONG} select line, fid, {r('along_m', 'along_m')} from al")
def along_track_distance(spark, sf_dir):
    return rounded(_along(spark, sf_dir).select("line", "fid", "along_m"))


@query(f"{with_views('lines')}, o as (select *, max(ts) over (partition by line order by (fid * 7919) % 1000003, fid rows between unbounded preceding and 1 preceding) as top from lines) select line, fid from o where top is null or ts >= top")
def order_violation_filter(spark, sf_dir):
    d = survey_lines(spark, sf_dir).withColumn("arrival", F.struct((F.col("fid") * 7919) % 1000003, "fid"))
    return lines.order_violation_filter(d, arrival="arrival").select("line", "fid")


@query(f"{with_views('lines')}{_ALONG}, g as (select *, (m - lag(m) over w) / greatest(along_m - lag(along_m) over w, 1e-6) as g from al window w as (partition by line order by along_m, fid)), a as (select line, median(g) as med from g group by 1), b as (select line, med, greatest(median(abs(g - med)), 1e-9) as mad from g join a using (line) group by 1, 2) select line, fid from g join b using (line) where g is null or abs(g) <= abs(med) + 3 * 1.4826 * mad")
def despike(spark, sf_dir):
    return lines.despike(_along(spark, sf_dir), sigma=3.0, order=["fid"]).select("line", "fid")


@query(f"{with_views('lines')}{_ALONG} select line, fid, {r('avg(m) over (partition by line order by along_m range between 250.5 preceding and 250.5 following)', 'm', 3)} from al")
def smooth_by_distance(spark, sf_dir):
    return rounded(lines.smooth_by_distance(_along(spark, sf_dir), 501.0).select("line", "fid", "m"), 3)


@query(f"""{with_views('lines')}{_ALONG}, n as (select *, lead(along_m) over w as n_along, lead(m) over w as n_m, lead(x) over w as n_x from al window w as (partition by line order by along_m, fid)),
 k as (select *, unnest(range(ceil(along_m / 100)::bigint, case when n_along is null then floor(along_m / 100)::bigint + 1 else ceil(n_along / 100)::bigint end)) as k from n)
 select line, fid, k, {r('case when n_along > along_m then x + (k * 100 - along_m) / (n_along - along_m) * (n_x - x) else x end', 'x', 3)}, {r('case when n_along > along_m then m + (k * 100 - along_m) / (n_along - along_m) * (n_m - m) else m end', 'm', 3)} from k""")
def resample_by_distance(spark, sf_dir):
    d = lines.resample_by_distance(_along(spark, sf_dir), 100.0, order=["fid"])
    return rounded(d.select("line", "fid", F.round(F.col("along_m") / 100).cast("long").alias("k"), "x", "m"), 3)


@query(f"{with_views('lines')}{_ALONG}, o as (select line, fid, row_number() over (partition by line order by along_m, fid) - 1 as k, count(*) over (partition by line) as n from al) select line, fid from o where n <= 2 or k % 4 = 0 or k = n - 1")
def decimate(spark, sf_dir):
    return lines.decimate(_along(spark, sf_dir), 25.0, order=["fid"]).select("line", "fid")


@query(f"{with_views('lines')}, a as (select median(abs(m)) as med, count(igrf) as n from lines) select fid, case when med > 10 and n > 0 and igrf is not null then m - igrf else m end as m from lines, a")
def igrf_subtract(spark, sf_dir):
    return ingest.igrf_subtract(survey_lines(spark, sf_dir).select("fid", "m", "igrf"), 10.0).select("fid", "m")


@query(f"{with_views('lines')}, p as (select * from lines where fid % 3 > 0) select (select count(*) from lines) as rows, count(*) as points, (select count(*) from lines) - count(*) as dropped, count(distinct line) as lines, min(m) as m_min, max(m) as m_max, {r('avg(m)', 'm_mean')}, {r('median(m)', 'm_median')} from p")
def magnetic_report(spark, sf_dir):
    d = survey_lines(spark, sf_dir)
    return rounded(lines.magnetic_report(d, d.where("fid % 3 > 0")), only=["m_mean", "m_median"])


def _model(spark, sf_dir, **how):
    d = survey_lines(spark, sf_dir).withColumn("tmf", F.when(F.col("fid") % 50 > 0, F.col("m")))
    return magnetics.magnetic_model(d, **({"resolution": 100.0, "k": 8, "max_cells": 20_000} | how))


# Rows in order of time, cleaned of spikes; the resolution grows until the grid is small enough; eight neighbours a node.
_MODEL = f"""{with_views('lines').replace('with ', 'with recursive ', 1)}, tm as (select * from lines where fid % 50 > 0 and m is not null), md as (select median(abs(m)) as med, count(igrf) as n from tm),
 ig as (select line, fid, ts, x, y, case when med > 5000 and n > 0 and igrf is not null then m - igrf else m end as m from tm, md), o as (select *, max(ts) over (partition by line order by fid rows between unbounded preceding and 1 preceding) as top from ig qualify top is null or ts >= top),
 st as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as st from o window w as (partition by line order by fid)), al as (select *, sum(st) over (partition by line order by fid rows unbounded preceding) as along_m from st),
 g as (select *, (m - lag(m) over w) / greatest(along_m - lag(along_m) over w, 1e-6) as g from al window w as (partition by line order by fid)), a as (select line, median(g) as med from g group by 1), b as (select line, med, greatest(median(abs(g - med)), 1e-9) as mad from g join a using (line) group by 1, 2),
 pts as materialized (select line, fid, x, y, m, row_number() over (order by line::varchar, fid) as pid from g join b using (line) where g is null or abs(g) <= abs(med) + 6 * 1.4826 * mad),
 ext as (select min(x) as x0, max(x) - min(x) as w, min(y) as y0, max(y) - min(y) as h from pts), rs as (select 100.0::double as res from ext union all select res * greatest(1.01, sqrt((floor(w / res) + 1) * (floor(h / res) + 1) / 20000)) from rs, ext where (floor(w / res) + 1) * (floor(h / res) + 1) > 20000),
 sp as materialized (select x0, y0, max(res) as res, greatest(2, floor(w / max(res)) + 1)::int as nx, greatest(2, floor(h / max(res)) + 1)::int as ny from rs, ext group by x0, y0, w, h),
 node as (select (k % nx)::int as ix, (k // nx)::int as iy, x0 + (k % nx) * res as x, y0 + (k // nx) * res as y from (select *, unnest(range(nx * ny)) as k from sp)),
 near as (select ix, iy, unnest(min(struct_pack(d := sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2), pid := p.pid, v := p.m), 8)) as q from node n, pts p group by ix, iy),
 grid as materialized (select ix, iy, case when min(q.d) < 1e-6 then arg_min(q.v, q.d) else sum(q.v / q.d ** 2) / sum(1 / q.d ** 2) end as v from near group by ix, iy)"""


@query(f"""{_MODEL}, t as (select p.*, greatest(least((p.x - x0) / ((nx - 1) * res), 1), 0) * (nx - 1) as tx, greatest(least((p.y - y0) / ((ny - 1) * res), 1), 0) * (ny - 1) as ty, nx, ny from pts p, sp), l as (select *, floor(tx)::int as ix, floor(ty)::int as iy, tx - floor(tx) as fx, ty - floor(ty) as fy from t)
 select l.line::varchar as line, fid, {r('l.x', 'x')}, {r('l.y', 'y')}, {r('m', 'm')}, {r('(a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy', 'm_grid')} from l join grid a on a.ix = l.ix and a.iy = l.iy join grid b on b.ix = least(l.ix + 1, nx - 1) and b.iy = l.iy
 join grid c on c.ix = l.ix and c.iy = least(l.iy + 1, ny - 1) join grid d on d.ix = least(l.ix + 1, nx - 1) and d.iy = least(l.iy + 1, ny - 1)""")
def magnetic_model(spark, sf_dir):
    return rounded(_model(spark, sf_dir)["points"].select("line", "fid", "x", "y", "m", "m_grid"))


@query(f"""{_MODEL}, {relaxed(8)}, s as (select g.ix, g.iy, g.v, w.v as w, e.v as e, s.v as s, n.v as n, res from sp, r8 g left join r8 w on w.ix = g.ix - 1 and w.iy = g.iy left join r8 e on e.ix = g.ix + 1 and e.iy = g.iy left join r8 s on s.ix = g.ix and s.iy = g.iy - 1 left join r8 n on n.ix = g.ix and n.iy = g.iy + 1),
 d as (select ix, iy, v, -((e - 2 * v + w) / res ** 2 + (n - 2 * v + s) / res ** 2) as fvd, sqrt(((e - w) / (2 * res)) ** 2 + ((n - s) / (2 * res)) ** 2) as g from s) select ix, iy, {r('v', 'v')}, {r('fvd', 'fvd', 7)}, {r('g', 'grad_mag')}, {r('atan2(fvd, greatest(g, 1e-9))', 'tilt')} from d""")
def magnetic_model_grid(spark, sf_dir):
    g = _model(spark, sf_dir, relax=True)["grid"]
    return rounded(rounded(g.select("ix", "iy", "v", "fvd", "grad_mag", "tilt"), 7, only=["fvd"]), only=["v", "grad_mag", "tilt"])


def _feed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_type", "ts", "event_id")


@query("with e as (select user_id::varchar as key, event_type as hash, ts from events) select key, hash, ts from e qualify lag(hash) over (partition by key order by ts, hash) is distinct from hash")
def change_feed(spark, sf_dir):
    return streaming.change_feed_batch(_feed(spark, sf_dir).select("key", F.col("event_type").alias("hash"), "ts"))


@query("with o as (select user_id as line, (event_id * 7919) % 1000003 as id, ts from events), p as (select *, max(ts) over (partition by line order by id rows between unbounded preceding and 1 preceding) as top from o) select line, id, ts from p where top is null or ts >= top")
def ordered_line_ingest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), ((F.col("event_id") * 7919) % 1000003).alias("id"), "ts")
    return streaming.ordered_line_batch(e.unionByName(e.where("id % 2 = 0")))


@query("with e as (select user_id::varchar as key, ts from events), n as (select max(ts) as now from e), g as (select key, ts, coalesce(lead(ts) over (partition by key order by ts), now) as e from e, n) select key, ts as last_ts from g where epoch_us(e) - epoch_us(ts) > 36000000000")
def stale_key_detection(spark, sf_dir):
    return streaming.stale_key_batch(_feed(spark, sf_dir), 36000.0)
