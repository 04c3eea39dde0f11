"""Neighbour, grid, terrain and contour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contours, grids, neighbours
from ..operators.shared import materialise
from .registry import query, r, rounded
from .views import part_grid, points3d, table, with_views


def _targets(spark, sf_dir):
    """Places to estimate at: parts, spread over the points' square."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 4001 - 2000).cast("double").alias("x"), ((F.col("p_partkey") * 91) % 4001 - 2000).cast("double").alias("y"), F.lit(0.0).alias("z"))


_T = "t as (select p_partkey as id, ((p_partkey * 37) % 4001 - 2000)::double as x, ((p_partkey * 91) % 4001 - 2000)::double as y, 0.0::double as z from part)"
_NEAR = f"""{with_views('points')}, {_T}, d as (select t.id, p.pid, sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2) as d, p.v from t, points p),
 n as (select *, row_number() over (partition by id order by d, pid) as rank from d qualify rank <= {{k}})"""


@query(f"{_NEAR.format(k=8)} select id, pid, rank, {r('d', 'd')}, {r('v', 'v')} from n")
def knn_2d(spark, sf_dir):
    d = neighbours.knn_2d(_targets(spark, sf_dir), points3d(spark, sf_dir), 8)
    return rounded(d.withColumn("rank", F.col("rank").cast("long")))


@query(f"{_NEAR.format(k=8)} select id, pid, rank, {r('d', 'd')} from n")
def knn_2d_buckets(spark, sf_dir):
    """The same neighbours by joins on cells, as for points that can't be broadcast."""
    d = neighbours.knn(_targets(spark, sf_dir), points3d(spark, sf_dir), 8, broadcast_rows=0)
    return rounded(d.select("id", "pid", F.col("rank").cast("long").alias("rank"), "d"))


@query(f"""{with_views('points')}, {_T}, c as (select cos(radians(30)) as c, sin(radians(30)) as s), u as (select id, x, y, z, (x * c + y * s) / 2 as a, -x * s + y * c as b, z / .5 as w from t, c),
 q as (select pid, v, x, y, z, (x * c + y * s) / 2 as a, -x * s + y * c as b, z / .5 as w from points, c),
 d as (select u.id, q.pid, sqrt((u.a - q.a) ** 2 + (u.b - q.b) ** 2 + (u.w - q.w) ** 2) as dn, sqrt((u.x - q.x) ** 2 + (u.y - q.y) ** 2 + (u.z - q.z) ** 2) as dt from u, q),
 n as (select *, row_number() over (partition by id order by dn, pid) as rank from d where dn <= 1500 qualify rank <= 6) select id, pid, rank, {r('dn', 'd_norm')}, {r('dt', 'd_true')} from n""")
def knn_3d_anisotropic(spark, sf_dir):
    d = neighbours.knn_3d_anisotropic(_targets(spark, sf_dir), points3d(spark, sf_dir), 6, 1500.0, 30.0, 2.0, 1.0, 0.5)
    return rounded(d.select("id", "pid", F.col("rank").cast("long").alias("rank"), "d_norm", "d_true"))


@query(f"{_NEAR.format(k=1)} select id, {r('d', 'd')} from n")
def nearest_distance(spark, sf_dir):
    return rounded(neighbours.nearest_distance(_targets(spark, sf_dir), points3d(spark, sf_dir)))


_WEIGHTS = {"idw": "d ** -2.0", "rbf": "exp(-((d / far) ** 2))", "kriging": "1 / (.05 + greatest(1 - exp(-d / far), 1e-6))", "nearest": "case when rank = 1 then 1 else 0 end"}
_METHODS = " union all ".join(f"select '{m}' as method, id, sum({w} * v) / sum({w}) as v from f group by id" for m, w in _WEIGHTS.items())


@query(f"{_NEAR.format(k=12)}, f as (select *, max(d) over (partition by id) as far from n), u as ({_METHODS}) select method, id, {r('v', 'v')} from u")
def interpolate(spark, sf_dir):
    near = neighbours.knn_2d(_targets(spark, sf_dir), points3d(spark, sf_dir), 12)
    near, out = materialise(neighbours.gathered(near), "neighbours"), None  # read once a method
    for m in _WEIGHTS:
        one = neighbours.weighted(near, m).select(F.lit(m).alias("method"), "id", "v")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"""{with_views('points')}, d as (select a.pid as id, a.v as observed, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, b.pid, b.v from points a, points b where a.pid <> b.pid),
 n as (select *, row_number() over (partition by id order by d, pid) as rank from d qualify rank <= 32), p as (select id, observed, sum(v / d ** 2) / sum(1 / d ** 2) as predicted from n group by 1, 2) select id, {r('observed', 'observed')}, {r('predicted', 'predicted')}, {r('observed - predicted', 'residual')} from p""")
def leave_one_out(spark, sf_dir):
    return rounded(neighbours.leave_one_out(points3d(spark, sf_dir)))


@query(f"{with_views('points')}, d as (select a.pid as i, b.pid as j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d, .5 * (a.v - b.v) ** 2 as h from points a join points b on a.pid < b.pid) select i, j, {r('d', 'd')}, {r('h', 'half_sq_diff')} from d where d <= 150")
def pair_self_join(spark, sf_dir):
    return rounded(neighbours.pair_self_join(points3d(spark, sf_dir), 150.0))


@query(f"{with_views('grid')} select ix, iy, {r('x', 'x')}, {r('y', 'y')} from grid")
def make_grid(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(grids.make_grid(spark, spec).join(g.select("ix", "iy"), ["ix", "iy"], "left_semi"))


_LOOK = """, s as (select p_partkey as id, (p_partkey * 13) % 230 * .8 - 5 as x, (p_partkey * 29) % 1000 * .9 as y from part), m as (select max(ix) as mx, max(iy) as my from grid),
 l as (select id, s.x, s.y, floor(s.x / 10)::int as ix, floor(s.y / 10)::int as iy, s.x / 10 - floor(s.x / 10) as fx, s.y / 10 - floor(s.y / 10) as fy, mx, my from s, m where s.x between 0 and mx * 10 and s.y between 0 and my * 10),
 b as (select l.*, (a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy as v from l join grid a on a.ix = l.ix and a.iy = l.iy join grid b on b.ix = least(l.ix + 1, mx) and b.iy = l.iy join grid c on c.ix = l.ix and c.iy = least(l.iy + 1, my) join grid d on d.ix = least(l.ix + 1, mx) and d.iy = least(l.iy + 1, my))"""


def _look(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), ((k * 13) % 230 * 0.8 - 5).alias("x"), ((k * 29) % 1000 * 0.9).alias("y"))


@query(f"{with_views('grid')}{_LOOK} select s.id, {r('b.v', 'v')} from s left join b on s.id = b.id")
def bilinear_sample(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(grids.bilinear_sample(_look(spark, sf_dir), g, spec).select("id", "v"))


def _controls(spark, sf_dir):
    return _look(spark, sf_dir).where("id % 5 = 0").withColumn("z", 30 + F.col("x") / 10 - F.col("y") / 50)


_MATCH = f"{with_views('grid')}{_LOOK}, c as (select x, y, 30 + x / 10 - y / 50 as z_obs, v as z_grid from b where id % 5 = 0 and v is not null)"


@query(f"{_MATCH} select {r('x', 'x')}, {r('y', 'y')}, {r('z_obs', 'z_obs')}, {r('z_grid', 'z_grid')} from c")
def terrain_control_match(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(grids.terrain_control_match(_controls(spark, sf_dir), g, spec))


_FIT = f"""{_MATCH}, o as (select avg(x) as cx, avg(y) as cy from c), mm as (select x - cx as u, y - cy as w, z_obs - z_grid as r, cx, cy from c, o),
 q as (select sum(r) sr, sum(u) sx, sum(w) sy, sum(u * u) sxx, sum(w * w) syy, sum(u * w) sxy, sum(u * r) sxr, sum(w * r) syr, count(*) n, any_value(cx) cx, any_value(cy) cy, sqrt(avg(r * r)) as rmse_before from mm),
 t as (select *, case when abs(sxx * syy - sxy * sxy) > 1e-9 then (sxr * syy - syr * sxy) / (sxx * syy - sxy * sxy) else 0 end as tilt_x, case when abs(sxx * syy - sxy * sxy) > 1e-9 then (syr * sxx - sxr * sxy) / (sxx * syy - sxy * sxy) else 0 end as tilt_y from q), f as (select *, (sr - tilt_x * sx - tilt_y * sy) / n as dz from t)"""


@query(f"{_FIT} select {r('any_value(dz)', 'dz')}, {r('any_value(tilt_x)', 'tilt_x')}, {r('any_value(tilt_y)', 'tilt_y')}, {r('any_value(f.cx)', 'cx')}, {r('any_value(f.cy)', 'cy')}, {r('any_value(rmse_before)', 'rmse_before')}, {r('sqrt(avg((r - dz - tilt_x * u - tilt_y * w) ** 2))', 'rmse_after')} from mm, f")
def plane_fit(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(grids.plane_fit(grids.terrain_control_match(_controls(spark, sf_dir), g, spec), "affine_xy_z"))


@query(f"{_FIT}, e as (select max(ix) + 1 as nx, max(iy) + 1 as ny from grid) select ix, iy, {r('v + dz + tilt_x * ((ix + .5) / nx * (nx - 1) * 10 - cx) + tilt_y * ((iy + .5) / ny * (ny - 1) * 10 - cy)', 'v')} from grid, f, e")
def terrain_adjust(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(grids.terrain_adjust(g, spec, _controls(spark, sf_dir), "affine_xy_z")[0].select("ix", "iy", "v"))


@query(f"""{with_views('grid')}, hole as (select ix, iy, case when (ix + iy) % 11 <> 0 then v end as v from grid), m as (select max(ix) as mx, max(iy) as my, max(ix) * 10.0::double as w, max(iy) * 10.0::double as h from grid),
 n as (select *, least(greatest(ceil(w / 15)::int + 1, 8), 512) as nx, least(greatest(ceil(h / 15)::int + 1, 8), 512) as ny from m), node as (select (k % nx)::int as ix, (k // nx)::int as iy, (k % nx)::double / (nx - 1) * w as x, (k // nx)::double / (ny - 1) * h as y, mx, my, w, h from (select *, unnest(range(nx * ny)) as k from n)),
 t as (select *, least(x / w, 1) * mx as tx, least(y / h, 1) * my as ty from node), l as (select *, floor(tx)::int as jx, floor(ty)::int as jy, tx - floor(tx) as fx, ty - floor(ty) as fy from t),
 raw as (select l.ix, l.iy, l.x, l.y, (a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy as v from l left join hole a on a.ix = jx and a.iy = jy left join hole b on b.ix = least(jx + 1, mx) and b.iy = jy left join hole c on c.ix = jx and c.iy = least(jy + 1, my) left join hole d on d.ix = least(jx + 1, mx) and d.iy = least(jy + 1, my)),
 near as (select u.ix, u.iy, k.v, (u.x - k.x) * (u.x - k.x) + (u.y - k.y) * (u.y - k.y) as d2 from raw u, raw k where u.v is null and k.v is not null qualify row_number() over (partition by u.ix, u.iy order by d2, k.iy * 1000000 + k.ix) <= 12),
 full_ as (select ix, iy, v from raw where v is not null union all select ix, iy, sum(v / d2) / sum(1 / d2) from near group by ix, iy),
 c as (select (p_partkey * 13) % 230 * .8::double - 5 as x, (p_partkey * 29) % 1000 * .9::double as y from part where p_partkey % 5 = 0), on_ as (select c.*, x / w * (nx - 1) as tx, y / h * (ny - 1) as ty, nx, ny from c, n where x between 0 and w and y between 0 and h), at_ as (select *, floor(tx)::int as jx, floor(ty)::int as jy, tx - floor(tx) as fx, ty - floor(ty) as fy from on_),
 hit as (select 30 + x / 10 - y / 50 as z_obs, (a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy as z_grid from at_ join full_ a on a.ix = jx and a.iy = jy join full_ b on b.ix = least(jx + 1, nx - 1) and b.iy = jy join full_ c on c.ix = jx and c.iy = least(jy + 1, ny - 1) join full_ d on d.ix = least(jx + 1, nx - 1) and d.iy = least(jy + 1, ny - 1))
 select f.ix, f.iy, {r('x', 'x')}, {r('y', 'y')}, {r('f.v + case when n >= 3 then dz else 0 end', 'v')} from full_ f join node using (ix, iy), (select avg(z_obs - z_grid) as dz, count(*) as n from hit)""")
def terrain_from_raster(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    holes = g.withColumn("v", F.when((F.col("ix") + F.col("iy")) % 11 != 0, F.col("v")))
    return rounded(grids.terrain_from_raster(holes, spec, _controls(spark, sf_dir), resolution=15.0)[0])


_TRUST = f"""{with_views('grid')}, c as (select (p_partkey * 13) % 230 * 0.8::double - 5 as cx, (p_partkey * 29) % 1000 * 0.9::double as cy from part where p_partkey % 5 = 0), e as (select max((max_ix) * 10.0 / (max_ix + 1), (max_iy) * 10.0 / (max_iy + 1)) as cell from (select max(ix) as max_ix, max(iy) as max_iy from grid)),
 d as (select ix, iy, min(sqrt((x - cx) ** 2 + (y - cy) ** 2)) as d from grid, c group by ix, iy), k as (select ix, iy, case when d <= {{anchor}} * cell then 4 when d > {{low}} * cell then 0 else 3 end as class, d > {{low}} * cell as low_density from d, e)
 select ix, iy, class, case class when 4 then 1.0 when 0 then .12 else .82 end::double as score, low_density from k"""


@query(_TRUST.replace("max((max_ix)", "greatest((max_ix)").format(anchor=0.75, low=1.5))
def terrain_confidence(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return grids.terrain_confidence(g, _controls(spark, sf_dir), spec, low_density_cells=1.5)


_STENCIL = f"{with_views('grid')}, s as (select g.ix, g.iy, g.v, w.v as w, e.v as e, s.v as s, n.v as n from grid g left join grid w on w.ix = g.ix - 1 and w.iy = g.iy left join grid e on e.ix = g.ix + 1 and e.iy = g.iy left join grid s on s.ix = g.ix and s.iy = g.iy - 1 left join grid n on n.ix = g.ix and n.iy = g.iy + 1)"


@query(f"{_STENCIL} select ix, iy, {r('sqrt(((e - w) / 2) ** 2 + ((n - s) / 2) ** 2)', 'g')} from s")
def grid_gradient(spark, sf_dir):
    return rounded(grids.grid_gradient(part_grid(spark, sf_dir)[0]))


@query(f"{_STENCIL}, d as (select ix, iy, -((e - 2 * v + w) / 100 + (n - 2 * v + s) / 100) as fvd, sqrt(((e - w) / 20) ** 2 + ((n - s) / 20) ** 2) as g from s) select ix, iy, {r('fvd', 'fvd')}, {r('case when fvd is not null then g end', 'grad_mag')}, {r('atan2(fvd, case when fvd is not null then greatest(g, 1e-9) end)', 'tilt')} from d")
def magnetic_derivatives(spark, sf_dir):
    return rounded(grids.magnetic_derivatives(part_grid(spark, sf_dir)[0], 10.0))


def relaxed(passes: int) -> str:
    """CTEs r0 .. r{passes} over a CTE grid."""
    steps = ["r0 as (select ix, iy, v from grid)"]
    for k in range(passes):
        steps.append(f"r{k + 1} as (select g.ix, g.iy, coalesce(.5 * g.v + .125 * (w.v + e.v + s.v + n.v), g.v) as v from r{k} g left join r{k} w on w.ix = g.ix - 1 and w.iy = g.iy left join r{k} e on e.ix = g.ix + 1 and e.iy = g.iy left join r{k} s on s.ix = g.ix and s.iy = g.iy - 1 left join r{k} n on n.ix = g.ix and n.iy = g.iy + 1)")
    return ", ".join(steps).replace(" as (select", " as materialized (select")


@query(f"{with_views('grid')}, {relaxed(4)} select ix, iy, {r('v', 'v')} from r4")
def relax_grid(spark, sf_dir):
    return rounded(grids.relax_grid(part_grid(spark, sf_dir)[0], passes=4, tile=16))


_RASTER = f"""{with_views('points')}, e as (select min(x) a, max(x) - min(x) as w, min(y) c, max(y) - min(y) as h, count(*) as n from points), u as (select pid, (x - a) / w as x, (y - c) / h as y, v from points, e),
 q as (select v, row_number() over (order by v) - 1 as r from points), lim as (select max(v) filter (r = floor((n - 1) * .02 + .5)) as lo, max(v) filter (r = floor((n - 1) * .98 + .5)) as hi from q, e),
 cell as (select (i % 64)::int as ix, (i // 64)::int as iy, (i % 64 + .5) / 64 as x, (i // 64 + .5) / 64 as y from (select unnest(range(4096)) as i)),
 d as (select ix, iy, u.v, sqrt((cell.x - u.x) ** 2 + (cell.y - u.y) ** 2) as d, pid from cell, u qualify row_number() over (partition by ix, iy order by d, pid) <= 32),
 m as (select ix, iy, case when min(d) < 1e-12 then arg_min(v, d) else sum(v / d ** 2) / sum(1 / d ** 2) end as v from d group by ix, iy)"""


@query(f"{_RASTER} select ix, iy, {r('greatest(least(v, hi), lo)', 'v')} from m, lim")
def raster_interpolate(spark, sf_dir):
    return rounded(grids.raster_interpolate(points3d(spark, sf_dir), 64, 64))


@query(f"""{with_views('points')}, e as (select min(x) a, max(x) b, min(y) c, max(y) d from points), f as (select a - .25 * (b - a) as x0, b + .25 * (b - a) as x1, c - .25 * (d - c) as y0, d + .25 * (d - c) as y1 from e),
 n as (select *, least(greatest(ceil((x1 - x0) / 400)::int + 1, 8), 512) as nx, least(greatest(ceil((y1 - y0) / 400)::int + 1, 8), 512) as ny from f), g as (select *, unnest(range(nx * ny)) as k from n),
 h as (select (k % nx)::int as ix, (k // nx)::int as iy, x0 + (k % nx) / (nx - 1) * (x1 - x0) as x, y0 + (k // nx) / (ny - 1) * (y1 - y0) as y from g)
 select ix, iy, {r('sum(p.v / ((h.x - p.x) ** 2 + (h.y - p.y) ** 2)) / sum(1 / ((h.x - p.x) ** 2 + (h.y - p.y) ** 2))', 'v')} from h, points p group by ix, iy""")
def idw_surface(spark, sf_dir):
    g, _ = grids.idw_surface(points3d(spark, sf_dir).select("x", "y", F.col("v").alias("z")), 400.0)
    return rounded(g.select("ix", "iy", "v"))


_RING = [(-1000.0, -1000.0), (1000.0, -1000.0), (0.0, 1000.0)]


@query(f"{with_views('points')} select pid, ((-1000 > y) <> (1000 > y) and x < (0 - 1000) * (y - -1000) / 2000 + 1000) <> ((1000 > y) <> (-1000 > y) and x < (-1000 - 0) * (y - 1000) / -2000 + 0) as inside from points")
def point_in_polygon(spark, sf_dir):
    return grids.point_in_polygon(points3d(spark, sf_dir), _RING).select("pid", "inside")


@query(f"{with_views('grid')}{_LOOK} select id from b where 20 + id % 60 + 5 <= v")
def topography_clip(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    b = _look(spark, sf_dir).withColumn("z", (20 + F.col("id") % 60).cast("double")).withColumn("dz", F.lit(10.0))
    return grids.topography_clip(b, g, spec).select("id")


_CELLS = f"""{with_views('grid')}, e as (select min(v) as lo, max(v) as hi from grid), lv as (select lo + i * ((hi - lo) / 10) as level from e, (select unnest(range(1, 10)) as i)),
 c as (select a.ix, a.iy, a.v as v00, b.v as v10, d.v as v11, c.v as v01 from grid a join grid b on b.ix = a.ix + 1 and b.iy = a.iy join grid c on c.ix = a.ix and c.iy = a.iy + 1 join grid d on d.ix = a.ix + 1 and d.iy = a.iy + 1),
 k as (select *, ix * 10.0 as xa, (ix + 1) * 10.0 as xb, iy * 10.0 as ya, (iy + 1) * 10.0 as yb from c, lv where level > least(v00, v10, v11, v01) and level <= greatest(v00, v10, v11, v01)),
 p as (select level, ix, iy, 0 as o, xa + 10 * (level - v00) / (v10 - v00) as x, ya as y from k where (v00 >= level) <> (v10 >= level) union all select level, ix, iy, 1, xb, ya + 10 * (level - v10) / (v11 - v10) from k where (v10 >= level) <> (v11 >= level)
   union all select level, ix, iy, 2, xb - 10 * (level - v11) / (v01 - v11), yb from k where (v11 >= level) <> (v01 >= level) union all select level, ix, iy, 3, xa, yb - 10 * (level - v01) / (v00 - v01) from k where (v01 >= level) <> (v00 >= level)),
 o as (select *, row_number() over (partition by level, ix, iy order by o) - 1 as j from p), g as (select a.level, a.ix, a.iy, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from o a join o b on a.level = b.level and a.ix = b.ix and a.iy = b.iy and b.j = a.j + 1 and a.j % 2 = 0)"""


@query(f"{_CELLS} select {r('level', 'level')} from lv")
def contour_breaks(spark, sf_dir):
    return rounded(contours.contour_breaks(part_grid(spark, sf_dir)[0]))


@query(f"{_CELLS} select {r('level', 'level')}, ix, iy, {r('x0', 'x0')}, {r('y0', 'y0')}, {r('x1', 'x1')}, {r('y1', 'y1')} from g")
def marching_squares(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(contours.marching_squares(g, spec, contours.contour_breaks(g)))


@query(f"{_CELLS} select {r('100 + 2 * level', 'z')}, count(*) as segments from g group by 1")
def iso_extract(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(contours.iso_extract(g, spec, z_base=100.0, z_scale=2.0).select("z")).groupBy("z").agg(F.count("*").alias("segments"))


@query(f"{_CELLS}, e2 as (select level, x0 as x, y0 as y from g union all select level, x1, y1 from g) select {r('level', 'level')}, {r('x', 'x')}, {r('y', 'y')}, {r('level', 'z')} from e2")
def contour_xyz(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return rounded(contours.contour_xyz(g, spec).select("level", "x", "y", "z"))


@query()
def stitch_contours(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    g = materialise(grids.relax_grid(g).join(g.select("ix", "iy", "x", "y"), ["ix", "iy"]), "relaxed")  # read for the levels and for the cells
    return contours.stitch_contours(contours.iso_extract(g, spec))


_HEAT = f"""{with_views('points')}, q as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from points where v is not null), lim as (select max(v) filter (i = floor((n - 1) * .02 + .5)) as lo, max(v) filter (i = floor((n - 1) * .98 + .5)) as hi from q),
 p as (select pid, x, y, greatest(least(v, hi), lo) as v from points, lim), e as (select min(x) as x0, max(x) - min(x) as w, min(y) as y0, max(y) - min(y) as h from p)"""


@query(f"""{_HEAT}, cell as (select (i % 64)::int as ix, (i // 64)::int as iy, x0 + i % 64 / 63 * w as x, y0 + i // 64 / 63 * h as y from e, (select unnest(range(4096)) as i)),
 d as (select ix, iy, p.v, sqrt((cell.x - p.x) ** 2 + (cell.y - p.y) ** 2) as d from cell, p qualify row_number() over (partition by ix, iy order by d, pid) <= 32)
 select ix, iy, {r('case when min(d) < 1e-6 then arg_min(v, d) else sum(v / greatest(d, 1e-9) ** 2) / sum(1 / greatest(d, 1e-9) ** 2) end', 'v')} from d group by ix, iy""")
def assay_heatmap(spark, sf_dir):
    grid, *_ = contours.assay_heatmap(points3d(spark, sf_dir).withColumnRenamed("v", "grade"), "grade", lo=2, hi=98)
    return rounded(grid.select("ix", "iy", "v"))


@query(f"""{_HEAT}, d as (select a.pid as id, a.v as observed, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, b.v from p a, p b where a.pid <> b.pid qualify row_number() over (partition by a.pid order by d, b.pid) <= 32),
 m as (select id, observed, sum(v / d ** 2) / sum(1 / d ** 2) as predicted from d group by id, observed) select id, {r('observed', 'observed')}, {r('predicted', 'predicted')}, {r('observed - predicted', 'residual')} from m""")
def assay_heatmap_residuals(spark, sf_dir):
    return rounded(contours.assay_heatmap(points3d(spark, sf_dir).withColumnRenamed("v", "grade"), "grade", lo=2, hi=98)[2])
