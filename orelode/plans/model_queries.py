"""Resource model, Euler depth and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, grids, magnetics, stats, tiles
from .grid_queries import relaxed
from .registry import query, r, rounded
from .views import part_grid, points3d, with_views


def _samples(spark, sf_dir):
    return points3d(spark, sf_dir).withColumn("sg", F.when(F.col("pid") % 3 > 0, 2.0 + F.col("pid") % 5))


def _extent(spark, sf_dir):
    return stats.extent_3d(points3d(spark, sf_dir), 0.05, 0.0, 0.0)


_SIZE = (100.0, 100.0, 80.0)
_BOX = f"{with_views('points')}, e as (select min(x) - .05 * (max(x) - min(x)) as x0, max(x) + .05 * (max(x) - min(x)) as x1, min(y) - .05 * (max(y) - min(y)) as y0, max(y) + .05 * (max(y) - min(y)) as y1, min(z) - .05 * (max(z) - min(z)) as z0, max(z) + .05 * (max(z) - min(z)) as z1 from points)"
_GRID = f"""{_BOX}, n as (select *, ceil((x1 - x0) / 100)::bigint as nx, ceil((y1 - y0) / 100)::bigint as ny, ceil((z1 - z0) / 80)::bigint as nz from e), k as (select *, unnest(range(nx * ny * nz)) as k from n),
 blk as (select (k % nx)::int as ix, (k // nx % ny)::int as iy, (k // (nx * ny))::int as iz, x0 + (k % nx + .5) * 100 as x, y0 + (k // nx % ny + .5) * 100 as y, z0 + (k // (nx * ny) + .5) * 80 as z from k)"""


@query(f"{_GRID} select ix, iy, iz, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} from blk")
def block_grid(spark, sf_dir):
    return rounded(blocks.block_grid(spark, _extent(spark, sf_dir), *_SIZE).select("ix", "iy", "iz", "x", "y", "z"))


def _model(spark, sf_dir):
    b = blocks.block_grid(spark, _extent(spark, sf_dir), *_SIZE)
    return blocks.estimate_grade(b, _samples(spark, sf_dir), max_samples=12, radius=200.0, azimuth=30.0, ax=2.0)


_GRADE = f"""{_GRID}, s as (select pid, x, y, z, v, case when pid % 3 > 0 then 2.0 + pid % 5 end as sg from points), c as (select cos(radians(30)) as c, sin(radians(30)) as s),
 d as (select b.ix, b.iy, b.iz, s.pid, s.v, s.sg, sqrt(((b.x - s.x) * c.c + (b.y - s.y) * c.s) ** 2 / 4 + (-(b.x - s.x) * c.s + (b.y - s.y) * c.c) ** 2 + (b.z - s.z) ** 2) as dn, sqrt((b.x - s.x) ** 2 + (b.y - s.y) ** 2 + (b.z - s.z) ** 2) as dt from blk b, s, c),
 near as (select * from d where dn <= 200 qualify row_number() over (partition by ix, iy, iz order by dn, pid) <= 12),
 est as (select ix, iy, iz, sum(v / dn ** 2) / sum(1 / dn ** 2) as grade, least(greatest(coalesce(sum(sg / dn ** 2) / sum(case when sg is not null then 1 / dn ** 2 end), 2.5), .2), 8) as sg, count(*) as n_used, min(dt) as nearest_m, avg(dt) as mean_m from near group by all having count(*) >= 3),
 ton as (select *, 800000.0 * sg as tonnage_t, 800000.0 * sg * grade as contained, grade >= 5 as above_cutoff, case when n_used >= 12 and nearest_m <= .75 * diag and mean_m <= 2 * diag then 'high' when n_used >= 6 and nearest_m <= 1.5 * diag then 'medium' else 'low' end as confidence from est, (select sqrt(100.0 ** 2 * 2 + 80.0 ** 2) as diag))"""


@query(f"{_GRADE} select ix, iy, iz, {r('grade', 'grade')}, {r('sg', 'sg')}, n_used, {r('nearest_m', 'nearest_m')}, {r('mean_m', 'mean_m')} from est")
def estimate_grade(spark, sf_dir):
    return rounded(_model(spark, sf_dir).select("ix", "iy", "iz", "grade", "sg", "n_used", "nearest_m", "mean_m"))


@query(f"{_GRADE} select ix, iy, iz, {r('tonnage_t / 1e6', 'tonnage_mt')}, {r('contained / 1e6', 'contained_m')}, above_cutoff, confidence from ton")
def block_tonnage(spark, sf_dir):
    b = blocks.block_tonnage(_model(spark, sf_dir), 5.0)
    return rounded(b.select("ix", "iy", "iz", (F.col("tonnage_t") / 1e6).alias("tonnage_mt"), (F.col("contained") / 1e6).alias("contained_m"), "above_cutoff", "confidence"))


@query(f"{_GRADE} select count(*) as blocks, {r('sum(tonnage_t) / 1e9', 'tonnage_gt')}, count(*) filter (above_cutoff) as blocks_above, {r('sum(tonnage_t) filter (above_cutoff) / 1e9', 'above_gt')}, {r('sum(contained) / sum(tonnage_t)', 'grade_mean')}, {r('sum(contained) * 1e-6 * 32150.74656862745 / 1e9', 'metal_goz')} from ton")
def resource_totals(spark, sf_dir):
    t = blocks.resource_totals(blocks.block_tonnage(_model(spark, sf_dir), 5.0), 5.0)
    return rounded(t.select("blocks", (F.col("tonnage_t") / 1e9).alias("tonnage_gt"), "blocks_above", (F.col("tonnage_above_t") / 1e9).alias("above_gt"), "grade_mean", (F.col("metal_oz") / 1e9).alias("metal_goz")))


@query(f"{_GRADE} select {r('avg(n_used)', 'mean_n_used')}, {r('avg(nearest_m)', 'mean_nearest_m')}, {r('avg(mean_m)', 'mean_distance_m')}, count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'medium') as medium, count(*) filter (confidence = 'low') as low from ton")
def support_diagnostics(spark, sf_dir):
    return rounded(blocks.support_diagnostics(blocks.block_tonnage(_model(spark, sf_dir))))


@query(f"{_GRADE}, cut as (select i as k, i * 9.0 / 7 as cutoff from (select unnest(range(8)) as i)) select {r('cutoff', 'cutoff')}, count(grade) as blocks, {r('coalesce(sum(tonnage_t), 0) / 1e9', 'tonnage_gt')}, {r('coalesce(sum(contained), 0) * 1e-6 * 32150.74656862745 / 1e9', 'metal_goz')} from cut left join ton on grade >= cutoff group by cutoff")
def cutoff_sensitivity(spark, sf_dir):
    c = blocks.cutoff_sensitivity(blocks.block_tonnage(_model(spark, sf_dir)), 0.0, 9.0)
    return rounded(c.select("cutoff", "blocks", (F.col("tonnage_t") / 1e9).alias("tonnage_gt"), (F.col("metal_oz") / 1e9).alias("metal_goz")))


_VARIO = f"{with_views('points')}, p as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d, .5 * (a.v - b.v) ** 2 as h from points a join points b on a.pid < b.pid), g as (select least(floor(d / 100), 11)::int as lag, count(*) as pairs, avg(h) as gamma from p where d > 0 and d <= 1200 group by 1), b as (select i as lag, (i + .5) * 100 as lag_mid, coalesce(pairs, 0) as pairs, coalesce(gamma, 0) as gamma from (select unnest(range(12)) as i) left join g on lag = i)"


@query(f"{_VARIO} select {r('lag_mid', 'lag_mid')}, pairs, {r('gamma', 'gamma')} from b")
def variogram(spark, sf_dir):
    return rounded(blocks.variogram(points3d(spark, sf_dir), 12, 1200.0).select("lag_mid", "pairs", "gamma"))


@query(f"{_VARIO}, s as (select avg(gamma) filter (lag >= 8) as sill, max(gamma) filter (lag = 0) as nugget from b) select {r('nugget', 'nugget')}, {r('sill', 'sill')}, {r('(select min(lag_mid) from b, s where gamma >= .95 * sill)', '\"range\"')} from s")
def variogram_readout(spark, sf_dir):
    return rounded(blocks.variogram_readout(blocks.variogram(points3d(spark, sf_dir), 12, 1200.0)))


# A corner sees all other points within less than half a turn: some gap between their directions is wider than pi.
@query(f"""{with_views('points')}, p as (select distinct x, y from points), d as (select a.x, a.y, atan2(b.y - a.y, b.x - a.x) as t from p a join p b on (a.x, a.y) <> (b.x, b.y)),
 gap as (select x, y, coalesce(lead(t) over w, min(t) over (partition by x, y) + 2 * pi()) - t as gap from d window w as (partition by x, y order by t)), corner as (select x, y from gap group by x, y having max(gap) > pi()),
 o as (select min(x) as x0, min_by(y, (x, y)) as y0 from corner)
 select (row_number() over (order by (x, y) <> (x0, y0), atan2(y - y0, x - x0)) - 1)::int as seq, x, y from corner, o""")
def convex_hull(spark, sf_dir):
    return blocks.convex_hull(points3d(spark, sf_dir))


@query(f"{_GRID} select ix, iy, iz from blk where ((-200 > y) <> (200 > y) and x < (0 - 200) * (y - -200) / 400 + 200) <> ((200 > y) <> (-200 > y) and x < (-200 - 0) * (y - 200) / -400 + 0)")
def domain_filter(spark, sf_dir):
    b = blocks.block_grid(spark, _extent(spark, sf_dir), *_SIZE)
    return blocks.domain_filter(b, [(-200.0, -200.0), (200.0, -200.0), (0.0, 200.0)], "input_domain_mask").select("ix", "iy", "iz")


def _octahedron(spark, size: float = 250.0):
    top, ring = (0.0, 0.0, size), [(size, 0.0, 0.0), (0.0, size, 0.0), (-size, 0.0, 0.0), (0.0, -size, 0.0)]
    low = (0.0, 0.0, -size)
    rows = [tuple(a) + tuple(b) + tuple(c) for k in range(4) for c in (top, low) for a, b in [(ring[k], ring[(k + 1) % 4])]]
    return spark.createDataFrame(rows, ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))


_INSIDE = "abs(x) + abs(y) + abs(z) <= 250"


@query(f"{with_views('points')} select pid, {_INSIDE} as inside from points")
def point_in_mesh(spark, sf_dir):
    return blocks.point_in_mesh(points3d(spark, sf_dir), _octahedron(spark), id_col="pid").select("pid", "inside")


@query(f"{_GRID} select ix, iy, iz from blk where {_INSIDE}")
def mesh_filter(spark, sf_dir):
    b = blocks.block_grid(spark, _extent(spark, sf_dir), *_SIZE)
    return blocks.mesh_filter(b, _octahedron(spark)).select("ix", "iy", "iz")


_MODEL = f"""{with_views('points')}, hole as (select *, (row_number() over (partition by pid % 40 order by pid) - 1) // 2 as k from points), comp as (select avg(x) as x, avg(y) as y, avg(z) as z, avg(v) as v from hole group by pid % 40, k),
 cap as (select max(v) as cap from (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from comp) where i <= floor((n - 1) * .995 + .5)), s as (select row_number() over () as sid, x, y, z, least(v, cap) as v from comp, cap),
 e as (select min(x) - .05 * (max(x) - min(x)) - 20 as x0, max(x) + .05 * (max(x) - min(x)) + 20 as x1, min(y) - .05 * (max(y) - min(y)) - 20 as y0, max(y) + .05 * (max(y) - min(y)) + 20 as y1, min(z) - .05 * (max(z) - min(z)) - 20 as z0, max(z) + .05 * (max(z) - min(z)) + 20 as z1 from s),
 n as (select *, ceil((x1 - x0) / 100)::bigint as nx, ceil((y1 - y0) / 100)::bigint as ny, ceil((z1 - z0) / 80)::bigint as nz from e), k as (select *, unnest(range(nx * ny * nz)) as k from n),
 blk as (select k, (k % nx)::int as ix, (k // nx % ny)::int as iy, (k // (nx * ny))::int as iz, x0 + (k % nx + .5) * 100 as x, y0 + (k // nx % ny + .5) * 100 as y, z0 + (k // (nx * ny) + .5) * 80 as z from k),
 near as (select ix, iy, iz, s.v, sqrt((b.x - s.x) ** 2 + (b.y - s.y) ** 2 + (b.z - s.z) ** 2) as d from blk b, s qualify row_number() over (partition by b.k order by d, sid) <= 12),
 ton as (select ix, iy, iz, sum(v / d ** 2) / sum(1 / d ** 2) as grade, 2.7::double as sg, 2.16::double as tonnage_mt, case when count(*) >= 12 and min(d) <= .75 * diag and avg(d) <= 2 * diag then 'high' when count(*) >= 6 and min(d) <= 1.5 * diag then 'medium' else 'low' end as confidence
  from near, (select sqrt(100.0 ** 2 * 2 + 80.0 ** 2) as diag) group by ix, iy, iz, diag having count(*) >= 3)"""


def _grade_model(spark, sf_dir):
    p = points3d(spark, sf_dir)
    s = p.select((F.col("pid") % 40).alias("hole_id"), F.floor(F.col("pid") / 40).cast("double").alias("from_m"), (F.floor(F.col("pid") / 40) + 1).cast("double").alias("to_m"), F.floor(F.col("pid") / 40).cast("double").alias("depth_m"), "x", "y", "z", "v", F.lit(2.7).alias("sg"))
    return blocks.block_grade_model(s, composite=2.0, cap={"mode": "percentile"}, size=_SIZE, cutoff=4.0, max_samples=12)


@query(f"{_MODEL} select ix, iy, iz, {r('grade', 'grade')}, {r('sg', 'sg')}, {r('tonnage_mt', 'tonnage_mt')}, confidence from ton where grade >= 4")
def block_grade_model(spark, sf_dir):
    b = _grade_model(spark, sf_dir)["blocks"]
    return rounded(b.select("ix", "iy", "iz", "grade", "sg", (F.col("tonnage_t") / 1e6).alias("tonnage_mt"), "confidence"))


@query(f"""{_MODEL}, a as (select count(*) as blocks, sum(tonnage_mt) as t, sum(tonnage_mt * grade) as c, count(*) filter (grade >= 4) as blocks_above, coalesce(sum(tonnage_mt) filter (grade >= 4), 0) as ta, coalesce(sum(tonnage_mt * grade) filter (grade >= 4), 0) as ca, min(grade) as lo, max(grade) as hi from ton)
 select blocks, blocks_above, {r('t / 1e3', 'tonnage_gt')}, {r('ta / 1e3', 'above_gt')}, {r('lo', 'grade_min')}, {r('hi', 'grade_max')}, {r('c / t', 'grade_mean')}, {r('ca / ta', 'grade_mean_above')}, {r('c * 32150.74656862745 / 1e9', 'metal_goz')}, {r('ca * 32150.74656862745 / 1e9', 'above_goz')}, {r('blocks_above / blocks', 'share_blocks')}, {r('ta / t', 'share_tonnage')} from a""")
def block_grade_totals(spark, sf_dir):
    giga = lambda c: F.col(c) / 1e9
    t = _grade_model(spark, sf_dir)["totals"].withColumns({"tonnage_gt": giga("tonnage_t"), "above_gt": giga("tonnage_above_t"), "metal_goz": giga("metal_oz"), "above_goz": giga("metal_above_oz")})
    return rounded(t.select("blocks", "blocks_above", "tonnage_gt", "above_gt", "grade_min", "grade_max", "grade_mean", "grade_mean_above", "metal_goz", "above_goz", "share_blocks", "share_tonnage"))


def _field(spark, sf_dir):
    """The part grid as a magnetic field, smoothed."""
    g, spec = part_grid(spark, sf_dir)
    v = grids.relax_grid(g)
    return g.drop("v").join(v, ["ix", "iy"]), spec


@query(f"""{with_views('grid')}, m as (select max(ix) as mx, max(iy) as my from grid), s as (select g.ix, g.iy, g.v, w.v as w, e.v as e, s.v as s, n.v as n, mx, my from grid g cross join m left join grid w on w.ix = g.ix - 1 and w.iy = g.iy left join grid e on e.ix = g.ix + 1 and e.iy = g.iy left join grid s on s.ix = g.ix and s.iy = g.iy - 1 left join grid n on n.ix = g.ix and n.iy = g.iy + 1)
 select ix, iy, {r('case when ix = 0 then (e - v) / 10 when ix = mx then (v - w) / 10 else (e - w) / 20 end', 'dmdx')}, {r('case when iy = 0 then (n - v) / 10 when iy = my then (v - s) / 10 else (n - s) / 20 end', 'dmdy')}, {r('((e - 2 * v + w) / 100 + (n - 2 * v + s) / 100) * 30', 'dmdz')} from s""")
def euler_derivatives(spark, sf_dir):
    g, _ = part_grid(spark, sf_dir)
    return rounded(magnetics.euler_derivatives(g, 10.0).select("ix", "iy", "dmdx", "dmdy", "dmdz"))


def _windows(spark, sf_dir):
    g, spec = _field(spark, sf_dir)
    return magnetics.euler_windows(magnetics.euler_derivatives(g, 10.0)), spec


_EULER = f"""{with_views('grid')}, {relaxed(8)}, mm as (select max(ix) as mx, max(iy) as my from grid), s as (select g.ix, g.iy, g.v, w.v as w, e.v as e, s.v as s, n.v as n, mx, my from r8 g cross join mm left join r8 w on w.ix = g.ix - 1 and w.iy = g.iy left join r8 e on e.ix = g.ix + 1 and e.iy = g.iy left join r8 s on s.ix = g.ix and s.iy = g.iy - 1 left join r8 n on n.ix = g.ix and n.iy = g.iy + 1),
 d as (select ix, iy, v, mx, my, case when ix = 0 then (e - v) / 10 when ix = mx then (v - w) / 10 else (e - w) / 20 end as dx, case when iy = 0 then (n - v) / 10 when iy = my then (v - s) / 10 else (n - s) / 20 end as dy, ((e - 2 * v + w) / 100 + (n - 2 * v + s) / 100) * 30 as dz from s),
 cell as (select * from d where greatest(abs(dx), abs(dy), abs(dz)) >= 1e-9 and dz is not null), ax as (select (2 * i + 3)::int as c from mm, (select unnest(range(greatest(mx, my))) as i from mm)),
 win as (select cx.c as cx, cy.c as cy, count(*) over (partition by cx.c, cy.c) as cells, dx, dy, -dz as h, (ix - cx.c) * 10 * dx + (iy - cy.c) * 10 * dy as rr, v from cell join ax cx on abs(cx.c - ix) <= 3 and cx.c <= mx - 3 join ax cy on abs(cy.c - iy) <= 3 and cy.c <= my - 3 qualify cells >= 8)"""


@query(f"{_EULER} select cx, cy, count(*) as cells from win group by cx, cy")
def euler_windows(spark, sf_dir):
    w, _ = _windows(spark, sf_dir)
    return w.groupBy("cx", "cy").agg(F.count("*").alias("cells"))


def _elimination() -> str:
    """CTEs that solve the symmetric 4 x 4 system of CTE e3's columns a00 .. a33, b0 .. b3 (with the ridge g): e2, e1, e0 lose one unknown each, then back."""
    steps, a, b = [], {(i, j): f"a{i}{j} + g" if i == j < 3 else f"a{i}{j}" for i in range(4) for j in range(i, 4)}, [f"b{i}" for i in range(4)]
    steps.append("e0 as (select *, " + ", ".join([f"{x} as m{i}{j}_0" for (i, j), x in a.items()] + [f"{x} as q{i}_0" for i, x in enumerate(b)]) + " from sys)")
    for k in range(3):
        new = [f"m{i}{j}_{k} - m{k}{i}_{k} / m{k}{k}_{k} * m{k}{j}_{k} as m{i}{j}_{k + 1}" for i in range(k + 1, 4) for j in range(i, 4)] + [f"q{i}_{k} - m{k}{i}_{k} / m{k}{k}_{k} * q{k}_{k} as q{i}_{k + 1}" for i in range(k + 1, 4)]
        steps.append(f"e{k + 1} as (select *, {', '.join(new)} from e{k})")
    steps += ["f3 as (select *, q3_3 / m33_3 as u3 from e3)", "f2 as (select *, (q2_2 - m23_2 * u3) / m22_2 as u2 from f3)", "f1 as (select *, (q1_1 - m12_1 * u2 - m13_1 * u3) / m11_1 as u1 from f2)", "f0 as (select *, (q0_0 - m01_0 * u1 - m02_0 * u2 - m03_0 * u3) / m00_0 as u0 from f1)"]
    return ", ".join(steps)


_QUAD = " + ".join(f"{1 if i == j else 2} * u{i} * a{i}{j} * u{j}" for i in range(4) for j in range(i, 4))
_SOLVE = f"""{_EULER}, su as (select cx, cy, count(*) as k, avg(abs(v)) as mean_abs, {', '.join(f'sum({a} * {b}) as s{i}{j}' for i, a in enumerate(('dx', 'dy', 'h', '1', 'rr', 'v')) for j, b in enumerate(('dx', 'dy', 'h', '1', 'rr', 'v')) if i <= j)} from win group by cx, cy),
 sys0 as (select *, {', '.join(f's{i}{j} as a{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f's{i}3 * n as a{i}3' for i in range(3))}, s33 * n * n as a33, {', '.join(f's{i}4 + n * s{i}5 as b{i}' for i in range(3))}, n * (s34 + n * s35) as b3, s44 + 2 * n * s45 + n * n * s55 as rhs2 from su, (select unnest([1.0, 2.0, 3.0])::double as n)),
 sys as (select *, 1e-6 * greatest(a00, a11, a22) as g from sys0), {_elimination()}, res as (select *, sqrt(greatest({_QUAD} - 2 * (u0 * b0 + u1 * b1 + u2 * b2 + u3 * b3) + rhs2, 0) / k) / mean_abs as residual from f0 where mean_abs > 1e-9),
 sol as materialized (select cx, cy, cx * 10 + u0 as x, cy * 10 + u1 as y, u2 as depth_m, n, u3 as background, residual, mean_abs from res where u2 between 10 and 1500 and abs(u0) <= 150 and abs(u1) <= 150 qualify row_number() over (partition by cx, cy order by residual, n) = 1)"""


@query(f"{_SOLVE} select cx, cy, {r('x', 'x', 2)}, {r('y', 'y', 2)}, {r('depth_m', 'depth_m', 2)}, n, {r('background', 'background', 2)}, {r('residual', 'residual')}, {r('mean_abs', 'mean_abs')} from sol")
def euler_solve(spark, sf_dir):
    w, spec = _windows(spark, sf_dir)
    s = rounded(magnetics.euler_solve(w, spec, 10.0), 2, only=["x", "y", "depth_m", "background"])
    return rounded(s, only=["residual", "mean_abs"])


@query(f"""{_SOLVE}, k as (select *, 1 / (1 + 2 * residual) as confidence, mean_abs * depth_m ** (n + 1) as raw from sol where 1 / (1 + 2 * residual) >= .05), o as (select raw, row_number() over (order by raw) - 1 as i, count(*) over () as c from k), top as (select greatest(max(raw), 1e-9) as scale from o where i <= least(floor(.95 * c), c - 1))
 select {r('x', 'x', 2)}, {r('y', 'y', 2)}, {r('-depth_m', 'z', 2)}, {r('depth_m', 'depth_m', 2)}, n, {r('least(greatest(depth_m * .15, 10), depth_m * .5)', 'size', 2)}, {r('least(greatest(raw / scale, 0), 1)', 'proxy', 3)}, {r('confidence', 'confidence', 3)}, {r('mean_abs', 'anomaly', 3)}, {r('background', 'background', 2)}, {r('residual', 'residual', 3)} from k, top""")
def euler_sources(spark, sf_dir):
    w, spec = _windows(spark, sf_dir)
    s = rounded(magnetics.euler_sources(magnetics.euler_solve(w, spec, 10.0), 10.0), 2, only=["x", "y", "z", "depth_m", "size", "background"])
    return rounded(s, 3, only=["proxy", "confidence", "anomaly", "residual"])


@query()
def tile_pyramid(spark, sf_dir):
    g, spec = part_grid(spark, sf_dir)
    return tiles.tile_pyramid(g, spec, tile_size=64, max_zoom=2)


