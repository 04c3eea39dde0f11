"""Grids in long form (ix, iy, x, y, v), and terrain.

A spec is a dict of nx, ny, xmin, xmax, ymin, ymax. Neighbouring cells come
from ``lag`` and ``lead`` in rows and in columns of the grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .neighbours import interpolate, knn, nearest_distance
from .selection import kth_values
from .shared import materialise
from .stats import extent_2d


def by_row():
    return Window.partitionBy("iy").orderBy("ix")


def by_column():
    return Window.partitionBy("ix").orderBy("iy")


def grid_spec(extent: DataFrame, resolution: float = 0.0, nx: int = 0, ny: int = 0, max_cells: int = 65536) -> dict:
    """Size of a grid over a one-row extent: by resolution (8 to 512 a side, shrunk by tenths to ``max_cells``) or as given (2 to 1024)."""
    e = extent.first()
    w, h = e["xmax"] - e["xmin"], e["ymax"] - e["ymin"]
    if nx and ny:
        nx, ny = min(max(nx, 2), 1024), min(max(ny, 2), 1024)
    else:
        nx, ny = (min(max(math.ceil(s / resolution) + 1, 8), 512) for s in (w, h))
        while nx * ny > max_cells:
            nx, ny = max(8, int(nx * 0.9)), max(8, int(ny * 0.9))
    return {"nx": nx, "ny": ny, "xmin": e["xmin"], "xmax": e["xmax"], "ymin": e["ymin"], "ymax": e["ymax"]}


def make_grid(spark: SparkSession, spec: dict, at: str = "node", resolution: float = 0.0) -> DataFrame:
    """ix, iy, x, y of every cell: at nodes, at cell centres, or in fixed steps of ``resolution``."""
    nx, ny = spec["nx"], spec["ny"]
    g = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))

    def place(i: str, n: int, lo: float, hi: float) -> Column:
        if at == "centre":
            return lo + (F.col(i) + 0.5) / n * (hi - lo)
        return lo + (F.col(i) * resolution if at == "step" else F.col(i) / (n - 1) * (hi - lo))

    return g.select("ix", "iy", place("ix", nx, spec["xmin"], spec["xmax"]).alias("x"), place("iy", ny, spec["ymin"], spec["ymax"]).alias("y"))


def idw_surface(points: DataFrame, resolution: float = 25.0, max_cells: int = 65536, pad: float = 0.25) -> tuple[DataFrame, dict]:
    """(grid, spec): 1 / d^2 over all ``points(x, y, z)``; a cell on a point has its value.

    Every task adds up its own points over the grid, whose size is bounded;
    the partial sums of a cell meet in an aggregate. No table is broadcast.
    """
    if points.limit(3).count() < 3:
        raise ValueError("an IDW surface needs at least three points")
    spec = grid_spec(extent_2d(points, pad), resolution, max_cells=max_cells)
    nx, ny = spec["nx"], spec["ny"]
    gx, gy = np.linspace(spec["xmin"], spec["xmax"], nx), np.linspace(spec["ymin"], spec["ymax"], ny)

    def partial(batches):
        x, y = np.tile(gx, ny), np.repeat(gy, nx)
        num, den, snap = np.zeros(nx * ny), np.zeros(nx * ny), np.full(nx * ny, np.nan)
        for p in batches:
            px, py, pz = (p[c].to_numpy(float) for c in "xyz")
            step = max(1, 2_000_000 // (nx * ny))
            for a in range(0, len(p), step):
                d2 = (x[:, None] - px[None, a : a + step]) ** 2 + (y[:, None] - py[None, a : a + step]) ** 2
                on = d2 <= 1e-12
                if on.any():
                    i, j = np.nonzero(on)
                    np.fmax.at(snap, i, pz[a + j])
                w = 1 / np.where(on, np.inf, d2)
                num += w @ pz[a : a + step]
                den += w.sum(1)
        if den.any() or np.isfinite(snap).any():
            yield pd.DataFrame({"c": np.arange(nx * ny), "num": num, "den": den, "snap": [None if np.isnan(s) else s for s in snap]})

    sums = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).dropna().mapInPandas(partial, "c long, num double, den double, snap double")
    v = sums.groupBy("c").agg(F.max("snap").alias("snap"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    v = v.select((F.col("c") % nx).cast("int").alias("ix"), F.floor(F.col("c") / nx).cast("int").alias("iy"), F.coalesce("snap", F.when(F.col("den") > 0, F.col("num") / F.col("den"))).alias("v"))
    return make_grid(points.sparkSession, spec).join(v, ["ix", "iy"], "left").select("ix", "iy", "x", "y", "v"), spec


def interpolate_grid(cells: DataFrame, points: DataFrame, method: str = "idw", power: float = 2.0, radius: float = 0.0, min_points: int = 3, max_points: int = 32, hit_d: float = 1e-6, squares: bool = False) -> DataFrame:
    """``cells(ix, iy, x, y)`` with v from the nearest of ``points(pid, x, y, v)``, ties as in ``knn``."""
    left = cells.withColumn("id", F.col("iy").cast("long") * 1_000_000 + F.col("ix"))
    got = interpolate(knn(left, points, max_points, radius, squares=squares), method, power, min_points, hit_d)
    return left.join(got, "id", "left").select("ix", "iy", "x", "y", "v")


def corners(grid: DataFrame, spec: dict, clamp_edges: bool = True) -> DataFrame:
    """Each cell with the values to its right (v10), above (v01) and across (v11); at the last row and column its own, if ``clamp_edges``."""
    g = grid.select("ix", "iy", "v")
    right = F.when((F.col("ix") == spec["nx"] - 1) & F.lit(clamp_edges), F.col("v")).when(F.lead("ix").over(by_row()) == F.col("ix") + 1, F.lead("v").over(by_row()))
    g = g.withColumn("v10", right)
    next_ = F.lead("iy").over(by_column()) == F.col("iy") + 1
    top = (F.col("iy") == spec["ny"] - 1) & F.lit(clamp_edges)
    return g.select("ix", "iy", F.col("v").alias("v00"), "v10", F.when(top, F.col("v")).when(next_, F.lead("v").over(by_column())).alias("v01"), F.when(top, F.col("v10")).when(next_, F.lead("v10").over(by_column())).alias("v11"))


def bilinear_sample(df: DataFrame, grid: DataFrame, spec: dict, outside: str = "null", name: str = "v") -> DataFrame:
    """``df(x, y)`` with the grid's bilinear value at each row; null where a corner is, and outside (or, clamped, the edge's value)."""
    nx, ny = spec["nx"], spec["ny"]
    t = lambda c, n: F.greatest(F.least((F.col(c) - spec[f"{c}min"]) / max(spec[f"{c}max"] - spec[f"{c}min"], 1e-9), F.lit(1.0)), F.lit(0.0)) * (n - 1)
    d = df.withColumn("_tx", t("x", nx)).withColumn("_ty", t("y", ny))
    inside = F.col("x").between(spec["xmin"], spec["xmax"]) & F.col("y").between(spec["ymin"], spec["ymax"])
    d = d.withColumn("_ix", F.when(inside | F.lit(outside != "null"), F.floor("_tx")).cast("int")).withColumn("_iy", F.floor("_ty").cast("int"))
    c = corners(grid, spec).withColumnRenamed("ix", "_ix").withColumnRenamed("iy", "_iy")
    fx, fy = F.col("_tx") - F.col("_ix"), F.col("_ty") - F.col("_iy")
    v = (F.col("v00") * (1 - fx) + F.col("v10") * fx) * (1 - fy) + (F.col("v01") * (1 - fx) + F.col("v11") * fx) * fy
    return d.join(c, ["_ix", "_iy"], "left").withColumn("_out", v).select(*df.columns, F.col("_out").alias(name))


def terrain_control_match(controls: DataFrame, grid: DataFrame, spec: dict) -> DataFrame:
    """x, y, z_obs, z_grid of ``controls(x, y, z)`` that the grid covers."""
    return bilinear_sample(controls.select("x", "y", F.col("z").alias("z_obs")), grid, spec, name="z_grid").where("z_grid is not null")


def plane_fit(matched: DataFrame, mode: str = "vertical_bias") -> DataFrame:
    """dz, tilt_x, tilt_y, cx, cy, rmse_before, rmse_after of a correction to ``matched(x, y, z_obs, z_grid)``: a shift, or a plane (affine_xy_z)."""
    c = matched.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    m = matched.crossJoin(F.broadcast(c)).select((F.col("x") - F.col("cx")).alias("u"), (F.col("y") - F.col("cy")).alias("w"), (F.col("z_obs") - F.col("z_grid")).alias("r"), "cx", "cy")
    s = m.agg(*(F.sum(e).alias(k) for k, e in {"sr": F.col("r"), "sx": F.col("u"), "sy": F.col("w"), "sxx": F.col("u") ** 2, "syy": F.col("w") ** 2, "sxy": F.col("u") * F.col("w"), "sxr": F.col("u") * F.col("r"), "syr": F.col("w") * F.col("r")}.items()), F.count("*").alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.sqrt(F.avg(F.col("r") ** 2)).alias("rmse_before"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    solid = (F.abs(det) > 1e-9) & F.lit(mode != "vertical_bias")
    s = s.withColumn("tilt_x", F.when(solid, (F.col("sxr") * F.col("syy") - F.col("syr") * F.col("sxy")) / det).otherwise(F.lit(0.0)))
    s = s.withColumn("tilt_y", F.when(solid, (F.col("syr") * F.col("sxx") - F.col("sxr") * F.col("sxy")) / det).otherwise(F.lit(0.0)))
    s = s.withColumn("dz", (F.col("sr") - F.col("tilt_x") * F.col("sx") - F.col("tilt_y") * F.col("sy")) / F.col("n"))
    fit = s.select("dz", "tilt_x", "tilt_y", "cx", "cy", "rmse_before")
    left = m.select("u", "w", "r").crossJoin(F.broadcast(fit)).agg(F.sqrt(F.avg((F.col("r") - F.col("dz") - F.col("tilt_x") * F.col("u") - F.col("tilt_y") * F.col("w")) ** 2)).alias("rmse_after"))
    return fit.crossJoin(left)


def terrain_adjust(grid: DataFrame, spec: dict, controls: DataFrame, mode: str = "vertical_bias", dx: float = 0.0, dy: float = 0.0, at: str = "centre") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, residuals, qc): the fitted correction added at cell centres (or nodes), the extent moved by dx, dy."""
    matched = terrain_control_match(controls, grid, spec)
    if matched.limit(3).count() < 3:
        raise ValueError("fewer than three controls lie on the grid")
    fit = materialise(plane_fit(matched, mode), "fit")
    place = make_grid(grid.sparkSession, spec, at).select("ix", "iy", F.col("x").alias("_x"), F.col("y").alias("_y"))
    corr = F.col("dz") + F.col("tilt_x") * (F.col("_x") - F.col("cx")) + F.col("tilt_y") * (F.col("_y") - F.col("cy"))
    out = grid.join(place, ["ix", "iy"]).crossJoin(F.broadcast(fit)).select("ix", "iy", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("v") + corr).alias("v"))
    here = F.col("dz") + F.col("tilt_x") * (F.col("x") - F.col("cx")) + F.col("tilt_y") * (F.col("y") - F.col("cy"))
    residuals = matched.crossJoin(F.broadcast(fit)).select("x", "y", (F.col("z_obs") - F.col("z_grid")).alias("before"), (F.col("z_obs") - F.col("z_grid") - here).alias("after"))
    return out, residuals, fit


def terrain_from_raster(raster: DataFrame, raster_spec: dict, points: DataFrame, resolution: float = 50.0, max_cells: int = 32768, fit: str = "vertical_bias", min_points: int = 3) -> tuple[DataFrame, dict]:
    """(grid, spec) over the raster's extent, sampled from it.

    Under a quarter of the nodes known: an IDW surface of the points instead.
    Else unknown nodes are filled by IDW of known ones, the nearest by squared
    distance (on a grid many are as far, up to the last bits). With at least
    ``min_points`` points on it the grid is then fitted to them.
    """
    spark = raster.sparkSession
    box = spark.createDataFrame([tuple(float(raster_spec[k]) for k in ("xmin", "xmax", "ymin", "ymax"))], "xmin double, xmax double, ymin double, ymax double")
    spec = grid_spec(box, resolution, max_cells=max_cells)
    g = materialise(bilinear_sample(make_grid(spark, spec), raster, raster_spec), "terrain")
    known, total = g.agg(F.count("v"), F.count("*")).first()
    if known * 4 < total:
        return idw_surface(points, resolution, max_cells)
    if known < total:
        pid = F.col("iy").cast("long") * 1_000_000 + F.col("ix")
        filled = interpolate_grid(g.where("v is null").select("ix", "iy", "x", "y"), g.where("v is not null").select(pid.alias("pid"), "x", "y", "v"), min_points=1, max_points=12, squares=True)
        g = g.where("v is not null").unionByName(filled)
    if fit != "none" and terrain_control_match(points, g, spec).limit(min_points).count() >= min_points:
        g, _, _ = terrain_adjust(g, spec, points, fit, at="node")
    return g, spec


def terrain_confidence(grid: DataFrame, controls: DataFrame, spec: dict, low_density_cells: float = 8.0, anchor_cells: float = 0.75, filled: str | None = None, fitted: bool = True, fallback: bool = False) -> DataFrame:
    """ix, iy, class, score, low_density: how far each node of ``grid(ix, iy, x, y, v)`` can be trusted.

    0 missing or low density, 1 filled, 2 raw, 3 fitted, 4 anchor, 5 fallback.
    A node within ``anchor_cells`` of a control is an anchor, in a fallback
    surface too; one beyond ``low_density_cells`` of every control is of class 0
    unless the surface is a fallback. A cell is the extent over the number of
    nodes. Without controls the class is that of the node's source.
    """
    cell = max(abs(spec["xmax"] - spec["xmin"]) / max(spec["nx"], 1), abs(spec["ymax"] - spec["ymin"]) / max(spec["ny"], 1), 1e-9)
    left = grid.withColumn("id", F.col("iy").cast("long") * 1_000_000 + F.col("ix"))
    d = nearest_distance(left, controls.select(F.monotonically_increasing_id().alias("pid"), "x", "y", F.lit(0.0).alias("v")))
    was = F.coalesce(F.col(filled), F.lit(False)) if filled else F.lit(False)
    own = F.lit(5) if fallback else F.when(was, 1).otherwise(3 if fitted else 2)
    far = F.coalesce(F.col("d") > low_density_cells * cell, F.lit(False))
    kind = F.when(F.col("v").isNull(), 0).when(F.col("d") <= anchor_cells * cell, 4).when(far & F.lit(not fallback), 0).otherwise(own)
    #: Score by class.
    scores = F.array(*(F.lit(s) for s in (0.12, 0.38, 0.62, 0.82, 1.0, 0.8)))
    return left.join(d, "id", "left").select("ix", "iy", kind.alias("class"), F.element_at(scores, kind + 1).alias("score"), far.alias("low_density"))


def _beside(c: str, by, axis: str, step: int) -> Column:
    f = F.lead if step > 0 else F.lag
    return F.when(f(axis).over(by) == F.col(axis) + step, f(c).over(by))


def stencil(grid: DataFrame, c: str = "v") -> DataFrame:
    """``grid`` with _w, _e, _s, _n, the values beside each cell (null where there is no cell)."""
    return grid.withColumn("_w", _beside(c, by_row(), "ix", -1)).withColumn("_e", _beside(c, by_row(), "ix", 1)).withColumn("_s", _beside(c, by_column(), "iy", -1)).withColumn("_n", _beside(c, by_column(), "iy", 1))


def grid_gradient(grid: DataFrame, mode: str = "magnitude") -> DataFrame:
    """ix, iy, g: central differences in cells, interior only; the magnitude or the direction."""
    g = stencil(grid)
    gx, gy = (F.col("_e") - F.col("_w")) / 2, (F.col("_n") - F.col("_s")) / 2
    v = F.hypot(gx, gy) if mode == "magnitude" else F.atan2(gy, gx)
    return g.select("ix", "iy", F.when(F.col("v").isNotNull(), v).alias("g"))


def magnetic_derivatives(grid: DataFrame, h: float) -> DataFrame:
    """ix, iy, fvd, grad_mag, tilt in the interior of ``grid(ix, iy, v)`` with cells of h metres."""
    g = stencil(grid)
    gx, gy = (F.col("_e") - F.col("_w")) / (2 * h), (F.col("_n") - F.col("_s")) / (2 * h)
    fvd = -((F.col("_e") - 2 * F.col("v") + F.col("_w")) / h**2 + (F.col("_n") - 2 * F.col("v") + F.col("_s")) / h**2)
    g = g.withColumn("fvd", fvd).withColumn("grad_mag", F.when(F.col("fvd").isNotNull(), F.hypot(gx, gy)))
    return g.select("ix", "iy", "fvd", "grad_mag", F.atan2("fvd", F.greatest("grad_mag", F.lit(1e-9))).alias("tilt"))


def relax_grid(grid: DataFrame, passes: int = 8, tile: int = 64) -> DataFrame:
    """v after Jacobi passes of 0.5 c + 0.125 (n + s + w + e) where all five exist.

    Tiles with a rim of ``passes`` cells are relaxed on their own; the rim is
    dropped. One shuffle, whatever the number of passes.
    """
    t = lambda c: [(F.col(c) + o).cast("int") for o in (-passes, 0, passes)]
    near = lambda c: F.array_distinct(F.transform(F.array(*t(c)), lambda i: F.floor(i / tile).cast("int")))
    own = grid.select("ix", "iy", F.col("v").cast("double").alias("v"), near("ix").alias("tx"), near("iy").alias("ty")).withColumn("tx", F.explode("tx")).withColumn("ty", F.explode("ty"))

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = key[0] * tile - passes, key[1] * tile - passes
        side = tile + 2 * passes
        a = np.full((side + 2, side + 2), np.nan)
        i, j = p["ix"].to_numpy() - x0 + 1, p["iy"].to_numpy() - y0 + 1
        a[j, i] = p["v"].to_numpy(float)
        for _ in range(passes):
            b = a.copy()
            inner = 0.5 * a[1:-1, 1:-1] + 0.125 * (a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:])
            b[1:-1, 1:-1] = np.where(np.isnan(inner), a[1:-1, 1:-1], inner)
            a = b
        mine = (p["ix"] // tile == key[0]) & (p["iy"] // tile == key[1])
        v = a[j[mine], i[mine]]
        return pd.DataFrame({"ix": p["ix"][mine], "iy": p["iy"][mine], "v": [None if np.isnan(q) else q for q in v]})

    return own.groupBy("tx", "ty").applyInPandas(run, "ix int, iy int, v double")


def raster_interpolate(points: DataFrame, nx: int, ny: int, method: str = "idw", power: float = 2.0, k: int = 32, lo: float = 2.0, hi: float = 98.0) -> DataFrame:
    """ix, iy, v at the centres of a raster over the extent of ``points(pid, x, y, v)``.

    Neighbours are found in coordinates scaled to the unit square and samples
    count as they are; the result is clipped to the samples' percentiles lo, hi.
    """
    e = points.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax")).first()
    a, b = kth_values(points, "v", [lo / 100, hi / 100])
    if a is None:
        return make_grid(points.sparkSession, {"nx": nx, "ny": ny, "xmin": 0.0, "xmax": 1.0, "ymin": 0.0, "ymax": 1.0}).select("ix", "iy", F.lit(None).cast("double").alias("v"))
    span = {c: e[f"{c}max"] - e[f"{c}min"] for c in "xy"}
    unit = {"nx": nx, "ny": ny} | {f"{c}min": 0.0 for c in "xy"} | {f"{c}max": max(span[c], 1e-9) / max(span[c], 1e-12) for c in "xy"}
    p = points.select("pid", *(((F.col(c) - e[f"{c}min"]) / max(span[c], 1e-12)).alias(c) for c in "xy"), F.col("v").cast("double").alias("v"))
    g = interpolate_grid(make_grid(points.sparkSession, unit, "centre"), p, method, power, min_points=1, max_points=k, hit_d=1e-12)
    return g.select("ix", "iy", F.when(F.col("v").isNotNull(), F.greatest(F.least("v", F.lit(max(b, a + 1e-9))), F.lit(a))).alias("v"))


def point_in_polygon(df: DataFrame, ring: list[tuple[float, float]], buffer: float = 0.0) -> DataFrame:
    """``df(x, y)`` with inside (even-odd rule, or within ``buffer`` of an edge) and edge_distance."""
    x, y, inside, near = F.col("x"), F.col("y"), F.lit(False), []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        ax, ay, bx, by = map(float, (ax, ay, bx, by))
        if (ax, ay) == (bx, by):
            continue
        crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay if by != ay else 1e-300) + ax)
        inside = inside != crosses
        t = F.greatest(F.least(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), F.lit(1.0)), F.lit(0.0))
        near.append(F.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay))))
    edge = F.least(*near)
    return df.withColumn("edge_distance", edge).withColumn("inside", (inside | (F.lit(buffer > 0) & (edge <= buffer))))


def topography_clip(blocks: DataFrame, grid: DataFrame, spec: dict) -> DataFrame:
    """Blocks whose top lies at or under the terrain above their centre."""
    return bilinear_sample(blocks, grid, spec, name="_top").where(F.col("_top").isNotNull() & (F.col("z") + F.col("dz") / 2 <= F.col("_top"))).drop("_top")
