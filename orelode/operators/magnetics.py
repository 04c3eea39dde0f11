"""Airborne magnetics: cleaned lines, grids, Euler depth solutions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grids import bilinear_sample, interpolate_grid, magnetic_derivatives, make_grid, relax_grid, stencil
from .ingest import igrf_subtract, magnetic_row_filter
from .lines import clean_lines, decimate, magnetic_report, resample_by_distance, smooth_by_distance
from .scans import PLACE, in_runs
from .selection import kth_values
from .shared import materialise
from .stats import extent_2d


def magnetic_model(rows: DataFrame, resolution: float = 25.0, max_cells: int = 250_000, power: float = 2.0, k: int = 32, sigma: float = 6.0, smooth: float = 0.0, spacing: float = 0.0, pct: float = 100.0, relax: bool = False) -> dict[str, DataFrame]:
    """points, grid (ix, iy, x, y, v, fvd, grad_mag, tilt), report and spec from ``rows(line, fid, ts, x, y, tmf | mag_lev, igrf, radar, gps_alt)``."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    p = magnetic_row_filter(rows).select(
        F.coalesce(has("line").cast("string"), F.lit("LINE_000")).alias("line"), "fid", has("ts").alias("ts"), "x", "y",
        F.coalesce(has("radar"), has("gps_alt"), F.lit(0.0)).cast("double").alias("z"), F.coalesce(has("tmf"), has("mag_lev")).cast("double").alias("m"), has("igrf").cast("double").alias("igrf"),
    )
    # Written first, as the median and the sample for the sort read all rows too; then one sort and one pass for the line's steps.
    p = smooth_by_distance(clean_lines(igrf_subtract(materialise(p, "line-rows")), sigma), smooth)
    if spacing > 0:
        p = in_runs(resample_by_distance(materialise(p, "smooth"), spacing).drop(*PLACE), ["line"], ["along_m", "fid"])
    p = materialise(decimate(p, pct).withColumn("pid", F.col("_at")).drop(*PLACE), "magnetic-points")
    e = extent_2d(p, pad=0.0).first()
    w, h, res = e["xmax"] - e["xmin"], e["ymax"] - e["ymin"], resolution
    while (math.floor(w / res) + 1) * (math.floor(h / res) + 1) > max_cells:
        res *= max(1.01, math.sqrt((math.floor(w / res) + 1) * (math.floor(h / res) + 1) / max_cells))
    nx, ny = max(2, math.floor(w / res) + 1), max(2, math.floor(h / res) + 1)
    spec = {"nx": nx, "ny": ny, "xmin": e["xmin"], "xmax": e["xmin"] + (nx - 1) * res, "ymin": e["ymin"], "ymax": e["ymin"] + (ny - 1) * res}
    cells = make_grid(rows.sparkSession, spec, "step", res)
    g = interpolate_grid(cells, p.select("pid", "x", "y", F.col("m").alias("v")), "idw", power, min_points=1, max_points=k)
    g = materialise(g, "magnetic-grid")
    if relax:
        g = materialise(g.drop("v").join(relax_grid(g), ["ix", "iy"]), "magnetic-grid")
    # From the written grid, whose size is known, so that a small one doesn't have all points shuffled.
    points = bilinear_sample(p, g, spec, outside="clamp", name="m_grid")
    g = g.join(magnetic_derivatives(g, res), ["ix", "iy"])
    box = rows.sparkSession.createDataFrame([(nx, ny, spec["xmin"], spec["xmax"], spec["ymin"], spec["ymax"], res)], "nx int, ny int, xmin double, xmax double, ymin double, ymax double, resolution double")
    return {"points": points, "grid": g, "report": magnetic_report(rows, p), "spec": box}


def euler_derivatives(grid: DataFrame, h: float, flight_height: float = 60.0) -> DataFrame:
    """``grid(ix, iy, x, y, v, fvd)`` with dmdx, dmdy, dmdz: central differences, one-sided at the edges."""
    g = stencil(grid)
    first = {c: F.min(c).over(Window.partitionBy(o)) for c, o in (("ix", "iy"), ("iy", "ix"))}
    last = {c: F.max(c).over(Window.partitionBy(o)) for c, o in (("ix", "iy"), ("iy", "ix"))}
    v = F.col("v")

    def slope(before: str, after: str, c: str):
        return F.when(F.col(c) == first[c], (F.col(after) - v) / h).when(F.col(c) == last[c], (v - F.col(before)) / h).otherwise((F.col(after) - F.col(before)) / (2 * h))

    laplace = -((F.col("_e") - 2 * v + F.col("_w")) / h**2 + (F.col("_n") - 2 * v + F.col("_s")) / h**2)
    fvd = F.coalesce(F.col("fvd"), laplace) if "fvd" in grid.columns else laplace
    return g.select("ix", "iy", "x", "y", "v", slope("_w", "_e", "ix").alias("dmdx"), slope("_s", "_n", "iy").alias("dmdy"), (-fvd * flight_height * 0.5).alias("dmdz"))


def euler_windows(cells: DataFrame, window: int = 7, step: int = 2, least: float = 1e-9) -> DataFrame:
    """cx, cy and a cell's values for each window that covers it; windows lie wholly in the grid, every ``step`` cells; of 8 cells at least."""
    half = window // 2
    e = cells.agg(F.max("ix"), F.max("iy")).first()
    good = cells.where(F.expr("v is not null and dmdx is not null and dmdy is not null and dmdz is not null") & (F.greatest(F.abs("dmdx"), F.abs("dmdy"), F.abs("dmdz")) >= least))

    def centres(c: str, most: int):
        lo, hi = F.greatest(F.col(c) - half, F.lit(half)), F.least(F.col(c) + half, F.lit(most - half))
        k0, k1 = F.ceil((lo - half) / step), F.floor((hi - half) / step)
        return F.when(k1 >= k0, F.transform(F.sequence(k0, k1), lambda k: (k * step + half).cast("int"))).otherwise(F.array().cast("array<int>"))

    m = good.withColumn("cx", F.explode(centres("ix", e[0]))).withColumn("cy", F.explode(centres("iy", e[1])))
    return m.withColumn("_n", F.count("*").over(Window.partitionBy("cx", "cy"))).where("_n >= 8").drop("_n")


_TERMS = ("dmdx", "dmdy", "_h", "_1", "_r", "_rm")


def euler_solve(members: DataFrame, spec: dict, h: float, n: float | None = None, min_depth: float = 10.0, max_depth: float = 1500.0, offset: float = 2.5, window: int = 7) -> DataFrame:
    """cx, cy, x, y, depth_m, n, background, residual: the best structural index of each window.

    The normal equations need sums of products only, so they are one aggregate;
    coordinates are taken from the window's centre to keep them well
    conditioned. Small systems are then solved in batches. The index 0 makes
    the background's column zero and can't be solved.
    """
    px, py = spec["xmin"] + F.col("cx") * h, spec["ymin"] + F.col("cy") * h
    t = members.withColumn("_h", -F.col("dmdz")).withColumn("_r", (F.col("x") - px) * F.col("dmdx") + (F.col("y") - py) * F.col("dmdy")).withColumn("_1", F.lit(1.0)).withColumn("_rm", F.col("v"))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}{j}") for i, a in enumerate(_TERMS) for j, b in enumerate(_TERMS) if i <= j]
    g = t.groupBy("cx", "cy").agg(*sums, F.count("*").alias("k"), F.avg(F.abs("v")).alias("mean_abs"))
    indices = [1.0, 2.0, 3.0] if n is None else [float(n)] if n else []
    half_m = window // 2 * h

    def run(batches):
        for p in batches:
            s = np.zeros((len(p), 6, 6))
            for i in range(6):
                for j in range(i, 6):
                    s[:, i, j] = s[:, j, i] = p[f"s{i}{j}"].to_numpy(float)
            best = np.full((len(p), 6), np.nan)
            best[:, 5] = np.inf
            for nn in indices:
                # Unknowns x, y, depth, background with row (dx, dy, -dz, n) and right side r + n m.
                scale = np.array([1, 1, 1, nn])
                a = s[:, :4, :4] * scale[:, None] * scale[None, :]
                b = (s[:, :4, 4] + nn * s[:, :4, 5]) * scale
                lam = 1e-6 * np.max(np.stack([a[:, i, i] for i in range(3)], 1), 1)
                reg = a.copy()
                for i in range(3):
                    reg[:, i, i] += lam
                ok = np.abs(np.linalg.det(reg)) > 1e-300
                reg[~ok] = np.eye(4)
                u = np.linalg.solve(reg, b[..., None])[..., 0]
                rhs2 = s[:, 4, 4] + 2 * nn * s[:, 4, 5] + nn * nn * s[:, 5, 5]
                ss = np.maximum(np.einsum("ki,kij,kj->k", u, a, u) - 2 * (u * b).sum(1) + rhs2, 0)
                mean = p["mean_abs"].to_numpy(float)
                res = np.where(mean > 1e-9, np.sqrt(ss / p["k"].to_numpy(float)) / np.maximum(mean, 1e-9), np.inf)
                fine = ok & np.isfinite(u).all(1) & (u[:, 2] >= min_depth) & (u[:, 2] <= max_depth) & (np.abs(u[:, :2]) <= offset * half_m * 2).all(1) & (res < best[:, 5])
                best[fine] = np.column_stack([u[:, 0], u[:, 1], u[:, 2], np.full(len(p), nn), u[:, 3], res])[fine]
            found = np.isfinite(best[:, 5])
            q = p[found]
            yield pd.DataFrame({"cx": q["cx"], "cy": q["cy"], "x": spec["xmin"] + q["cx"] * h + best[found, 0], "y": spec["ymin"] + q["cy"] * h + best[found, 1], "depth_m": best[found, 2], "n": best[found, 3], "background": best[found, 4], "residual": best[found, 5], "mean_abs": q["mean_abs"]})

    return g.mapInPandas(run, "cx int, cy int, x double, y double, depth_m double, n double, background double, residual double, mean_abs double")


def euler_sources(solutions: DataFrame, resolution: float, min_confidence: float = 0.05, voxel_scale: float = 0.15) -> DataFrame:
    """x, y, z, depth_m, n, size, proxy, confidence, anomaly, background, residual of the solutions that can be trusted.

    confidence is 1 / (1 + 2 residual); proxy is mean |M| * depth^(n + 1) over
    the value at index floor(0.95 count) in order (the last one at most), from 0
    to 1; size grows with depth from the resolution up to half the depth.
    """
    s = solutions.withColumn("confidence", 1 / (1 + 2 * F.col("residual"))).where(F.col("confidence") >= min_confidence)
    s = materialise(s.withColumn("_raw", F.col("mean_abs") * F.pow("depth_m", F.col("n") + 1)), "solutions")
    count = s.count()
    at = min(int(0.95 * count), count - 1) / max(count - 1, 1)
    scale = max(kth_values(s, "_raw", [at])[0] if count else 0.0, 1e-9)
    size = F.least(F.greatest(F.col("depth_m") * voxel_scale, F.lit(resolution)), F.col("depth_m") * 0.5)
    proxy = F.least(F.greatest(F.col("_raw") / scale, F.lit(0.0)), F.lit(1.0))
    return s.select("x", "y", (-F.col("depth_m")).alias("z"), "depth_m", "n", size.alias("size"), proxy.alias("proxy"), "confidence", F.col("mean_abs").alias("anomaly"), "background", "residual")
