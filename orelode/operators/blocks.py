"""Resource model: variogram, blocks, domains, grades, tonnage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grade_factor
from .grids import point_in_polygon, topography_clip
from .neighbours import knn_3d_anisotropic
from .pairs import lag_sums
from .shared import materialise
from .stats import histogram

OUNCES_PER_TONNE = 32150.74656862745


def variogram(points: DataFrame, lags: int = 12, max_range: float = 0.0) -> DataFrame:
    """lag_from, lag_to, lag_mid, pairs, gamma over all pairs in range (half the diagonal by default); an empty lag has gamma 0.

    No pair is a row: tasks compare tiles of points and send a count and a sum per lag (``pairs.lag_sums``).
    """
    if max_range <= 0:
        e = points.agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
        max_range = 0.5 * math.sqrt(sum((v or 0.0) ** 2 for v in e)) or 1.0
    step = max_range / lags
    g = lag_sums(points, lags, max_range).select("lag", "pairs", F.try_divide("gamma_sum", "pairs").alias("gamma"))
    every = points.sparkSession.range(lags).select(F.col("id").cast("int").alias("lag"))
    return every.join(g, "lag", "left").select((F.col("lag") * step).alias("lag_from"), ((F.col("lag") + 1) * step).alias("lag_to"), ((F.col("lag") + 0.5) * step).alias("lag_mid"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("gamma", F.lit(0.0)).alias("gamma"))


def variogram_readout(bins: DataFrame) -> DataFrame:
    """nugget (first gamma), sill (mean of the last third), range (first lag that reaches 95 % of it); the bins are a few rows."""
    b = bins.agg(F.array_sort(F.collect_list(F.struct("lag_mid", "gamma"))).alias("b"))
    n = F.size("b")
    tail = F.slice("b", n - F.greatest(F.floor(n / 3), F.lit(1)).cast("int") + 1, n)
    sill = F.aggregate(tail, F.lit(0.0), lambda a, s: a + s["gamma"]) / F.size(tail)
    b = b.where("size(b) > 0").withColumn("sill", sill)
    reach = F.filter("b", lambda s: s["gamma"] >= 0.95 * F.col("sill"))
    return b.select(F.col("b")[0]["gamma"].alias("nugget"), "sill", F.coalesce(F.get(reach, F.lit(0))["lag_mid"], F.element_at("b", -1)["lag_mid"]).alias("range"))


def cutoff_sensitivity(blocks: DataFrame, lo: float, hi: float, steps: int = 8, unit: str = "ppm") -> DataFrame:
    """cutoff, blocks, tonnage_t, metal_oz at or above each of ``steps`` cutoffs, in one pass."""
    cutoffs = [lo + (hi - lo) * k / max(steps - 1, 1) for k in range(steps)]
    reached = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(cutoffs))), lambda s: s["c"] <= F.col("grade"))
    g = blocks.select("tonnage_t", "grade", F.explode(reached).alias("s")).groupBy("s.k").agg(F.count("*").alias("blocks"), F.sum("tonnage_t").alias("t"), (F.sum(F.col("tonnage_t") * F.col("grade")) * (grade_factor(unit) * OUNCES_PER_TONNE)).alias("oz"))
    every = blocks.sparkSession.createDataFrame([(k, c) for k, c in enumerate(cutoffs)], "k int, cutoff double")
    return every.join(g, "k", "left").select("cutoff", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("t", F.lit(0.0)).alias("tonnage_t"), F.coalesce("oz", F.lit(0.0)).alias("metal_oz"))


def resource_totals(blocks: DataFrame, cutoff: float = 0.0, unit: str = "ppm") -> DataFrame:
    """Totals of all blocks and of those at or above the cutoff, in one row."""
    k, above = grade_factor(unit), F.col("grade") >= cutoff
    t = F.col("tonnage_t")
    a = blocks.agg(
        F.count("*").alias("blocks"), F.sum(t).alias("tonnage_t"), F.sum(t * F.col("grade")).alias("contained"),
        F.count_if(above).alias("blocks_above"), F.coalesce(F.sum(F.when(above, t)), F.lit(0.0)).alias("tonnage_above_t"), F.coalesce(F.sum(F.when(above, t * F.col("grade"))), F.lit(0.0)).alias("contained_above"),
        F.min("grade").alias("grade_min"), F.max("grade").alias("grade_max"),
    )
    a = a.withColumn("metal_t", F.col("contained") * k).withColumn("metal_oz", F.col("metal_t") * OUNCES_PER_TONNE).withColumn("metal_above_oz", F.col("contained_above") * k * OUNCES_PER_TONNE)
    a = a.withColumn("grade_mean", F.try_divide("contained", "tonnage_t")).withColumn("grade_mean_above", F.try_divide("contained_above", "tonnage_above_t"))
    return a.withColumn("share_blocks", F.try_divide("blocks_above", "blocks")).withColumn("share_tonnage", F.try_divide("tonnage_above_t", "tonnage_t"))


def support_diagnostics(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.avg("n_used").alias("mean_n_used"), F.avg("nearest_m").alias("mean_nearest_m"), F.avg("mean_m").alias("mean_distance_m"), *(F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")))


def block_grid(spark: SparkSession, extent: DataFrame, dx: float = 20.0, dy: float = 20.0, dz: float = 10.0, max_blocks: int = 45_000) -> DataFrame:
    """ix, iy, iz, x, y, z, dx, dy, dz of blocks that fill the extent; sizes grow alike where there would be over ``max_blocks``."""
    e = extent.first()
    size, span = [dx, dy, dz], [e[f"{c}max"] - e[f"{c}min"] for c in "xyz"]
    total = math.prod(max(1, math.ceil(s / d)) for s, d in zip(span, size, strict=True))
    if total > max_blocks:
        size = [d * (total / max_blocks) ** (1 / 3) for d in size]
    nx, ny, nz = (max(1, math.ceil(s / d)) for s, d in zip(span, size, strict=True))
    b = spark.range(nx * ny * nz).select((F.col("id") % nx).cast("int").alias("ix"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("iy"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("iz"))
    return b.select("ix", "iy", "iz", *((e[f"{c}min"] + (F.col(f"i{c}") + 0.5) * d).alias(c) for c, d in zip("xyz", size, strict=True)), *(F.lit(float(d)).alias(f"d{c}") for c, d in zip("xyz", size, strict=True)))


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, collinear points left out (monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def convex_hull(points: DataFrame) -> DataFrame:
    """seq, x, y of the hull's corners. Each task sends the hull of its points; the hull of these few is the result."""

    def local(batches):
        rest = np.zeros((0, 2))
        for p in batches:
            rest = _hull(np.vstack([rest, p[["x", "y"]].dropna().to_numpy(float)]))
        yield pd.DataFrame(rest, columns=["x", "y"])

    def final(p: pd.DataFrame) -> pd.DataFrame:
        h = _hull(p[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"seq": np.arange(len(h), dtype=np.int32), "x": h[:, 0], "y": h[:, 1]})

    return points.select("x", "y").mapInPandas(local, "x double, y double").groupBy().applyInPandas(final, "seq int, x double, y double")


def domain_filter(blocks: DataFrame, ring: list[tuple[float, float]] | None = None, mode: str = "full_extent", buffer: float = 0.0) -> DataFrame:
    """Blocks whose centre lies in the domain: full_extent, convex_hull, buffered_hull or input_domain_mask (inside ``ring``)."""
    if mode == "full_extent" or not ring:
        return blocks
    return point_in_polygon(blocks, ring, buffer if mode == "buffered_hull" else 0.0).where("inside").drop("inside", "edge_distance")


def point_in_mesh(df: DataFrame, triangles: DataFrame, bins: int = 32, id_col: str = "id") -> DataFrame:
    """``df(id, x, y, z)`` with inside, for a closed mesh ``triangles(ax .. cz)``.

    Triangles go to the cells of their outline's box; a point meets those of
    its own cell, and is inside if it lies between the hits of its vertical
    line in pairs (first and second, third and fourth, ...).
    """
    t = triangles.select(*(F.col(f"{p}{c}").cast("double").alias(f"{p}{c}") for p in "abc" for c in "xyz"))
    e = t.agg(*(f(g(*(F.col(f"{p}{c}") for p in "abc"))).alias(f"{c}{n}") for c in "xy" for n, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest)))).first()
    w = {c: max((e[f"{c}max"] - e[f"{c}min"]) / bins, 1e-9) for c in "xy"}
    cell = lambda c, v: F.floor((v - e[f"{c}min"]) / w[c]).cast("int")
    for c in "xy":
        lo, hi = (g(*(F.col(f"{p}{c}") for p in "abc")) for g in (F.least, F.greatest))
        t = t.withColumn(f"_{c}", F.explode(F.sequence(cell(c, lo), cell(c, hi))))
    p = df.withColumn("_x", cell("x", F.col("x"))).withColumn("_y", cell("y", F.col("y")))
    det = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy"))
    u = ((F.col("by") - F.col("cy")) * (F.col("x") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("y") - F.col("cy"))) / det
    v = ((F.col("cy") - F.col("ay")) * (F.col("x") - F.col("cx")) + (F.col("ax") - F.col("cx")) * (F.col("y") - F.col("cy"))) / det
    own = p.select(F.col(id_col).alias("_id"), "x", "y", "z", "_x", "_y")
    hit = own.join(t, ["_x", "_y"]).where(F.abs(det) > 1e-12).withColumn("u", u).withColumn("w", v).where("u >= 0 and w >= 0 and u + w <= 1")
    hit = hit.withColumn("hz", F.col("u") * F.col("az") + F.col("w") * F.col("bz") + (1 - F.col("u") - F.col("w")) * F.col("cz"))
    # Hits on a shared edge come twice at one height and count once.
    h = hit.groupBy("_id").agg(F.array_sort(F.collect_set(F.round("hz", 9))).alias("h"), F.first("z").alias("z"))
    pairs = F.sequence(F.lit(0), F.size("h") - 2, F.lit(2))
    inside = F.when(F.size("h") >= 2, F.exists(pairs, lambda k: (F.get("h", k) <= F.col("z")) & (F.col("z") <= F.get("h", k + 1)))).otherwise(F.lit(False))
    return df.join(h.select(F.col("_id").alias(id_col), inside.alias("inside")), id_col, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def mesh_filter(blocks: DataFrame, triangles: DataFrame, mode: str = "mesh_containment") -> DataFrame:
    """Blocks whose centre lies in the mesh."""
    if mode != "mesh_containment":
        raise ValueError(f"{mode} is reserved")
    b = blocks.withColumn("_bid", F.struct("ix", "iy", "iz"))
    return point_in_mesh(b, triangles, id_col="_bid").where("inside").drop("_bid", "inside")


def estimate_grade(blocks: DataFrame, samples: DataFrame, method: str = "idw", power: float = 2.0, min_samples: int = 3, max_samples: int = 24, radius: float = 0.0, grade_min: float | None = None, grade_max: float | None = None, default_sg: float = 2.5, **turn) -> DataFrame:
    """Blocks with grade, sg, n_used, nearest_m, mean_m from the nearest of ``samples(pid, x, y, z, v, sg)``; blocks with too few go."""
    b = blocks.withColumn("id", (F.col("iz").cast("long") * 100_000 + F.col("iy")) * 100_000 + F.col("ix"))
    near = knn_3d_anisotropic(b, samples.select("pid", "x", "y", "z", "v"), max_samples, radius, **turn)
    near = near.join(samples.select("pid", "sg"), "pid")
    p = min(max(power, 1.0), 4.0)
    w = 1.0 / F.pow(F.greatest("d_norm", F.lit(1e-9)), F.lit(p))
    g = near.groupBy("id").agg(
        F.count("*").alias("n_used"), F.min(F.struct("rank", "d_norm", "v", "sg")).alias("near"), F.min("d_true").alias("nearest_m"), F.avg("d_true").alias("mean_m"),
        (F.sum(w * F.col("v")) / F.sum(w)).alias("idw"), F.try_divide(F.sum(F.when(F.col("sg").isNotNull(), w * F.col("sg"))), F.sum(F.when(F.col("sg").isNotNull(), w))).alias("sg_idw"),
    ).where(F.col("n_used") >= min_samples)
    hit = (F.col("near.d_norm") <= 1e-9) | F.lit(method == "nearest")
    grade = F.when(hit, F.col("near.v")).otherwise(F.col("idw"))
    if grade_min is not None:
        grade = F.greatest(grade, F.lit(float(grade_min)))
    if grade_max is not None:
        grade = F.least(grade, F.lit(float(grade_max)))
    sg = F.coalesce(F.when(hit, F.col("near.sg")), F.col("sg_idw"), F.lit(default_sg))
    g = g.select("id", grade.alias("grade"), F.greatest(F.least(sg, F.lit(8.0)), F.lit(0.2)).alias("sg"), "n_used", "nearest_m", "mean_m")
    return b.join(g, "id").drop("id")


def confidence(n: Column, nearest: Column, mean: Column, diagonal: Column) -> Column:
    return F.when((n >= 12) & (nearest <= 0.75 * diagonal) & (mean <= 2 * diagonal), "high").when((n >= 6) & (nearest <= 1.5 * diagonal), "medium").otherwise("low")


def block_tonnage(blocks: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """Blocks with tonnage_t, contained, above_cutoff, confidence."""
    diagonal = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    b = blocks.withColumn("tonnage_t", F.col("dx") * F.col("dy") * F.col("dz") * F.col("sg"))
    return b.withColumn("contained", F.col("tonnage_t") * F.col("grade")).withColumn("above_cutoff", F.col("grade") >= cutoff).withColumn("confidence", confidence(F.col("n_used"), F.col("nearest_m"), F.col("mean_m"), diagonal))


def block_grade_model(samples: DataFrame, grid: DataFrame | None = None, spec: dict | None = None, ring=None, triangles: DataFrame | None = None, domain: str = "full_extent", cutoff: float = 0.0, composite: float = 0.0, cap: dict | None = None, unit: str = "ppm", size=(20.0, 20.0, 10.0), max_blocks: int = 45_000, steps: int = 8, **how) -> dict[str, DataFrame]:
    """blocks (above the cutoff), totals, support, histogram, cutoffs, variogram from ``samples(hole_id, from_m, to_m, depth_m, x, y, z, v, sg)``."""
    from .drillhole import composite_intervals
    from .ingest import top_cut
    from .stats import extent_3d

    s = top_cut(composite_intervals(samples, composite).where("v is not null"), "v", **(cap or {}))
    s = materialise(s.withColumn("pid", F.xxhash64("hole_id", "from_m", "to_m", "depth_m", "x", "y", "z", "v")).dropDuplicates(["pid"]), "samples")
    b = block_grid(samples.sparkSession, extent_3d(s), *size, max_blocks=max_blocks)
    b = domain_filter(b, ring, domain)
    if grid is not None:
        b = topography_clip(b, grid, spec)
    if triangles is not None:
        b = mesh_filter(b, triangles)
    b = materialise(block_tonnage(estimate_grade(b, s, **how), cutoff), "blocks")
    lo, hi = b.agg(F.min("grade"), F.max("grade")).first()
    return {
        "blocks": b.where("above_cutoff"), "totals": resource_totals(b, cutoff, unit), "support": support_diagnostics(b), "histogram": histogram(s, "v"),
        "cutoffs": cutoff_sensitivity(b, lo or 0.0, hi or 0.0, steps, unit), "variogram": variogram(s),
    }


