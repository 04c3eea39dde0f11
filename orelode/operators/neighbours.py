"""Nearest neighbours in two or three dimensions.

Few points (counted, at most ``BROADCAST_ROWS``) travel to the tasks and are
searched there in chunks; more are partitioned into leaves (``leaves``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leaves import nearest, smallest
from .pairs import pair_rows

BROADCAST_ROWS = 50_000
#: Distances that a task of that search computes.
TASK_PAIRS = 200_000_000
_OUT = "id {kind}, pid {pkind}, rank int, d double, v double"


def _broadcast_search(left: DataFrame, points: DataFrame, k: int, radius: float, dims: tuple[str, ...], exclude_self: bool, squares: bool) -> DataFrame:
    rows = points.select("pid", *dims, "v").orderBy("pid").collect()  # at most BROADCAST_ROWS
    kinds = {"kind": left.schema["id"].dataType.simpleString(), "pkind": points.schema["pid"].dataType.simpleString()}
    told = left.sparkSession.sparkContext.broadcast((np.array([r["pid"] for r in rows]), np.array([[r[d] for d in dims] for r in rows], float).reshape(-1, len(dims)), np.array([r["v"] for r in rows], float)))
    limit = float(radius) if radius > 0 else np.inf

    def run(batches):
        pid, at, v = told.value
        for p in batches:
            xy = p[list(dims)].to_numpy(float)
            step = max(1, (1 << 20) // max(1, len(at)))
            for a in range(0, len(p), step):
                ids = p["id"].to_numpy()[a : a + step]
                d2 = np.zeros((len(ids), len(at)))
                for j in range(len(dims)):
                    d2 += (xy[a : a + step, j, None] - at[None, :, j]) ** 2
                d2[np.isnan(d2)] = np.inf
                if exclude_self:
                    d2[ids[:, None] == pid[None, :]] = np.inf
                i, j, d = smallest(d2, np.full(len(ids), limit), k, squares)
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                yield pd.DataFrame({"id": ids[i], "pid": pid[j], "rank": rank.astype(np.int32), "d": np.sqrt(d) if squares else d, "v": v[j]})

    # A small file is one task, whatever is searched for its rows.
    own = left.select("id", *dims)
    tasks = -(-own.count() * len(rows) // TASK_PAIRS)
    return (own.repartition(tasks, "id") if tasks > 1 else own).mapInPandas(run, _OUT.format(**kinds))


def knn(left: DataFrame, points: DataFrame, k: int, radius: float = 0.0, dims: tuple[str, ...] = ("x", "y"), exclude_self: bool = False, broadcast_rows: int = BROADCAST_ROWS, squares: bool = False) -> DataFrame:
    """id, pid, rank, d, v: the k nearest ``points(pid, dims, v)`` of each ``left(id, dims)``; ties by pid.

    Distances tie if they are equal; with ``squares`` only if their squares
    are, of which several may round to one root.
    """
    n = points.count()
    if n <= broadcast_rows:
        return _broadcast_search(left, points, k, radius, dims, exclude_self, squares)
    return nearest(left, points, k, radius, dims, exclude_self, squares=squares)


def knn_2d(left: DataFrame, points: DataFrame, k: int = 32, radius: float = 0.0) -> DataFrame:
    return knn(left, points, k, radius)


def rotated(df: DataFrame, azimuth: float, ax: float, ay: float, az: float) -> DataFrame:
    """x, y, z turned by the azimuth and divided by the anisotropy, as _u, _v, _w."""
    c, s = math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
    return df.select("*", ((F.col("x") * c + F.col("y") * s) / ax).alias("_u"), ((-F.col("x") * s + F.col("y") * c) / ay).alias("_v"), (F.col("z") / az).alias("_w"))


def knn_3d_anisotropic(left: DataFrame, points: DataFrame, k: int = 24, radius: float = 0.0, azimuth: float = 0.0, ax: float = 1.0, ay: float = 1.0, az: float = 1.0) -> DataFrame:
    """id, pid, rank, d_norm (in turned, scaled space), d_true, v."""
    l, p = rotated(left.select("id", "x", "y", "z"), azimuth, ax, ay, az), rotated(points.select("pid", "x", "y", "z", "v"), azimuth, ax, ay, az)  # noqa: E741
    near = knn(l, p, k, radius, ("_u", "_v", "_w"))
    far = near.join(l.select("id", "x", "y", "z"), "id").join(p.select("pid", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z")), "pid")
    true = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2)
    return far.select("id", "pid", "rank", F.col("d").alias("d_norm"), true.alias("d_true"), "v")


def nearest_distance(left: DataFrame, points: DataFrame) -> DataFrame:
    return knn(left, points, 1).select("id", "d")


def gathered(neighbours: DataFrame) -> DataFrame:
    """One row for each id of ``neighbours(id, rank, d, v)``: how many, the largest distance, the nearest, all."""
    return neighbours.groupBy("id").agg(F.count("*").alias("_n"), F.max("d").alias("_far"), F.min(F.struct("rank", "d", "v")).alias("_near"), F.collect_list(F.struct("d", "v")).alias("_all"))


def weighted(g: DataFrame, method: str = "idw", power: float = 2.0, min_points: int = 3, hit_d: float = 1e-6) -> DataFrame:
    """id, v of ``gathered`` neighbours, row by row: several methods need one search and one shuffle."""
    reach = F.greatest("_far", F.lit(1e-9))
    weight = {
        "rbf": lambda s: F.exp(-((s["d"] / reach) ** 2)),
        "kriging": lambda s: 1.0 / (0.05 + F.greatest(1.0 - F.exp(-(s["d"] / reach)), F.lit(1e-6))),
    }.get(method, lambda s: F.pow(s["d"], F.lit(-min(max(power, 1.0), 6.0))))
    add = lambda of: F.aggregate("_all", F.lit(0.0), lambda a, s: a + of(s))
    hit = F.col("_near.d") < hit_d
    value = F.when(hit | F.lit(method == "nearest"), F.col("_near.v")).otherwise(add(lambda s: weight(s) * s["v"]) / add(weight))
    return g.where(F.col("_n") >= min_points).select("id", value.alias("v"))


def interpolate(neighbours: DataFrame, method: str = "idw", power: float = 2.0, min_points: int = 3, hit_d: float = 1e-6) -> DataFrame:
    """id, v from ``neighbours(id, rank, d, v)``: idw, nearest, rbf or kriging weights; a neighbour nearer than ``hit_d`` gives its value."""
    return weighted(gathered(neighbours), method, power, min_points, hit_d)


def leave_one_out(points: DataFrame, method: str = "idw", k: int = 32, radius: float = 0.0, min_points: int = 3, power: float = 2.0) -> DataFrame:
    """id, observed, predicted, residual: each of ``points(pid, x, y, v)`` from the others."""
    near = knn(points.withColumnRenamed("pid", "id"), points, k, radius, exclude_self=True)
    got = interpolate(near, method, power, min_points).withColumnRenamed("v", "predicted")
    own = points.select(F.col("pid").alias("id"), F.col("v").alias("observed"))
    return own.join(got, "id").select("id", "observed", "predicted", (F.col("observed") - F.col("predicted")).alias("residual"))


def pair_self_join(points: DataFrame, max_d: float) -> DataFrame:
    """i, j, d, half_sq_diff of all pairs of ids i < j at most ``max_d`` apart, from pairs of tiles."""
    kind = points.schema["pid"].dataType.simpleString()

    def of(a, b, i, j, d):
        va, vb = np.asarray(a.field("v"), float), np.asarray(b.field("v"), float)
        one, two = a.field("pid").take(pa.array(i)), b.field("pid").take(pa.array(j))
        turn = pc.greater(one, two)
        out = pa.RecordBatch.from_arrays([pc.if_else(turn, two, one), pc.if_else(turn, one, two), pa.array(d), pa.array(0.5 * (va[i] - vb[j]) ** 2)], names=["i", "j", "d", "half_sq_diff"])
        return out.filter(pc.not_equal(out["i"], out["j"]))

    rows = points.select("pid", *(F.col(c).cast("double").alias(c) for c in "xyzv")).where(" and ".join(f"{c} is not null" for c in ("pid", *"xyz")))
    return pair_rows(rows, ("x", "y", "z"), ["pid", *"xyzv"], max_d, f"i {kind}, j {kind}, d double, half_sq_diff double", of)
