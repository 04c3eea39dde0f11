"""Contours: levels, marching squares, lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components, roots
from ..functions import scale_transform
from .grids import corners
from .leaves import partition, with_leaf
from .selection import kth_values
from .shared import global_rank, materialise


def contour_breaks(values: DataFrame, column: str = "v", mode: str = "fixed_interval", interval: float | None = None, levels: int = 10, explicit: list[float] | None = None, scale: str = "linear") -> DataFrame:
    """level: every interval between the extremes, quantiles (nearest rank of i / levels), or a list (transformed, ordered, without near-repeats)."""
    spark = values.sparkSession
    if mode == "list":
        own = spark.createDataFrame([(float(x),) for x in explicit or []], "level double").select(scale_transform("level", scale).alias("level")).dropna()
        got = sorted(r["level"] for r in own.collect())
        got = [x for k, x in enumerate(got) if not k or x - got[k - 1] > 1e-9]
    elif mode == "quantile":
        got = kth_values(values, column, [i / levels for i in range(1, levels)])
        got = sorted({x for x in got if x is not None})
    else:
        e = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        step = F.lit(float(interval)) if interval else (F.col("hi") - F.col("lo")) / levels
        count = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / step - 1e-9) - 1, F.lit(0)).cast("int")
        e = e.withColumn("s", step).where("lo is not null and s > 0")
        return e.select(F.explode(F.transform(F.slice(F.sequence(F.lit(0), count), 2, 1_000_000), lambda i: F.col("lo") + i * F.col("s"))).alias("level"))
    return spark.createDataFrame([(x,) for x in got], "level double")


def marching_squares(grid: DataFrame, spec: dict, breaks: DataFrame) -> DataFrame:
    """level, ix, iy, x0, y0, x1, y1: where each level crosses each cell of four known corners.

    A corner is inside if its value reaches the level. Crossings are taken from
    the bottom, right, top and left edge in this order; two give a segment,
    four give two. Only levels between a cell's extremes are tried.
    """
    dx, dy = ((spec[f"{c}max"] - spec[f"{c}min"]) / (spec[f"n{c}"] - 1) for c in "xy")
    c = corners(grid, spec, clamp_edges=False).where("v00 is not null and v10 is not null and v11 is not null and v01 is not null")
    all_levels = breaks.agg(F.array_sort(F.collect_set("level")).alias("_all"))  # one row: the levels are few
    c = c.crossJoin(F.broadcast(all_levels))
    lo, hi = F.least("v00", "v10", "v11", "v01"), F.greatest("v00", "v10", "v11", "v01")
    c = c.withColumn("level", F.explode(F.filter("_all", lambda v: (v > lo) & (v <= hi)))).drop("_all")
    x0, y0 = spec["xmin"] + F.col("ix") * dx, spec["ymin"] + F.col("iy") * dy
    x1, y1 = spec["xmin"] + (F.col("ix") + 1) * dx, spec["ymin"] + (F.col("iy") + 1) * dy

    def edge(a: str, b: str, p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
        d = F.col(b) - F.col(a)
        t = F.when(F.abs(d) < 1e-12, F.lit(0.5)).otherwise(F.greatest(F.least((F.col("level") - F.col(a)) / F.when(d == 0, F.lit(1.0)).otherwise(d), F.lit(1.0)), F.lit(0.0)))
        at = F.struct((p[0] + (q[0] - p[0]) * t).alias("x"), (p[1] + (q[1] - p[1]) * t).alias("y"))
        return F.when((F.col(a) >= F.col("level")) != (F.col(b) >= F.col("level")), at)

    edges = F.array(edge("v00", "v10", (x0, y0), (x1, y0)), edge("v10", "v11", (x1, y0), (x1, y1)), edge("v11", "v01", (x1, y1), (x0, y1)), edge("v01", "v00", (x0, y1), (x0, y0)))
    hits = c.withColumn("_h", F.filter(edges, lambda e: e.isNotNull())).where("size(_h) >= 2")
    pairs = F.when(F.size("_h") == 4, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    s = hits.withColumn("_k", F.explode(pairs)).withColumn("_a", F.get("_h", F.col("_k"))).withColumn("_b", F.get("_h", F.col("_k") + 1))
    return s.select("level", "ix", "iy", F.col("_a.x").alias("x0"), F.col("_a.y").alias("y0"), F.col("_b.x").alias("x1"), F.col("_b.y").alias("y1"))


def iso_extract(grid: DataFrame, spec: dict, mode: str = "fixed_interval", interval: float | None = None, levels: int = 10, z_base: float = 0.0, z_scale: float = 1.0) -> DataFrame:
    """Marching squares at chosen levels, with z = z_base + z_scale * level."""
    return marching_squares(grid, spec, contour_breaks(grid, "v", mode, interval, levels)).withColumn("z", z_base + z_scale * F.col("level"))


def contour_xyz(grid: DataFrame, spec: dict, **how) -> DataFrame:
    """level, x, y, z of both ends of every contour segment."""
    s = iso_extract(grid, spec, **how)
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return s.select("level", "z", F.explode(ends).alias("p")).select("level", "p.x", "p.y", "z")


def _ranked(arcs: DataFrame, max_rounds: int) -> DataFrame:
    """Arcs u -> v with ``next`` (the arc that follows, null at the end of a run) ranked by pointer doubling.

    Returns id, a, b, last (the run's last arc), steps (arcs from here to it)
    and low (the smallest of the vertices after this one and before the run's
    end). Each round doubles how far an arc sees, so a run of n arcs takes
    log2(n) rounds of one join, whatever tasks its arcs lie in.
    """
    # What an arc sees: the arcs from itself up to ``at``, and the smallest vertex between them.
    seen = arcs.select("id", "a", "b", F.col("id").alias("at"), "next", F.lit(0).cast("long").alias("steps"), F.lit(None).cast("long").alias("low"))
    seen = materialise(seen, "arcs")
    for _ in range(max_rounds):
        if seen.where("next is not null").isEmpty():
            return seen.select("id", "a", "b", F.col("at").alias("last"), "steps", "low")
        far = seen.select(F.col("id").alias("next"), F.col("at").alias("_at"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("a").alias("_a"))
        j = seen.join(far, "next", "left")
        more = F.col("_at").isNotNull()
        seen = materialise(
            j.select("id", "a", "b", F.when(more, F.col("_at")).otherwise(F.col("at")).alias("at"), F.col("_next").alias("next"), (F.col("steps") + F.coalesce(F.col("_steps") + 1, F.lit(0))).alias("steps"), F.least("low", "_a", "_low").alias("low")), "arcs"
        )
    raise RuntimeError(f"runs of contours are not ranked after {max_rounds} rounds")


def _walk(p: pd.DataFrame) -> pd.DataFrame:
    """The runs of one component put together: run, part, start (place of its first vertex in the part), closed.

    From the smallest vertex with an odd number of runs left, or else the
    smallest, always on to the smallest next vertex, until none is left.
    """
    out: dict[int, list[tuple]] = {}
    twin, length = {}, {}
    for a, b, first, run, back, n in zip(p["a"], p["b"], p["first"], p["run"], p["back"], p["n"], strict=True):
        out.setdefault(a, []).append((first, b, run))
        twin[run], length[run] = back, n
    for v in out.values():
        v.sort()
    left, rows, part = set(twin), [], 0
    while left:
        degree = {v: sum(r in left for _, _, r in runs) for v, runs in out.items()}
        at = min((v for v, d in degree.items() if d % 2), default=None)
        at = min(v for v, d in degree.items() if d) if at is None else at
        begin, place, path = at, 0, []
        while nxt := next(((b, r) for _, b, r in out[at] if r in left), None):
            at, run = nxt
            left -= {run, twin[run]}
            path.append((run, place))
            place += length[run]
        rows += [(run, part, start, at == begin) for run, start in path]
        part += 1
    return pd.DataFrame(rows, columns=["run", "part", "start", "closed"])


#: Edges that one task puts together at a time.
LEAF_EDGES = 50_000


def _walk_edges(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> tuple[list, list, list, list]:
    """vertex, part, seq, closed: components of the edges a-b walked as ``_walk`` does; ``low`` is each vertex's smallest one.

    A walk takes the odd degrees of its two ends only, so both the odd
    vertices and those with edges left are passed once: linear in the edges.
    """
    src, dst, edge = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((dst, src))
    at_ = np.searchsorted(src[order], np.arange(len(low) + 1)).tolist()
    left = np.bincount(src, minlength=len(low))
    known = np.flatnonzero(left)
    known = known[np.lexsort((known, low[known]))]
    cuts = np.append(np.flatnonzero(np.diff(low[known], prepend=-1)), len(known)).tolist()
    dst, edge, left, known, on = dst[order].tolist(), edge[order].tolist(), left.tolist(), known.tolist(), at_[:-1]
    used = bytearray(len(a))
    vertex, parts, seq, closed = [], [], [], []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        odd, o, part = [v for v in known[s:e] if left[v] & 1], 0, 0
        while True:
            while o < len(odd) and not left[odd[o]] & 1:
                o += 1
            while s < e and not left[known[s]]:
                s += 1
            if s == e:
                break
            at = odd[o] if o < len(odd) else known[s]
            path = [at]
            while True:
                k, end = on[at], at_[at + 1]
                while k < end and used[edge[k]]:
                    k += 1
                on[at] = k
                if k == end:
                    break
                used[edge[k]] = 1
                left[at] -= 1
                at = dst[k]
                left[at] -= 1
                path.append(at)
            vertex += path
            parts += [part] * len(path)
            seq += range(len(path))
            closed += [at == path[0]] * len(path)
            part += 1
    return vertex, parts, seq, closed


_PLACES = "open boolean, level double, i long, j long, i2 long, j2 long, part int, seq int, closed boolean"


def _within(p: pd.DataFrame) -> pd.DataFrame:
    """Lines of a leaf's edges: the places of those that stay within it; the edges of the others (open), each from the leaf of its end a."""
    lv, i, j = (np.concatenate([p[f"{c}a"], p[f"{c}b"]]) for c in "lij")
    order = np.lexsort((j, i, lv))
    new = np.ones(len(lv), bool)
    new[1:] = (np.diff(lv[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
    ids, first = np.empty(len(lv), np.int64), order[new]
    ids[order] = np.cumsum(new) - 1
    a, b = ids[: len(p)], ids[len(p) :]
    low = roots(a, b)[1]  # every vertex has an edge
    leaves = p["leaf"].to_numpy(), p["leaf_a"].to_numpy(), p["leaf_b"].to_numpy()
    far = np.zeros(len(first), bool)
    far[low[a[leaves[1] != leaves[2]]]] = True
    goes_on = far[low[a]]
    own = goes_on & (leaves[0] == leaves[1])
    apart = pd.DataFrame({"open": True, "level": lv[: len(p)][own], "i": i[: len(p)][own], "j": j[: len(p)][own], "i2": i[len(p) :][own], "j2": j[len(p) :][own], "part": 0, "seq": 0, "closed": False})
    vertex, part, seq, closed = _walk_edges(a[~goes_on], b[~goes_on], low)
    vertex = np.array(vertex, np.int64)
    at, of = first[vertex], first[low[vertex]]
    done = pd.DataFrame({"open": False, "level": lv[at], "i": i[at], "j": j[at], "i2": i[of], "j2": j[of], "part": part, "seq": seq, "closed": closed})
    return pd.concat([x for x in (apart, done) if len(x)] or [done]).astype({"open": bool, "level": float, "i": int, "j": int, "i2": int, "j2": int, "part": "int32", "seq": "int32", "closed": bool})


def stitch_contours(segments: DataFrame, max_rounds: int = 60, leaf_edges: int = LEAF_EDGES) -> DataFrame:
    """level, line_id, seq, x, y, closed: segments joined end to end.

    Ends are put on a lattice as wide as the tolerance, max(1e-6 of the span,
    0.12 of the tenth percentile of lengths, 1e-6), so ends that meet share a
    vertex. Lines are connected components, named by the smallest vertex.

    Space is cut into leaves of at most ``leaf_edges`` edges. Lines that stay
    within their leaf are walked there; the edges of those that cross into
    another one go on to joins over all leaves (``_stitch``).
    """
    s = segments.select("level", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    s = materialise(s, "segments")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    span = s.agg(F.max(F.greatest("x0", "x1", "y0", "y1")) - F.min(F.least("x0", "x1", "y0", "y1"))).first()[0]
    tol = max((span or 0) * 1e-6, 0.12 * (kth_values(s.select(length.alias("v")), "v", [0.1], linear=True)[0] or 0), 1e-6)
    vertex = lambda k: F.struct("level", F.round(F.col(f"x{k}") / tol).cast("long").alias("i"), F.round(F.col(f"y{k}") / tol).cast("long").alias("j"))
    e = s.withColumn("a", vertex(0)).withColumn("b", vertex(1)).where("a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialise(e.select(*(F.col(f"{v}.{c}").alias(f"{c[0]}{v}") for v in "ab" for c in ("level", "i", "j"))), "contour-edges")
    ends = {v: (f"l{v}", f"i{v}", f"j{v}") for v in "ab"}
    _, splits = partition(e.select(*(F.col(c).cast("double").alias(c) for c in ends["a"])), ends["a"], leaf_edges)
    rows = with_leaf(with_leaf(e, splits, ends["a"], "leaf_a"), splits, ends["b"], "leaf_b")
    rows = rows.withColumn("leaf", F.explode(F.array_distinct(F.array("leaf_a", "leaf_b"))))
    found = materialise(rows.groupBy("leaf").applyInPandas(_within, _PLACES), "contour-lines")
    lines = found.where("not open").select("level", "i", "j", "i2", "j2", "part", "seq", "closed")
    apart = found.where("open")
    if not apart.isEmpty():
        lines = lines.unionByName(_stitch(apart.select(F.struct("level", "i", "j").alias("a"), F.struct("level", F.col("i2").alias("i"), F.col("j2").alias("j")).alias("b")), max_rounds))
    line = F.concat_ws(":", F.col("level").cast("string"), F.col("i2").cast("string"), F.col("j2").cast("string"), F.col("part").cast("string"))
    return lines.select("level", line.alias("line_id"), "seq", (F.col("i") * tol).alias("x"), (F.col("j") * tol).alias("y"), "closed")


def _stitch(e: DataFrame, max_rounds: int) -> DataFrame:
    """level, i, j, i2, j2 (of the line's smallest vertex), part, seq, closed: lines of edges ``e(a, b)`` of any length, by joins.

    Lines are connected components of the vertices' ranks; an error is raised
    if they don't settle in ``max_rounds``. Between ends, junctions and the
    smallest vertex of a ring, vertices have two neighbours; places along such
    runs come from joins (``_ranked``). Each run is cut once more at its
    smallest vertex. Only runs, of which a component has as many as its
    junctions ask for, are then put in order by a walk.
    """
    ids = materialise(global_rank(e.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", name="id").select("v", "id"), "contour-vertices")
    named = lambda v, k: ids.select(F.col("v").alias(v), F.col("id").alias(k))
    edges = materialise(e.join(named("a", "_a"), "a").join(named("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), "contour-edges")
    label = materialise(connected_components(edges, max_rounds).select("node", "component"), "contour-lines")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Arcs in both directions; an arc goes on unless it comes to an end, a junction or a ring's smallest vertex.
    arcs = materialise(both.withColumn("id", F.monotonically_increasing_id()), "arcs")
    beside = arcs.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"), F.min(F.struct(F.col("b").alias("to"), "id")).alias("one"), F.max(F.struct(F.col("b").alias("to"), "id")).alias("two"))
    passed = beside.join(label.withColumnRenamed("node", "v"), "v").where("degree = 2 and v <> component")
    ranked = arcs.join(passed.select(F.col("v").alias("b"), "one", "two"), "b", "left").select("id", "a", "b", F.when(F.col("one.to") == F.col("a"), F.col("two.id")).otherwise(F.col("one.id")).alias("next"))
    ranked = _ranked(ranked, max_rounds)
    # A run is named by its last arc; its first arc sees the whole of it.
    w = ranked.groupBy("last").agg(F.max(F.struct("steps", "low")).alias("whole"), F.max_by("b", -F.col("steps")).alias("end"))
    on = ranked.join(w, "last").withColumn("pos", F.col("whole.steps") - F.col("steps")).select("id", "a", "b", "last", "pos", F.col("whole.low").alias("low"), "end")
    # Cut at the smallest vertex between: arcs from it on are the run's second half.
    cut = on.where("a = low").select("last", F.col("pos").alias("_cut"))
    on = on.join(cut, "last", "left").withColumn("half", (F.col("_cut").isNotNull() & (F.col("pos") >= F.col("_cut"))).cast("int"))
    on = on.withColumn("run", F.col("last") * 2 + F.col("half")).withColumn("pos", F.col("pos") - F.when(F.col("half") == 1, F.col("_cut")).otherwise(0))
    on = materialise(on.select("id", "a", "b", "run", "pos"), "contour-runs")
    runs = on.groupBy("run").agg(F.count("*").alias("n"), F.min_by(F.struct("a", "b"), "pos").alias("f"), F.max_by(F.struct("a", "b"), "pos").alias("l"))
    runs = runs.select("run", "n", F.col("f.a").alias("a"), F.col("f.b").alias("first"), F.col("l.b").alias("b"), F.col("l.a").alias("before_end"))
    back = runs.select(F.col("run").alias("back"), F.col("a").alias("b"), F.col("first").alias("before_end"))
    runs = runs.join(back, ["b", "before_end"]).join(label.withColumnRenamed("node", "a"), "a")
    kept = runs.select("component", "a", "b", "first", "run", "back", "n").groupBy("component").applyInPandas(lambda p: _walk(p).assign(component=p["component"].iloc[0]), "run long, part int, start long, closed boolean, component long")
    kept = materialise(kept, "contour-paths")
    spots = on.join(kept, "run")
    places = spots.select("component", "part", "closed", (F.col("start") + F.col("pos")).alias("seq"), F.col("a").alias("v"))
    size = kept.join(runs.select("run", "n", F.col("b").alias("v")), "run").withColumn("_end", F.col("start") + F.col("n"))
    ends = size.groupBy("component", "part", "closed").agg(F.max(F.struct("_end", "v")).alias("e")).select("component", "part", "closed", F.col("e._end").alias("seq"), F.col("e.v").alias("v"))
    at = places.unionByName(ends).join(named("p", "v"), "v").join(named("l", "component"), "component")
    return at.select("p.level", "p.i", "p.j", F.col("l.i").alias("i2"), F.col("l.j").alias("j2"), "part", F.col("seq").cast("int").alias("seq"), "closed")


def assay_heatmap(points: DataFrame, measure: str, method: str = "idw", scale: str = "linear", lo: float = 0.0, hi: float = 100.0, power: float = 2.0, radius: float = 0.0, min_points: int = 3, max_points: int = 32, smoothness: int = 256, pad: float = 0.0) -> tuple[DataFrame, dict, DataFrame, DataFrame]:
    """(grid, spec, residuals, contours) of a measure of ``points(pid, x, y, <measure>)``: clipped, transformed, gridded, with leave-one-out residuals."""
    from .grids import grid_spec, interpolate_grid, make_grid
    from .ingest import percentile_clamp
    from .neighbours import leave_one_out
    from .stats import extent_2d

    p = percentile_clamp(points.select("pid", "x", "y", F.col(measure).cast("double").alias("v")).dropna(), "v", lo, hi)
    p = materialise(p.withColumn("v", scale_transform("v", scale)).dropna(), "heatmap-points")
    n = min(max(smoothness // 4, 48), 128)
    spec = grid_spec(extent_2d(p, pad), nx=n, ny=n)
    grid = materialise(interpolate_grid(make_grid(points.sparkSession, spec), p, method, power, radius, min_points, max_points), "heatmap")
    return grid, spec, leave_one_out(p, method, max_points, radius, min_points, power), iso_extract(grid, spec)


