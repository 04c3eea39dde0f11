"""Survey lines: rows of a line in their order, a line of any length (``scans``).

Operators put the rows in runs where they aren't already; rows given in runs
(by line and ``order``) keep that layout, so a chain of operators sorts once.
A null line is a line like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import PLACE, beside, in_runs, running_max, running_sum, with_carry
from .selection import keyed, selected
from .shared import materialise

#: Gradients of a line that a task puts in order as one array; longer lines go through radix selection.
WHOLE = 50_000


def along_track_distance(df: DataFrame, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """``df`` with along_m, the distance flown since the line's first row; a step from or to a row without coordinates counts 0."""
    d = beside(in_runs(df, [line], order or ["fid"]), ["x", "y"], "_b")
    step = F.hypot(F.col("x") - F.col("_b.x"), F.col("y") - F.col("_b.y"))
    return running_sum(d, step.cast("double"), "along_m").select(*df.columns, "along_m")


def order_violation_filter(df: DataFrame, line: str = "line", arrival: str = "fid", ts: str = "ts") -> DataFrame:
    """Rows not earlier than any kept before them in order of arrival; rows without time stay.

    What was kept last has the largest time so far, dropped rows lie below it,
    so the running maximum of all rows is that of the kept ones.
    """
    d = running_max(in_runs(df, [line], [arrival]), ts, "_m")
    return d.where(F.col(ts).isNull() | F.col("_m").isNull() | (F.col(ts) >= F.col("_m"))).select(*df.columns)


def _middle(df: DataFrame, column: str, line: str, name: str) -> DataFrame:
    """_line (struct of line) and the median of ``column``, of each line that has values."""
    return selected(keyed(df, column, [line]), [0.5], linear=True).select(F.col("g").alias("_line"), F.col("value").alias(name))


def _half(a: str) -> Column:
    """The median of a sorted array that isn't empty."""
    at = lambda i: F.get(a, F.expr(f"int({i})"))
    return F.when(F.size(a) % 2 == 1, at(f"size({a}) div 2")).otherwise(0.5 * at(f"size({a}) div 2 - 1") + 0.5 * at(f"size({a}) div 2"))


def _spikeless(d: DataFrame, line: str, sigma: float) -> DataFrame:
    """Rows of ``d(..., _grad)`` that ``despike`` keeps; one pass finds median and MAD of every line unless one is very long."""
    d = d.withColumn("_line", F.struct(line))
    if (d.groupBy("_line").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= WHOLE:
        a = d.where("_grad is not null").groupBy("_line").agg(F.sort_array(F.collect_list("_grad")).alias("a")).withColumn("_med", _half("a"))
        a = a.select("_line", "_med", F.sort_array(F.transform("a", lambda g: F.abs(g - F.col("_med")))).alias("a"))
        told = a.select("_line", "_med", _half("a").alias("_mad"))
    else:
        med = materialise(_middle(d, "_grad", line, "_med"), "medians")
        dev = d.join(med, "_line").select(line, F.abs(F.col("_grad") - F.col("_med")).alias("_dev"))
        told = med.join(_middle(dev, "_dev", line, "_mad"), "_line", "left")
    # Written, so that its size is known and a small one isn't joined by a shuffle of all rows.
    told = materialise(told, "spread-of-lines")
    most = F.abs("_med") + sigma * 1.4826 * F.greatest("_mad", F.lit(1e-9))
    return d.join(told, "_line", "left").where(F.col("_grad").isNull() | (F.abs("_grad") <= most))


def despike(df: DataFrame, line: str = "line", sigma: float = 6.0, order: list[str] | None = None) -> DataFrame:
    """Rows whose gradient to the row before is at most |median| + sigma * 1.4826 * MAD of their line's gradients."""
    d = beside(in_runs(df, [line], ["along_m", *(order or [])]), ["m", "along_m"], "_b")
    g = (F.col("m") - F.col("_b.m")) / F.greatest(F.col("along_m") - F.col("_b.along_m"), F.lit(1e-6))
    d = materialise(d.withColumn("_grad", g).select(*df.columns, "_grad"), "gradients")
    return _spikeless(d, line, sigma).select(*df.columns)


def clean_lines(df: DataFrame, sigma: float = 6.0, line: str = "line", arrival: str = "fid", ts: str = "ts") -> DataFrame:
    """``order_violation_filter``, then ``along_track_distance``, then ``despike``: rows that are in runs, with along_m.

    One shuffle by run serves all three. What goes from run to run is added row
    by row afterwards: a run's first and last rows tell how far the line had
    come before it.
    """
    w = Window.partitionBy("_g", "_run").orderBy("_at")
    d = running_max(in_runs(df, [line], [arrival]), ts, "_m").where(F.col(ts).isNull() | F.col("_m").isNull() | (F.col(ts) >= F.col("_m")))
    d = d.withColumn("_b", F.lag(F.struct("x", "y", "m")).over(w)).withColumn("_last", F.lead("_at").over(w).isNull())
    gone = lambda x, y, b: F.coalesce(F.hypot(x - b["x"], y - b["y"]).cast("double"), F.lit(0.0))
    d = d.withColumn("_in", F.sum(gone(F.col("x"), F.col("y"), F.col("_b"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_in_b", F.lag("_in").over(w))
    own = [*df.columns, *(c for c in PLACE if c not in df.columns)]
    d = materialise(d.select(*own, "_in", "_in_b", F.col("_b.m").alias("_m_b"), "_last"), "in-order")
    ends = d.where("_in_b is null").select("_g", "_run", "x", "y").join(d.where("_last").select("_g", "_run", F.struct("x", "y", "m", "_in").alias("_end")), ["_g", "_run"])
    g = Window.partitionBy("_g").orderBy("_run")
    ends = ends.withColumn("_b", F.lag("_end").over(g)).withColumn("_come", F.coalesce(F.col("_b._in"), F.lit(0.0)) + gone(F.col("x"), F.col("y"), F.col("_b")))
    ends = ends.withColumn("_base", F.sum("_come").over(g.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_base_b", F.lag("_base").over(g) + F.col("_b._in")).where("_b is not null")
    carry = materialise(ends.select("_g", "_run", "_base", "_base_b", F.col("_b.m").alias("_end_m")), "carry")
    d = with_carry(d, carry)
    base, first = F.coalesce("_base", F.lit(0.0)), F.col("_in_b").isNull()
    d = d.withColumn("along_m", F.col("_in") + base)
    before, m = F.when(first, F.col("_base_b")).otherwise(F.col("_in_b") + base), F.when(first, F.col("_end_m")).otherwise(F.col("_m_b"))
    d = d.withColumn("_grad", (F.col("m") - m) / F.greatest(F.col("along_m") - before, F.lit(1e-6)))
    return _spikeless(d, line, sigma).select(*own, "along_m")


def smooth_by_distance(df: DataFrame, window_m: float, line: str = "line") -> DataFrame:
    """m as the mean over rows within half a window before and after along the line; rows without along_m keep theirs.

    Rows at one place are added up first. Places are then cut into stretches of
    eight windows, each with the places half a window beyond its ends, so no
    task holds a line and the mean looks at distinct places only.
    """
    if window_m <= 0:
        return df
    half, stretch = window_m / 2, window_m * 8
    places = df.where("along_m is not null").groupBy(F.struct(line).alias("_line"), "along_m").agg(F.sum("m").alias("_s"), F.count("m").alias("_c"))
    own = F.floor(F.col("along_m") / stretch)
    near = F.sequence(F.floor((F.col("along_m") - half) / stretch), F.floor((F.col("along_m") + half) / stretch))
    p = places.withColumn("_own", own).withColumn("_part", F.explode(near))
    # Only SQL text takes fractional range bounds.
    over = f"over (partition by _line, _part order by along_m range between {half}D preceding and {half}D following)"
    p = p.select("_line", "along_m", "_own", "_part", F.expr(f"sum(_s) {over} / nullif(sum(_c) {over}, 0)").alias("_mean")).where("_own = _part")
    d = df.withColumn("_line", F.struct(line)).join(p.select("_line", "along_m", "_mean"), ["_line", "along_m"], "left")
    return d.withColumn("m", F.when(F.col("along_m").isNull(), F.col("m")).otherwise(F.col("_mean"))).select(*df.columns)


def resample_by_distance(df: DataFrame, spacing: float, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """Rows every ``spacing`` metres, x, y, z, m linear between the rows around, the rest from the earlier one."""
    if spacing <= 0:
        return df
    moved = ("along_m", "x", "y", "z", "m")
    d = beside(in_runs(df, [line], ["along_m", *(order or [])]), list(moved), "_next", step=1)
    end = F.coalesce(F.col("_next.along_m"), F.col("along_m"))
    first, last = F.ceil(F.col("along_m") / spacing), F.ceil(end / spacing) - 1
    # A span [a, b) owns the multiples in it; the line's last row owns its own place.
    last = F.when(F.col("_next.along_m").isNull(), F.floor(end / spacing)).otherwise(last)
    d = d.withColumn("_k", F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))))
    span = F.col("_next.along_m") - F.col("along_m")
    t = F.when(span > 0, (F.col("_k") * spacing - F.col("along_m")) / span).otherwise(F.lit(0.0))
    out = [(F.col("_k") * spacing).cast("double").alias(c) if c == "along_m" else F.coalesce(F.col(c) + t * (F.col(f"_next.{c}") - F.col(c)), F.col(c)).alias(c) if c in moved else F.col(c) for c in df.columns]
    return d.select(*out)


def decimate(df: DataFrame, pct: float = 100.0, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """First, last and every round(100 / pct)-th row of each line; lines of up to two rows stay."""
    stride = max(1, int(100 / pct + 0.5))
    if stride == 1:
        return df
    d = running_sum(in_runs(df, [line], ["along_m", *(order or [])]), F.lit(1), "_r")
    n = d.groupBy("_g").agg(F.max("_r").alias("_n"))
    keep = (F.col("_n") <= 2) | ((F.col("_r") - 1) % stride == 0) | (F.col("_r") == F.col("_n"))
    return d.join(n, "_g").where(keep).select(*df.columns)


def magnetic_report(rows: DataFrame, points: DataFrame) -> DataFrame:
    """rows, points, dropped, lines, m_min, m_max, m_mean, m_median."""
    a = rows.agg(F.count("*").alias("rows"))
    b = points.agg(F.count("*").alias("points"), F.countDistinct("line").alias("lines"), F.min("m").alias("m_min"), F.max("m").alias("m_max"), F.avg("m").alias("m_mean"))
    middle = selected(keyed(points, "m"), [0.5], linear=True).agg(F.max("value").alias("m_median"))
    return a.crossJoin(b).crossJoin(middle).select("rows", "points", (F.col("rows") - F.col("points")).alias("dropped"), "lines", "m_min", "m_max", "m_mean", "m_median")


