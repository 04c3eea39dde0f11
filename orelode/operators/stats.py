"""Extents, summaries, profiles, percentiles and other aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse_numeric, scale_transform
from .selection import keyed, kth_values, selected
from .shared import global_rank, materialise


def extent_2d(dfs: DataFrame | list[DataFrame], pad: float = 0.25, least: float = 1e-6) -> DataFrame:
    """xmin, xmax, ymin, ymax of all inputs' x, y; each span at least ``least``, widened by ``pad`` of it on each side."""
    dfs = dfs if isinstance(dfs, list) else [dfs]
    e = reduce(DataFrame.unionByName, [d.select("x", "y") for d in dfs]).agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))
    out = []
    for c in "xy":
        span = F.greatest(F.col(f"{c}max") - F.col(f"{c}min"), F.lit(least))
        out += [(F.col(f"{c}min") - pad * span).alias(f"{c}min"), (F.col(f"{c}min") + span + pad * span).alias(f"{c}max")]
    return e.where("xmin is not null").select(*out)


def extent_3d(df: DataFrame, pct: float = 0.05, pad_xy: float = 20.0, pad_z: float = 20.0) -> DataFrame:
    """Bounds with a share of the span and a fixed pad on each side; all null if an axis has no span."""
    e = df.agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    good = reduce(lambda a, b: a & b, [F.col(f"{c}max") > F.col(f"{c}min") for c in "xyz"])
    out = []
    for c, pad in (("x", pad_xy), ("y", pad_xy), ("z", pad_z)):
        by = (F.col(f"{c}max") - F.col(f"{c}min")) * pct + pad
        out += [F.when(good, F.col(f"{c}min") - by).alias(f"{c}min"), F.when(good, F.col(f"{c}max") + by).alias(f"{c}max")]
    return e.select(*out)


def collect_coordinates(dfs: list[DataFrame]) -> DataFrame:
    """x, y, z of every input: point columns, both ends of segments (x_from.., x_to..), and corners of bounds (xmin..)."""
    parts = []
    for d in dfs:
        z = lambda n, d=d: F.col(n) if n in d.columns else F.lit(None)
        if "x" in d.columns:
            parts.append(d.select("x", "y", z("z").cast("double").alias("z")))
        if "x_from" in d.columns:
            parts += [d.select(*(F.col(f"{c}_{e}").alias(c) for c in "xyz")) for e in ("from", "to")]
        if "xmin" in d.columns:
            parts += [d.select(F.col(f"x{a}").alias("x"), F.col(f"y{b}").alias("y"), z(f"z{a}").cast("double").alias("z")) for a in ("min", "max") for b in ("min", "max")]
    return reduce(DataFrame.unionByName, parts).where("x is not null and y is not null")


def aoi(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, margin: float = 25.0) -> DataFrame:
    """xmin, xmax, ymin, ymax, ring (closed, five corners), inferred_n, warning.

    ``bbox`` = (x0, y0, x1, y1) in any order wins; else the extent of ``df``
    widened by ``margin`` (percent if over 1); without points +-0.5 around 0.
    """
    e = df.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.count("x").alias("n"))
    share = margin / 100 if margin > 1 else margin
    if bbox:
        x0, y0, x1, y1 = bbox
        b = [F.lit(float(v)) for v in (min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1))]
        n, warning = F.lit(0).cast("long"), F.lit(None).cast("string")
    else:
        none = F.col("n") == 0
        w, h = F.greatest(F.col("b") - F.col("a"), F.lit(1e-6)), F.greatest(F.col("d") - F.col("c"), F.lit(1e-6))
        b = [F.when(none, lit).otherwise(v) for lit, v in ((-0.5, F.col("a") - share * w), (0.5, F.col("b") + share * w), (-0.5, F.col("c") - share * h), (0.5, F.col("d") + share * h))]
        n, warning = F.col("n"), F.when(none, "no coordinates; unit box used")
    out = e.select(*(v.alias(k) for k, v in zip(("xmin", "xmax", "ymin", "ymax"), b, strict=True)), n.alias("inferred_n"), warning.alias("warning"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return out.withColumn("ring", F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin")))


def geometry_bbox(df: DataFrame, ring: str = "ring") -> DataFrame:
    """``df`` with xmin, xmax, ymin, ymax of an array of points."""
    of = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return df.select("*", of(F.array_min, "x").alias("xmin"), of(F.array_max, "x").alias("xmax"), of(F.array_min, "y").alias("ymin"), of(F.array_max, "y").alias("ymax"))


def _long(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    return df.select(*(F.col(c).cast(kind).alias(c) for c in cols)).unpivot([], cols, "column", "value")


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, min, max, mean, count, in one pass."""
    return _long(df, cols, "double").groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count("value").alias("count"))


_MISSING = ("", "null", "na", "n/a")


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """n, missing (blank, null, na, n/a or no number), min, p05 .. p95 (nearest rank), max, mean of a text column.

    Numbers are parsed and written once; aggregates and percentiles read them from there.
    """
    v = keyed(df.select(parse_numeric(column).alias("v")), "v")
    names = ("p05", "p25", "p50", "p75", "p95")
    ps = selected(v, [0.05, 0.25, 0.5, 0.75, 0.95]).agg(*(F.max(F.when(F.col("i") == k, F.col("value"))).alias(n) for k, n in enumerate(names)))
    a = v.agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return a.crossJoin(ps).select("n", "missing", "min", *names, "max", "mean")  # one row each


def _kinds(df: DataFrame) -> DataFrame:
    v = _long(df, df.columns, "string").withColumn("t", F.trim("value"))
    low = F.lower("t")
    none = F.col("t").isNull() | low.isin(*_MISSING)
    number = ~none & parse_numeric("t").isNotNull()
    boolean = ~none & ~number & low.isin("true", "false", "yes", "no")
    return v.select("column", "t", none.alias("none"), number.alias("number"), boolean.alias("boolean"))


def type_profile(df: DataFrame) -> DataFrame:
    """column, null_like, numeric, bool, text, type (the most frequent kind, numbers first), samples (the three smallest values)."""
    k = _kinds(df).groupBy("column").agg(
        F.count_if("none").alias("null_like"), F.count_if("number").alias("numeric"), F.count_if("boolean").alias("bool"),
        F.count_if(~F.col("none") & ~F.col("number") & ~F.col("boolean")).alias("text"),
    )
    few = _kinds(df).where("not none").select("column", "t").distinct()
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("t"))).where("r <= 3")
    samples = few.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("t")), " | ").alias("samples"))
    most = F.greatest("numeric", "bool", "text")
    kind = F.when(most == 0, "empty").when(F.col("numeric") == most, "number").when(F.col("bool") == most, "boolean").otherwise("text")
    return k.withColumn("type", kind).join(samples, "column", "left")


#: Words in a column's name that suggest a measure.
MEASURE_WORDS = ("au", "gold", "cu", "copper", "zn", "zinc", "pb", "lead", "ag", "silver", "grade", "ppm", "ppb", "pct", "%", "value", "assay")


def measure_ranking(df: DataFrame, k: int = 10) -> DataFrame:
    """column, score, numeric_ratio, name_score, non_empty: 0.7 * share of numbers + 0.3 * 0.12 per telling word in the name; the best ``k``."""
    g = _kinds(df).groupBy("column").agg(F.count_if("number").alias("num"), F.count_if(~F.col("none")).alias("non_empty"))
    ratio = F.coalesce(F.try_divide(F.col("num"), F.col("non_empty")), F.lit(0.0))
    name = F.least(sum((F.when(F.lower("column").contains(w), F.lit(0.12)).otherwise(F.lit(0.0)) for w in MEASURE_WORDS), F.lit(0.0)), F.lit(1.0))
    score = F.round(0.7 * ratio + 0.3 * name, 3)
    return g.select("column", score.alias("score"), ratio.alias("numeric_ratio"), name.alias("name_score"), "non_empty").orderBy(F.desc("score"), "column").limit(k)


def table_profile(df: DataFrame, order: list[str], n: int = 12) -> DataFrame:
    """part (head or tail), row_no, and the row as JSON, for the first and last ``n`` rows; plus one row part = count.

    Two top-n sorts and a count, no full sort; rows that are equal in ``order``
    come in any order. Of fewer than ``n`` rows all are in both parts.
    """
    total = df.agg(F.count("*").alias("_n"))
    whole = F.to_json(F.struct(*df.columns)).alias("values")
    up, down = [F.asc(c) for c in order], [F.desc(c) for c in order]
    place = lambda by: F.row_number().over(Window.orderBy(*by)).cast("long")  # noqa: E731 (of n rows)
    head = df.orderBy(*up).limit(n).select(F.lit("head").alias("part"), (place(up) - 1).alias("row_no"), whole)
    tail = df.orderBy(*down).limit(n).select(place(down).alias("_k"), whole).crossJoin(F.broadcast(total))  # one row
    tail = tail.select(F.lit("tail").alias("part"), (F.col("_n") - F.col("_k")).alias("row_no"), "values")
    return head.unionByName(tail).unionByName(total.select(F.lit("count").alias("part"), F.col("_n").alias("row_no"), F.lit(",".join(df.columns)).alias("values")))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """from, to, count: equal bins, the largest value in the last; one bin if all are equal."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    e = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    e = e.withColumn("k", F.when(F.col("hi") > F.col("lo"), F.lit(bins)).otherwise(F.lit(1))).withColumn("step", (F.col("hi") - F.col("lo")) / F.col("k"))
    one = F.broadcast(e)  # one row
    b = F.when(F.col("step") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")), F.col("k") - 1)).otherwise(F.lit(0))
    counts = v.crossJoin(one).groupBy(b.cast("int").alias("b")).agg(F.count("*").alias("count"))
    every = e.select("lo", "step", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("b"))
    return every.join(counts, "b", "left").select((F.col("lo") + F.col("b") * F.col("step")).alias("from"), (F.col("lo") + (F.col("b") + 1) * F.col("step")).alias("to"), F.coalesce("count", F.lit(0)).alias("count"))


def fit_residual_metrics(df: DataFrame, residual: str = "residual") -> DataFrame:
    r = F.col(residual)
    return df.agg(F.count(r).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("bias"))


def median_mad(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, median, mad: exact medians (mean of the middle two), the deviation at least 1e-9; groups without values have no median.

    Medians come from radix selection, so a group may be of any size; nulls in
    ``by`` are a group.
    """
    rows = df.select(F.struct(*by).alias("g"), F.col(column).cast("double").alias("_v"))
    middle = selected(keyed(df, column, by), [0.5], linear=True).select("g", F.col("value").alias("median"))
    middle = materialise(rows.select("g").distinct().join(middle, "g", "left"), "medians")
    off = rows.join(middle, "g").select("g", F.abs(F.col("_v") - F.col("median")).alias("_d"))
    mad = selected(keyed(off, "_d", ["g"]), [0.5], linear=True).select("g.g", F.col("value").alias("_mad"))
    return middle.join(mad, "g", "left").select("g.*", "median", F.greatest("_mad", F.lit(1e-9)).alias("mad"))


def percentile_nearest_rank(df: DataFrame, column: str, p: float, by: list[str] | None = None) -> DataFrame:
    """value at index round((n - 1) * p) of the sorted values, half away from zero; of each group that has values, or of all rows."""
    if not by:
        return df.sparkSession.createDataFrame([(kth_values(df, column, [p])[0],)], "value double")
    return selected(keyed(df, column, by), [p]).select("g.*", "value")


def percentile_linear(df: DataFrame, column: str, p: float, by: list[str] | None = None) -> DataFrame:
    """value between those around index (n - 1) * p; of each group that has values, or of all rows."""
    if not by:
        return df.sparkSession.createDataFrame([(kth_values(df, column, [p], linear=True)[0],)], "value double")
    return selected(keyed(df, column, by), [p], linear=True).select("g.*", "value")


def measure_domain(dfs: list[DataFrame], measure: str, mode: str = "linear", lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """lo, hi: linear percentiles of a transformed measure over several inputs."""
    v = reduce(DataFrame.unionByName, [d.select(scale_transform(F.col(measure).cast("double"), mode).alias("v")) for d in dfs])
    return selected(keyed(v, "v"), [lo, hi], linear=True).agg(*(F.max(F.when(F.col("i") == k, F.col("value"))).alias(n) for k, n in enumerate(("lo", "hi"))))


def scene_qa(features: DataFrame, bounds: DataFrame, project_epsg: int, has_terrain: bool = False) -> DataFrame:
    """check, count over ``features(kind, x, y, z, epsg)``: outside_bounds by kind, wrong_epsg, missing_z."""
    j = features.crossJoin(F.broadcast(bounds.select("xmin", "xmax", "ymin", "ymax").limit(1)))  # one row
    outside = (F.col("x") < F.col("xmin")) | (F.col("x") > F.col("xmax")) | (F.col("y") < F.col("ymin")) | (F.col("y") > F.col("ymax"))
    checks = F.array(
        F.struct(F.concat(F.lit("outside_bounds_"), F.col("kind")).alias("check"), outside.alias("bad")),
        F.struct(F.lit("wrong_epsg").alias("check"), (F.col("epsg") != project_epsg).alias("bad")),
        F.struct(F.lit("missing_z").alias("check"), (F.col("z").isNull() & F.lit(not has_terrain)).alias("bad")),
    )
    return j.select(F.explode(checks).alias("c")).groupBy("c.check").agg(F.count_if("c.bad").alias("count"))


def grid_stats(grid: DataFrame, column: str = "v") -> DataFrame:
    return grid.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"))


def column_inventory(df: DataFrame, attributes: str = "attrs") -> DataFrame:
    """column: the distinct keys of a map column."""
    return df.select(F.explode(F.map_keys(attributes)).alias("column")).distinct()


def preview_sample(df: DataFrame, order: list[str], max_rows: int) -> DataFrame:
    """Every ceil(n / max_rows)-th row in order."""
    r = global_rank(df, *order)
    total = r.agg(F.count("*").alias("_n"))
    j = r.crossJoin(F.broadcast(total))  # one row
    return j.where(F.col("_rank") % F.greatest(F.ceil(F.col("_n") / max_rows), F.lit(1)) == 0).select(*df.columns)


def head_tail(df: DataFrame, order: list[Column | str], n: int = 8) -> DataFrame:
    """The first and last ``n`` rows in order, with part; two top-n sorts, no full one."""
    up = [F.col(c) if isinstance(c, str) else c for c in order]
    head = df.orderBy(*(c.asc() for c in up)).limit(n).withColumn("part", F.lit("head"))
    return head.unionByName(df.orderBy(*(c.desc() for c in up)).limit(n).withColumn("part", F.lit("tail")))


def sort_limit(df: DataFrame, column: str, n: int = 3000, tie: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by a numeric column, rows without a number last."""
    return df.orderBy(parse_numeric(column).asc_nulls_last(), *(tie or [])).limit(n)
