"""Drill holes: geometry from surveys, intervals on it, compositing."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import require_columns


def drillhole_merge(parts: list[DataFrame]) -> DataFrame:
    """Bag union of shards of one table; columns that a shard lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def desurvey_join(collars: DataFrame, surveys: DataFrame) -> DataFrame:
    """Collars with their survey stations; holes without a survey stay."""
    return collars.join(surveys, "hole_id", "left")


def desurvey(collars: DataFrame, surveys: DataFrame, dip_positive_down: bool = False) -> DataFrame:
    """hole_id, depth_from, depth_to, x_from .. z_to: one segment per station.

    Positions are running sums of the steps from the collar, in one window per
    hole. A hole without stations gets a vertical segment of 1 m.
    """
    require_columns(collars, "hole_id", "x", "y", "z")
    require_columns(surveys, "hole_id", "depth_m", "azimuth_deg", "dip_deg")
    keep = ["epsg"] if "epsg" in collars.columns else []
    j = desurvey_join(collars.select("hole_id", "x", "y", "z", *keep), surveys.select("hole_id", "depth_m", "azimuth_deg", "dip_deg"))
    w = Window.partitionBy("hole_id").orderBy("depth_m", "azimuth_deg", "dip_deg")
    j = j.withColumn("depth_from", F.lag("depth_m", 1, 0.0).over(w))
    step, dip, az = F.col("depth_m") - F.col("depth_from"), F.radians("dip_deg"), F.radians("azimuth_deg")
    sign = -1.0 if dip_positive_down else 1.0
    j = j.withColumn("dx", step * F.cos(dip) * F.sin(az)).withColumn("dy", step * F.cos(dip) * F.cos(az)).withColumn("dz", sign * step * F.sin(dip))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for c in "xyz":
        j = j.withColumn(f"{c}_to", F.col(c) + F.sum(f"d{c}").over(run)).withColumn(f"{c}_from", F.col(f"{c}_to") - F.col(f"d{c}"))
    none = F.col("depth_m").isNull()
    pick = lambda plain, other: F.when(none, plain).otherwise(other)
    return j.select(
        "hole_id", pick(F.lit(0.0), F.col("depth_from")).alias("depth_from"), pick(F.lit(1.0), F.col("depth_m")).alias("depth_to"),
        *(pick(F.col(c), F.col(f"{c}_from")).alias(f"{c}_from") for c in "xyz"),
        *(pick(F.col(c) - (1.0 if c == "z" else 0.0), F.col(f"{c}_to")).alias(f"{c}_to") for c in "xyz"), *keep,
    )


def segment_index(segments: DataFrame) -> DataFrame:
    """``segments`` with idx, 0-based per hole by depth."""
    return segments.withColumn("idx", F.row_number().over(Window.partitionBy("hole_id").orderBy("depth_from", "depth_to")) - 1)


def segment_assay_overlap(segments: DataFrame, assays: DataFrame) -> DataFrame:
    """Segments with the assays whose interval overlaps theirs (open ends); segments without any stay."""
    a = assays.withColumnRenamed("hole_id", "_h")
    on = (segments["hole_id"] == a["_h"]) & (a["to_m"] > segments["depth_from"]) & (a["from_m"] < segments["depth_to"])
    return segments.join(a, on, "left").drop("_h")


def assay_points(segments: DataFrame, assays: DataFrame) -> DataFrame:
    """Each assay's midpoint on its hole: the first segment in depth order that holds it, linear in between."""
    a = assays.withColumn("depth_m", (F.col("from_m") + F.col("to_m")) * 0.5)
    s = segments.select(F.col("hole_id").alias("_h"), "depth_from", "depth_to", *(f"{c}_{e}" for c in "xyz" for e in ("from", "to")))
    j = a.join(s, (a["hole_id"] == s["_h"]) & (F.col("depth_from") <= F.col("depth_m")) & (F.col("depth_m") <= F.col("depth_to")))
    # An assay's matches are few; min over a struct needs no window and has map-side partials.
    keys = assays.columns + ["depth_m"]
    best = j.groupBy(*keys).agg(F.min(F.struct("depth_from", "depth_to", *(f"{c}_{e}" for c in "xyz" for e in ("from", "to")))).alias("s"))
    span = F.col("s.depth_to") - F.col("s.depth_from")
    t = F.when(span > 0, (F.col("depth_m") - F.col("s.depth_from")) / span).otherwise(F.lit(0.0))
    return best.select(*keys, *((F.col(f"s.{c}_from") + t * (F.col(f"s.{c}_to") - F.col(f"s.{c}_from"))).alias(c) for c in "xyz"))


def assays_with_known_hole(assays: DataFrame, segments: DataFrame, anti: bool = False) -> DataFrame:
    """Assays whose hole has segments, or with ``anti`` the orphans."""
    return assays.join(segments.select("hole_id").distinct(), "hole_id", "left_anti" if anti else "left_semi")


def segment_measures(overlap: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """hole_id, idx, field, value: means of numeric fields; the most frequent text (ties: the smallest) where a segment has no number."""
    keys = ["hole_id", "idx"]
    means = overlap.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in numeric))
    number = means.unpivot(keys, numeric, "field", "value").where("value is not null").select(*keys, "field", F.col("value").cast("string").alias("value"))
    if not text:
        return number
    bare = means.where(" and ".join(f"`{c}` is null" for c in numeric) or "true").select(*keys)
    long = overlap.join(bare, keys, "left_semi").unpivot(keys, text, "field", "value").where("value is not null")
    counts = long.groupBy(*keys, "field", "value").agg(F.count("*").alias("n"))
    mode = counts.groupBy(*keys, "field").agg(F.min(F.struct(-F.col("n"), "value")).alias("m")).select(*keys, "field", F.col("m.value").alias("value"))
    return number.unionByName(mode)


def trace_polylines(segments: DataFrame) -> DataFrame:
    """hole_id, vertices: the hole's path as an ordered array of points."""
    ends = segments.select("hole_id", F.explode(F.array(F.struct(F.col("depth_from").alias("depth"), F.col("x_from").alias("x"), F.col("y_from").alias("y"), F.col("z_from").alias("z")), F.struct(F.col("depth_to").alias("depth"), F.col("x_to").alias("x"), F.col("y_to").alias("y"), F.col("z_to").alias("z")))).alias("p"))
    return ends.groupBy("hole_id").agg(F.array_sort(F.collect_set("p")).alias("vertices"))


def _composite_numbers(samples: DataFrame, length: float) -> DataFrame:
    """``samples``, sorted by hole, with p (place in the hole) and k (its composite): a sum that starts again once it reaches ``length``.

    A task streams its sorted rows; the sum so far is carried from one Arrow
    batch to the next, so a hole of any size takes the memory of one batch.
    """

    def run(batches):
        hole, p, k, total = None, 0, 0, 0.0
        for b in batches:
            ps, ks = [], []
            for own, support in zip(b.column("hole_id").to_pylist(), b.column("support_m").to_pylist(), strict=True):
                if own != hole:
                    hole, p, k, total = own, 0, 0, 0.0
                ps.append(p)
                ks.append(k)
                p, total = p + 1, total + max(support, 1e-6)
                if total >= length:
                    k, total = k + 1, 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ps, pa.int64()), pa.array(ks, pa.int64())], names=[*b.schema.names, "p", "k"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInArrow(run, f"{fields}, p long, k long")


def composite_intervals(samples: DataFrame, length: float = 0.0) -> DataFrame:
    """Greedy composites of at least ``length`` per hole, in depth order, never splitting a sample.

    ``samples(hole_id, from_m, to_m, depth_m, x, y, z, v, sg)``; support is
    to - from, 1 where that isn't positive. A composite closes as soon as its
    support reaches the length; the rest of a hole is one more. Rows are sorted
    by hole and depth and numbered in a stream; the weighted means are then a
    plain aggregate. Rows without a hole, and holes of one row, pass through.
    """
    support = F.when(F.col("to_m") - F.col("from_m") > 0, F.col("to_m") - F.col("from_m")).otherwise(F.lit(1.0))
    s = samples.withColumn("support_m", support.cast("double"))
    out = ["hole_id", "from_m", "to_m", "depth_m", "x", "y", "z", "v", "sg", "support_m"]
    if length <= 0:
        return s.select(*out)
    loose = s.where("hole_id is null").select(*out)
    sorted_ = s.where("hole_id is not null").select(*out).repartition("hole_id").sortWithinPartitions("hole_id", F.coalesce("from_m", "depth_m"), *out[1:])
    each = _composite_numbers(sorted_, length)
    w = F.greatest("support_m", F.lit(1e-6))
    first, last = (lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("p")))), (lambda c: F.max_by(c, "p"))
    grouped = each.groupBy("hole_id", "k").agg(
        first("from_m").alias("from_m"), F.max_by(F.coalesce("to_m", "depth_m"), "p").alias("to_m"),
        first("depth_m").alias("d0"), last("depth_m").alias("d1"),
        *((F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("x", "y", "z", "v")),
        F.try_divide(F.sum(F.when(F.col("sg").isNotNull(), F.col("sg") * w)), F.sum(F.when(F.col("sg").isNotNull(), w))).alias("sg"),
        F.sum(w).alias("support_m"),
    )
    return grouped.withColumn("depth_m", F.coalesce((F.col("d0") + F.col("d1")) / 2, F.col("d0"))).select(*out).unionByName(loose)
