"""Exact ranks and percentiles by radix selection, for all rows or each group at once.

A double's bits, with negative ones turned round, order like whole numbers.
Each pass counts the values that share the bits found so far by their next 16
bits (counted map-side, at most 65 536 rows a group and pass) and tells in
which count each asked rank lies. After four passes all 64 bits are known; once
few rows are left under them, these are put in order directly (at once if no
group has more). One far-off value changes nothing, no task holds the values of
a larger group, and all asked ranks, and both neighbours of an interpolated
one, go through the same passes.

Nulls are left out; NaN is the largest value, as when Spark sorts; -0.0 is 0.0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Rows under the asked bits that are ordered directly.
FEW = 200_000
DIGIT = 16


def to_keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_keys(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _keyed(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``key``, the whole number of its double column ``value``; null for null."""

    def run(batches):
        for b in batches:
            v = b.column(value)
            keys = pa.array(to_keys(v.fill_null(0.0).to_numpy(zero_copy_only=False)), mask=v.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "key"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, key long")


def keyed(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """g (struct of ``by``), value, key of every row, written once: the input of ``selected``."""
    g = F.struct(*by) if by else F.lit(0)
    return materialise(_keyed(df.select(g.alias("g"), F.col(column).cast("double").alias("value")), "value"), "keyed")


def _prefix(bits: int) -> Column:
    """The key without its last ``bits`` bits."""
    return F.shiftright("key", bits) if bits < 64 else F.lit(0).cast("long")


def _in_order(rows: DataFrame, asked: DataFrame, known: int) -> DataFrame:
    """g, i, share and the key itself as prefix: the few rows under each asked prefix are put in order."""
    under = rows.withColumn("prefix", _prefix(known)).join(asked.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
    c = under.groupBy("g", "prefix", "key").agg(F.count("*").alias("k"))
    w = Window.partitionBy("g", "prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("before", F.sum("k").over(w) - F.col("k"))
    return asked.join(c, ["g", "prefix"]).where("rank >= before and rank < before + k").select("g", "i", "share", F.col("key").alias("prefix"))


def selected(rows: DataFrame, fractions: list[float], linear: bool = False) -> DataFrame:
    """g, i, value: of ``keyed`` rows, the value at each fraction i of each group.

    Nearest: the one at index floor((n - 1) * p + 0.5). Linear: between those
    around (n - 1) * p, by distance. A group without values has no rows.
    """
    rows = rows.select("g", "key").where("key is not null")
    asks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(fractions)))
    asked = rows.groupBy("g").agg(F.count("*").alias("n")).withColumn("a", F.explode(asks)).select("g", "a.i", ((F.col("n") - 1) * F.col("a.p")).alias("at"))
    if linear:
        ranks = F.array(F.struct(F.floor("at").alias("rank"), (F.floor("at") + 1 - F.col("at")).alias("share")), F.struct(F.ceil("at").alias("rank"), (F.col("at") - F.floor("at")).alias("share")))
        asked = asked.withColumn("r", F.explode(ranks)).where("r.share > 0").select("g", "i", "r.share", "r.rank")
    else:
        asked = asked.select("g", "i", F.lit(1.0).alias("share"), F.floor(F.col("at") + 0.5).alias("rank"))
    asked = asked.withColumn("prefix", F.lit(0).cast("long"))
    known = 64  # bits to the right of the prefix
    if (rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= FEW:
        asked, known = _in_order(rows, asked, known), 0  # groups may be many, but each is small
    while known:
        down, left = known - DIGIT, known
        under = rows.withColumn("prefix", _prefix(left))
        if left < 64:
            under = under.join(asked.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        counts = under.groupBy("g", "prefix", _prefix(down).alias("next")).agg(F.count("*").alias("c"))
        w = Window.partitionBy("g", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("before", F.sum("c").over(w) - F.col("c"))
        hit = asked.join(counts, ["g", "prefix"]).where("rank >= before and rank < before + c")
        found = materialise(hit.select("g", "i", "share", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("prefix"), "c"), "ranks")
        asked, known = found.drop("c"), down
        if known and (found.select("g", "prefix", "c").distinct().agg(F.sum("c")).first()[0] or 0) <= FEW:
            asked, known = _in_order(rows, asked, known), 0

    def decode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["g"], b["i"], b["share"], pa.array(from_keys(b["prefix"].to_numpy()))], names=["g", "i", "share", "value"])

    kind = rows.schema["g"].dataType.simpleString()
    found = asked.select("g", "i", "share", "prefix").mapInArrow(decode, f"g {kind}, i int, share double, value double")
    return found.groupBy("g", "i").agg((F.sum(F.col("share") * F.col("value")) if linear else F.max("value")).alias("value"))


def kth_values(df: DataFrame, column: str, fractions: list[float], linear: bool = False) -> list[float | None]:
    """The percentiles of a column over all rows; None without values."""
    found = {r["i"]: r["value"] for r in selected(keyed(df, column), fractions, linear).collect()}  # a row a fraction
    return [found.get(i) for i in range(len(fractions))]
