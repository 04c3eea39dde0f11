"""Scans along the ordered rows of a group, however many rows the group has.

A window over a group is one task. Here all rows are put in order of group and
place by one range shuffle, so a long group lies in several runs (a run is the
part of a group within one range). Windows then work within a run, and what a
run hands to the next one (its last row, its sum, its maximum) comes from a
table with one small row a run, where the runs of a group are put in order.
Only the first group of a range can have a run before, so what is handed on is
at most one row a range, whatever the groups, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Columns of rows in runs: the group, its run, the place in the order of all rows.
PLACE = ("_g", "_run", "_at")
_RUN = ["_g", "_run"]


def in_runs(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` with _g, _run and _at, written once; rows that are in runs already stay as they are.

    A null is a group like any other. Rows that are equal in group and order
    lie in one run, in any order.
    """
    if set(PLACE) <= set(df.columns):
        return df
    keys = [*by, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return materialise(rows.withColumn("_g", F.struct(*by)).withColumn("_run", F.shiftright("_at", 33)), "runs")


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``carry(_g, _run, ...)``, a row for each run that another run precedes (or follows): at most one a range."""
    return rows.join(F.broadcast(carry), _RUN, "left")


def beside(rows: DataFrame, columns: list[str], name: str, step: int = -1) -> DataFrame:
    """``rows`` with ``name``, a struct of ``columns`` in the row before (or after, with step 1) in the group; null where there is none."""
    shift, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    one = F.struct(*columns)
    edges = rows.groupBy(*_RUN).agg(edge(one, "_at").alias("_edge"))
    edges = edges.select(*_RUN, shift("_edge").over(Window.partitionBy("_g").orderBy("_run")).alias("_edge"))
    inner = rows.withColumn(name, shift(one).over(Window.partitionBy(*_RUN).orderBy("_at")))
    return with_carry(inner, edges.where("_edge is not null")).withColumn(name, F.coalesce(name, "_edge")).drop("_edge")


def running_sum(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` (null: 0) over the group's rows up to this one."""
    rows = rows.withColumn(name, F.coalesce(value, F.lit(0)))
    totals = rows.groupBy(*_RUN).agg(F.sum(name).alias("_carry"))
    before = Window.partitionBy("_g").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*_RUN, F.sum("_carry").over(before).alias("_carry")).where("_carry is not null")
    inner = rows.withColumn(name, F.sum(name).over(Window.partitionBy(*_RUN).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    return with_carry(inner, totals).withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def running_max(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` of the group's rows before this one; null where there is none."""
    tops = rows.groupBy(*_RUN).agg(F.max(value).alias("_carry"))
    before = Window.partitionBy("_g").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*_RUN, F.max("_carry").over(before).alias("_carry")).where("_carry is not null")
    inner = rows.withColumn(name, F.max(value).over(Window.partitionBy(*_RUN).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)))
    return with_carry(inner, tops).withColumn(name, F.greatest(name, "_carry")).drop("_carry")
