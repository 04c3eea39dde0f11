"""Helpers for operators: scratch tables, and ranks without a global window."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCAL: dict[str, str] = {}  # by application: the temporary folder of a local session


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local session names none (one machine, as in tests) a temporary
    one is chosen; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        at = _LOCAL.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _LOCAL[app] = at
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the folder of ``spark.checkpoint.dir`` and read again; the write's shuffle files go with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a key's partition that a task sorts at once.
SPREAD = 250_000


def spread(df: DataFrame, key: str, rows: int = SPREAD) -> DataFrame:
    """``df`` as it is, or dealt by ``key`` over more tasks where the session's number of shuffle partitions would give each over ``rows``.

    Windows and joins on the key keep that number, so what a task sorts doesn't
    grow with the table. The count reads no column.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def global_rank(df: DataFrame, *order: str | Column, name: str = "_rank") -> DataFrame:
    """``df`` with a 0-based rank over all rows: a range shuffle, counts per partition, offsets.

    The sorted rows are written once, so ranks and counts see the same ranges.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = materialise(rows, "ranked")
    pid = F.shiftright("_m", 33)
    counts = rows.groupBy(pid.alias("_p")).agg(F.count("*").alias("_c"))  # one small row per partition
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    out = rows.withColumn("_p", pid).join(F.broadcast(before), "_p")
    return out.withColumn(name, F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_m", "_b")
