"""Helpers that several operators share: words, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import connected_components, roots  # noqa: F401
from ..operators.shared import scratch_dir

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def words_of(text: str) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]`` in UTF-8; ``bytes.split`` uses exactly that class."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    The write's own shuffle files go when it ends (nothing reads them again),
    so a chain of steps needs the disk of its largest step, not of all.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if (notes := _NOTES.get()) is not None:
        notes.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_NOTES: ContextVar[list[str] | None] = ContextVar("notes", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that ``materialise`` writes within the block, in this thread only."""
    notes: list[str] = []
    before = _NOTES.set(notes)
    try:
        yield notes
    finally:
        _NOTES.reset(before)


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared store; those that are gone already are no error."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, once all that is made of them is written itself."""
    for t in tables:
        delete_folders(t.sparkSession, [t.scratch_path])


def slices(batches, rows: int = 500):
    """The Arrow batches of a task in pieces of at most ``rows`` rows, so that long texts are few at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def long_rows(df: DataFrame, most: int = 1000) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``most`` rows: whole texts in batches of 10 000 take
    hundreds of MB in the JVM and in each worker. A smaller setting of the user's stays.
    """
    if not 0 < int(df.sparkSession.conf.get(_BATCH)) <= most:
        df.sparkSession.conf.set(_BATCH, str(most))
    return df


def first_by_hash(df: DataFrame, key: Column, n: int, *ties: str | Column) -> list:
    """The ``n`` rows of ``df`` with the lowest hashes ``key`` (64 bits), ties by ``ties``, as ``orderBy().limit()`` gives them.

    Tasks send only rows below a bound that about ``n`` rows pass, not ``n`` rows each; should
    fewer pass, the bound is raised until there are enough. ``df`` is read twice or more.
    """
    total, share = df.count(), 1.0
    if total > 2 * n:
        share = (n + 6 * n**0.5 + 16) / total
    while True:
        bound = F.lit(min(int(share * 2.0**64) - 2**63, 2**63 - 1)).cast("long")
        found = df.where(key <= bound).orderBy(key, *ties).limit(n).collect()
        if len(found) == min(n, total) or share >= 1.0:
            return found
        share *= 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
