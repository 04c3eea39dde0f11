"""Reading one large text file by many tasks when places in it matter.

Spark cuts a text file into byte ranges and gives each row the start of its
range (``_metadata.file_block_start``). What comes before a row is then known
from two sums: one over whole ranges, of which there are few, and one over the
rows of its own range. Values of a grid are numbered that way; JSON, cut at
every ``}``, learns whether a range begins inside a string, how deep and in
which array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import materialise


def pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """value, file, start, no: rows of text in the order of file names, byte ranges and rows; ``separator`` is a line end else."""
    read = spark.read.option("recursiveFileLookup", "true")
    raw = (read.option("lineSep", separator) if separator else read).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"))


def before(rows: DataFrame, amount: str, name: str, by_file: bool = False) -> DataFrame:
    """``rows`` with the sum of a column over all rows before (of the same file, if ``by_file``).

    The sums of ranges are a row each; a range's rows are one window.
    """
    file = ["file"] if by_file else []
    ranges = rows.groupBy("file", "start").agg(F.sum(amount).alias("_sum"))
    w = (Window.partitionBy(*file) if file else Window.partitionBy(F.lit(0))).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "start", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    own = F.sum(amount).over(Window.partitionBy("file", "start").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(ranges, ["file", "start"]).withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_base")


#: Bytes that structure JSON: 1 a quote, 2 and 3 opening, 4 closing.
_KIND = np.zeros(256, np.uint8)
for _byte, _kind in ((b'"', 1), (b"{", 2), (b"[", 3), (b"}", 4), (b"]", 4)):
    _KIND[_byte[0]] = _kind


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The pieces one after another, each with the brace it was cut at, and where each begins."""
    whole = pc.binary_join_element_wise(column.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"}", pa.large_binary()))
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return whole.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(whole) else b"", at - at[0]


def _brackets(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """place, kind and change of depth of the brackets outside strings, and whether the text ends in a string."""
    plain = re.sub(rb"\\.", b"__", text, flags=re.DOTALL) if b"\\" in text else text  # escaped characters neither open nor close
    kinds = _KIND[np.frombuffer(plain, np.uint8)]
    place = np.flatnonzero(kinds)
    kind = kinds[place]
    quotes = np.cumsum(kind == 1) + inside
    real = (kind != 1) & (quotes % 2 == 0)
    place, kind = place[real], kind[real]
    return place, kind, np.where(kind == 4, -1, 1), bool((quotes[-1] if len(quotes) else inside) % 2)


def _named(text: bytes, place: int, key: str) -> bool:
    """Whether the bracket at this place opens the array called ``key`` (any array, without one)."""
    if text[place : place + 1] != b"[":
        return False
    return not key or re.search(rb'(?<!\\)"' + re.escape(key.encode()) + rb'"\s*:\s*$', text[max(0, place - 4096) : place]) is not None


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch in parts of one byte range each."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield (int(file[lo]), int(start[lo])), batch.slice(lo, hi - lo)


def _range_sums(key: str):
    """Task: per byte range the parity of its quotes, and for a begin outside (0) and inside (1) a string the change of depth and, by relative depth, whether the last bracket opened there is the array ``key``."""

    def run(batches):
        at, sums = None, None

        def row():
            (file, start), (quotes, ups, opened) = at, sums
            return pa.RecordBatch.from_pylist([{"file": file, "start": start, "odd": quotes % 2, **{f"up{k}": ups[k] for k in (0, 1)}, **{f"opened{k}": list(opened[k].items()) for k in (0, 1)}}], _SUMS)

        for batch in batches:
            for place_of, part in _by_range(batch):
                if place_of != at:
                    if at is not None:
                        yield row()
                    at, sums = place_of, [0, [0, 0], [{}, {}]]
                text, _ = _joined(part.column("value"))
                quotes, ups, opened = sums
                for k in (0, 1):  # the case k began k quotes later than the case 0
                    place, kind, step, ends = _brackets(text, bool((quotes + k) % 2))
                    if not k:
                        odd = ends
                    depth = ups[k] + np.cumsum(step)
                    up = np.flatnonzero(kind != 4)
                    levels, last = np.unique(depth[up][::-1], return_index=True)
                    opened[k].update((int(d), _named(text, int(place[up[len(up) - 1 - i]]), key)) for d, i in zip(levels, last))
                    ups[k] = int(depth[-1]) if len(depth) else ups[k]
                sums[0] = int(odd)
        if at is not None:
            yield row()

    return run


_OPENED = pa.map_(pa.int64(), pa.bool_())
_SUMS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("odd", pa.int64()), ("up0", pa.int64()), ("up1", pa.int64()), ("opened0", _OPENED), ("opened1", _OPENED)])
_SUMS_DDL = "file long, start long, odd long, up0 long, up1 long, opened0 map<long, boolean>, opened1 map<long, boolean>"


def _objects(depth: int, key: str):
    """Task: objects in order of their ranges, each range begun as its sums before say; part 0 is a whole object, 1 begins one, 2 goes on, 3 ends it."""

    def run(batches):
        at, inside, level, wanted = None, False, 0, False
        begun: list[bytes] | None = None  # what is there of the object that is open
        head = False  # and whether it began in a range before

        def left(out):
            if begun is not None:
                out.append((b"".join(begun), 2 if head else 1, *at))

        for batch in batches:
            out: list[tuple] = []
            for place_of, part in _by_range(batch):
                if place_of != at:
                    left(out)
                    first = part.slice(0, 1).to_pylist()[0]
                    if first["inside"] is None:
                        raise RuntimeError("byte ranges changed between two reads of a file")
                    at, inside, level, wanted = place_of, bool(first["inside"]), first["level"], first["wanted"]
                    head = level >= depth and wanted
                    begun = [] if head else None
                text, _ = _joined(part.column("value"))
                place, kind, step, inside = _brackets(text, inside)
                after = level + np.cumsum(step)
                level = int(after[-1]) if len(after) else level
                # What matters: brackets around the objects, and the objects' own.
                near = np.flatnonzero(((after <= depth) & (kind != 4)) | ((after == depth - 1) & (kind == 4)))
                from_ = 0
                for p, k, d in zip(place[near].tolist(), kind[near].tolist(), after[near].tolist(), strict=True):
                    if k == 4:
                        if begun is not None and text[p : p + 1] == b"}":
                            begun.append(text[from_ : p + 1])
                            out.append((b"".join(begun), 3 if head else 0, *at))
                        begun, head = None, False
                    elif d == depth:
                        if k == 2 and (wanted or depth == 1):
                            begun, head, from_ = [], False, p
                    elif d == depth - 1:
                        wanted = _named(text, p, key)
                if begun is not None:
                    begun.append(text[from_:])
            if out:
                yield _rows(out)
        if at is not None:
            out = []
            left(out)
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    value, part, file, start = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(value, pa.binary()).cast(pa.string()), pa.array(part, pa.int32()), pa.array(file, pa.int64()), pa.array(start, pa.int64())], names=["value", "part", "file", "start"])


def json_objects(spark: SparkSession, path: str, depth: int, key: str = "") -> DataFrame:
    """value: the text of every object that lies ``depth`` brackets deep (itself included) in JSON of any layout.

    Files are cut at ``}`` and read twice, each time as a stream: first for what
    every byte range hands on (if it ends in a string, how deep, in which
    array), a small row a range, then for the objects. No row is sorted and a
    task holds one batch and the object it is in; objects that lie across
    ranges are put together from one row a range. With ``key`` only the objects
    of the array of that name in the root count, else (for ``depth`` 2 and
    more) those of any array.
    """
    rows = pieces(spark, path, "}").select("value", F.xxhash64("file").alias("file"), "start")
    ranges = rows.mapInArrow(_range_sums(key), _SUMS_DDL)
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2)
    pick = lambda c: F.when(F.col("inside") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    ranges = ranges.select("file", "start", "inside", pick("up").alias("up"), pick("opened").alias("opened"))
    ranges = ranges.withColumn("level", F.coalesce(F.sum("up").over(w), F.lit(0)))
    last = F.last(F.try_element_at("opened", F.lit(depth - 1) - F.col("level")), ignorenulls=True).over(w)
    ranges = ranges.select("file", "start", "inside", "level", F.coalesce(F.lit(True) if depth == 1 else last, F.lit(False)).alias("wanted"))
    found = rows.join(F.broadcast(ranges), ["file", "start"], "left").mapInArrow(_objects(depth, key), "value string, part int, file long, start long")
    found = materialise(found, "json-objects")
    # The end of an object comes before the next one's begin in a range.
    order = Window.partitionBy("file").orderBy("start", F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where("part > 0").withColumn("_object", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order))
    whole = parts.groupBy("file", "_object").agg(F.array_sort(F.collect_list(F.struct("start", "part", "value"))).alias("p"))
    # What follows an object's end without a begin is no object.
    whole = whole.withColumn("_end", F.array_position(F.col("p.part"), 3).cast("int")).where("_end > 1 and p[0].part = 1")
    whole = whole.select(F.array_join(F.slice("p.value", F.lit(1), F.col("_end")), "").alias("value"))
    return found.where("part = 0").select("value").unionByName(whole).select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value"))
