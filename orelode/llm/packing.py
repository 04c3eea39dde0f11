"""Best-fit packing of documents into sequences of at most ``limit`` tokens.

The method, minimum bin slack: for each bin a bitset subset-sum over the
available lengths finds the fullest combination that holds the longest open
piece; it is then removed. Pieces of one length are interchangeable, so the
search works on the histogram of lengths (at most ``limit`` rows, whatever the
corpus), and repeats a combination until one of its lengths runs out: the same
bins as one at a time, in at most ``limit`` searches. Spark then deals the
pieces out: each gets a number among those of its length, and the number's bin.

Edge cases: a null or empty text is the single end token. A document longer
than ``limit`` is cut into pieces of ``limit`` and a shorter last one. Repeated
rows are packed each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_rows, materialise, read_table, slices
from .tokens import tokenizer_path, word_tokenizer

LIMIT = 2048


def document_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids array<int>) for every piece of every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder, end = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            of, rows, ids = [], [], []
            for k, raw in enumerate(coder.encode(b["text"].to_pylist())):
                raw += end
                for p, at in enumerate(range(0, len(raw), 4 * limit)):
                    own = raw[at : at + 4 * limit]
                    of.append(k)
                    rows.append((p, at // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            out = [b["doc_id"].take(pa.array(of, pa.int64())), pa.array(cols[0].astype(np.int32)), *(pa.array(c) for c in cols[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return long_rows(docs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(seed: int, counts: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """The fullest combination of at most ``limit`` that holds ``seed``: (length, how often), seed included.

    ``counts[n]``: how many pieces of n tokens are open. Bit s of a set says
    that the sum s can be reached; copies of a length are added by binary
    splitting. Longer lengths come first, so the sums are made of few pieces.
    """
    room = limit - seed
    left = counts.copy()
    left[seed] -= 1
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # sums that could be reached before this step, length, copies
    for n in (np.flatnonzero(left[1 : room + 1])[::-1] + 1).tolist():
        most, c = min(int(left[n]), room // n), 1
        while most > 0 and not reach >> room & 1:
            take = min(c, most)
            steps.append((reach, n, take))
            reach |= (reach << (n * take)) & mask
            most, c = most - take, c * 2
        if reach >> room & 1:
            break
    total, took = reach.bit_length() - 1, {seed: 1}
    for before, n, take in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            took[n] = took.get(n, 0) + take
    return list(took.items())


def plan_bins(counts: np.ndarray, limit: int = LIMIT) -> pd.DataFrame:
    """Where the pieces of each length go: length, first (number within the length), per_bin, base (offset in the bin), bin (the first), bins.

    Pieces ``first + r * per_bin + k`` lie in bin ``bin + r`` at ``base + k * length``.
    """
    open_, seen = counts.astype(np.int64).copy(), np.zeros(limit + 1, np.int64)
    rows, at = [], 0
    for seed in range(limit, 0, -1):
        while open_[seed] > 0:
            combo = fullest(seed, open_, limit)
            times = min(int(open_[n]) // k for n, k in combo)
            base = 0
            for n, k in combo:
                rows.append((n, seen[n], k, base, at, times))
                seen[n] += k * times
                open_[n] -= k * times
                base += n * k
            at += times
    return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 6), columns=["length", "first", "per_bin", "base", "bin", "bins"])


def pack(pieces: DataFrame, limit: int = LIMIT, rows_per_bucket: int = 50_000, buckets: int = 256) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with sequence_id and offset.

    Numbers within a length come from counts by (length, bucket) plus a place
    in the bucket, so a length that many pieces share is never in one task.
    """
    pieces = materialise(pieces, "pieces")
    total = pieces.count()
    spread = max(buckets, -(-total // rows_per_bucket))
    own = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(spread)))
    by_bucket = materialise(own.groupBy("length", "_b").agg(F.count("*").alias("_n")), "piece-counts")
    counts = np.zeros(limit + 1, np.int64)
    for r in by_bucket.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most limit rows
        counts[r["length"]] = r["n"]
    plan = plan_bins(counts, limit).sort_values(["length", "first"])
    told = pieces.sparkSession.sparkContext.broadcast({n: g.drop(columns="length").to_numpy() for n, g in plan.groupby("length")})

    def place(batches):
        for p in batches:
            length, number = p["length"].to_numpy(), p["_number"].to_numpy()
            seq, off = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for n in np.unique(length):
                mine, table = length == n, told.value[n]
                k = np.searchsorted(table[:, 0], number[mine], side="right") - 1
                first, per_bin, base, bin_, _ = table[k].T
                r, j = np.divmod(number[mine] - first, per_bin)
                seq[mine], off[mine] = bin_ + r, base + j * n
            p["sequence_id"], p["offset"] = seq, off
            yield p.drop(columns=["_number"])

    before = by_bucket.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = (
        own.withColumn("_k", within)
        .join(before.select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_b"])
        .withColumn("_number", F.col("_before") + F.col("_k") - 1)
        .select(*pieces.columns, "_number")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(document_pieces(docs, tokenizer or tokenizer_path(), limit), limit)


def sequences(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The packed token ids themselves: sequence_id, ids array<int>; a sequence's pieces are few and bounded."""
    placed = pack(document_pieces(docs, tokenizer or tokenizer_path(), limit, with_ids=True), limit)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
