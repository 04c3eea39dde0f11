"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document fails or passes each of the filters A to E. The counts of a part
(all its documents, those labelled good, those labelled toxic) by these five
outcomes are a 2 x 2 x 2 x 2 x 2 tensor. For a step of an order, each axis is
contracted with a selector: ``pass`` for the filters before it, ``fail`` for
its own, ``all`` for those to come. One einsum over the tensors of a batch of
parts and the selectors of all 600 steps gives each figure.

A text's copies are found by its SHA-256. Rows shrink to a few numbers before
they are shuffled, equal rows are counted first, and a group of copies is one
row per (part, label, outcome) with its smallest id and how often that stands,
so no task sees a group's rows.

Edge cases: a null text is empty. A null source is part ''. Rows that repeat a
document each count; E fails where a smaller id has the same text, so repeats
of the smallest id pass, and a row without id neither fails E nor makes others
fail. A document that any row of ``labels`` calls good (toxic) is good (toxic);
other columns of both tables are ignored. No documents give no rows. Very long
texts are read one Arrow batch slice at a time.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_rows, read_table, slices, words_of

FILTERS = "ABCDE"
#: Limits of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_ROWS = "doc_id long, part string, fails int, digest binary"
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Selectors of an axis: what it takes of (passes, fails).
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def fails_of(text: str | None) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    text = text or ""
    raw, words = text.encode("utf-8", "surrogatepass"), words_of(text)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    a, b = len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    return a | b << 1 | (100 * capitals > CAPITALS_PERCENT * len(text)) << 2 | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to D), digest of every row of ``docs(doc_id, text, source)``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches):
        for b in slices(batches):
            texts = b["text"].to_pylist()
            digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], pa.array([fails_of(t) for t in texts], pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    return long_rows(docs).mapInArrow(run, _ROWS)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (bits of all five failures), n, good, toxic: at most 32 rows a part."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs).groupBy("doc_id", "part", "fails", "digest").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    with_id = rows.where("doc_id is not null").join(told.where("doc_id is not null"), "doc_id", "left").select(*rows.columns, flag("good"), flag("toxic"))
    rows = with_id.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    # A group of copies: its smallest id, and how many rows have it or none.
    keys = ["digest", "fails", "part", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id")))
    per_id = rows.groupBy(*keys, "doc_id").agg(F.sum("n").alias("n"))
    groups = per_id.groupBy(*keys).agg(F.sum("n").alias("n"), first["doc_id"].alias("low"), F.min_by("n", "doc_id").alias("at_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    low = F.min("low").over(Window.partitionBy("digest"))
    passed = F.col("no_id") + F.when(F.col("low") == low, F.col("at_low")).otherwise(0)
    both = groups.withColumn("passed", passed).select("fails", "part", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("passed").alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("passed")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.groupBy("part", (F.col("fails") + F.col("x.e")).alias("cell")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _selectors() -> dict[str, np.ndarray]:
    """For each figure, (120 orders, 5 steps, 5 axes, 2): what each axis takes."""
    out = {k: np.empty((120, 5, 5, 2), np.int64) for k in ("kept", "removed", "failed", "alone")}
    for o, order in enumerate(permutations(range(5))):
        for k, f in enumerate(order):
            for axis in range(5):
                before, own = order.index(axis) < k, axis == f
                out["kept"][o, k, axis] = _PASS if before or own else _ALL
                out["removed"][o, k, axis] = _FAIL if own else _PASS if before else _ALL
                out["failed"][o, k, axis] = _FAIL if own else _ALL
                out["alone"][o, k, axis] = _FAIL if own else _PASS
    return out


def contract(tensors: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """(parts, 2, 2, 2, 2, 2) with (orders, steps, 5, 2): sums by part, order and step, in whole numbers."""
    return np.einsum("pabcde,osa,osb,osc,osd,ose->pos", tensors, *(selectors[:, :, k] for k in range(5)), optimize=["einsum_path", (0, 1), (0, 4), (0, 3), (0, 2), (0, 1)])


def audit(cells: DataFrame) -> DataFrame:
    """600 rows a part from its ``cells``: a row per order and step."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("c"))  # 32 entries at most

    def run(batches):
        s = _selectors()
        orders = list(permutations(range(5)))
        names = pa.array(["".join(FILTERS[f] for f in o) for o in orders for _ in range(5)])
        own = np.array(orders)
        for b in slices(batches, 64):
            found = b["c"]
            flat, row = found.flatten(), np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
            n, good, toxic = tensors = np.zeros((3, len(found), 32), np.int64)
            for t, name in zip(tensors, ("n", "good", "toxic")):
                t[row, flat.field("cell").to_numpy()] = flat.field(name).to_numpy()
            # Bit k of the cell is axis k: the last axis of the array is A, so axes are turned round.
            n, good, toxic = (t.reshape(-1, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1) for t in tensors)
            removed = contract(n, s["removed"])
            shapley = np.zeros((len(found), 5), np.int64)
            for f in range(5):
                shapley[:, f] = removed[:, own == f].sum(1)
            figures = [contract(n, s["kept"]), removed, contract(n, s["failed"]) - removed, contract(n, s["alone"]), contract(good, s["removed"]), contract(toxic, s["removed"]), shapley[:, own]]
            for k, part in enumerate(b["part"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([part] * 600), names, pa.array(np.tile(np.arange(1, 6, dtype=np.int32), 120)), *(pa.array(f[k].reshape(-1)) for f in figures)], names=[c.split()[0] for c in _OUT.split(", ")])

    return parts.mapInArrow(run, _OUT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
FILTER_AUDIT_SQL = f"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
 low as (select text, min(doc_id) as low from t group by text),
 lab as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
 f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, map {{'A': len(w) < {LEAST_WORDS}, 'B': 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > low.low, false)}} as m
   from t join low using (text) left join lab on lab.doc_id = t.doc_id),
 c as (select part, good, toxic, m, count(*) as n from f group by all),
 o as (select col0 as filter_order from (values {_ORDERS})),
 s as (select filter_order, k::int as step, filter_order[k:k] as own, string_split(filter_order[1:k - 1], '') as before, list_filter(['A','B','C','D','E'], lambda x: x <> filter_order[k:k]) as others from o, range(1, 6) r(k)),
 x as (select part, filter_order, step, own, n, good, toxic, m[own] as fails, len(list_filter(before, lambda x: coalesce(m[x], false))) = 0 as here, len(list_filter(others, lambda x: m[x])) = 0 as alone from c, s),
 g as (select part, filter_order, step, own, sum(n) filter (here and not fails) as kept, sum(n) filter (here and fails) as removed, sum(n) filter (fails and not here) as redundant,
    sum(n) filter (fails and alone) as unique_fails, sum(n) filter (here and fails and good) as good_lost, sum(n) filter (here and fails and toxic) as toxic_lost from x group by all)
select part, filter_order, step, {', '.join(f'coalesce({c}, 0)::bigint as {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  (sum(coalesce(removed, 0)) over (partition by part, own))::bigint as shapley from g
"""
