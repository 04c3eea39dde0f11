"""Benchmark decontamination: exact phrases and proximity matches by a positional index.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter
item. In every block of the index (``lexical_index``) the words of a window are
taken by rising number of postings: the rarest word's list, moved back by its
place in the window, gives the starts to try, and each further list, moved by
its own place, keeps those that it holds. What is left are the window's exact
occurrences. A proximity match is a stretch of at most ``NEAR`` words of one
document in which every distinct word of a window stands, in any order; every
exact occurrence of a window that short is one.

Windows of a chunk of items are sent to the tasks (``lexical_index.CHUNK``
bounds them), equal windows of several items once. Each document's hit runs and
items are then merged over the chunks.

Edge cases: a null or empty text has no words: a document without hits, or an
item without windows. Rows that repeat a document each give a row; rows that
repeat an item name it once; an item without id counts as an empty name. Items
that share a window are each named. Empty tables give no rows or no hits. Other
columns are ignored. A very long text is one document of its block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .lexical_index import Block, blocks, build_index, by_block, chunks, document_counts, item_terms

WINDOW, NEAR = 10, 20
_HITS = "block long, ord int, exact array<string>, near array<string>, runs array<struct<start:int,end:int>>"
_ARROW = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("exact", pa.list_(pa.string())), ("near", pa.list_(pa.string())), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def windows_of(rows: list, size: int) -> dict[tuple[str, ...], set[str]]:
    """Each distinct window of a chunk's items, with the items that have it."""
    found: dict[tuple[str, ...], set[str]] = {}
    for r in rows:
        terms = r["terms"]
        for k in range(max(1, len(terms) - size + 1)):
            found.setdefault(tuple(terms[k : k + size]), set()).add(r["item_id"] or "")
    return found


def _has(lists: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which wanted positions a posting list holds."""
    at = np.searchsorted(lists, wanted)
    return lists[np.minimum(at, len(lists) - 1)] == wanted


class _Finder:
    """A window's occurrences in one block; positions of a term are decoded once."""

    def __init__(self, block: Block):
        self.block, self.known = block, {}

    def at(self, term: str) -> np.ndarray:
        if term not in self.known:
            self.known[term] = self.block.positions(self.block.row[term])
        return self.known[term]

    def exact(self, window: tuple[str, ...], order: list[int]) -> np.ndarray:
        """Starts of the window: lists moved by their places, the rarest first."""
        starts = self.at(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            starts = starts[_has(self.at(window[k]), starts + k)]
        return starts

    def near(self, words: list[str], within: int, skip: np.ndarray) -> set[int]:
        """Documents, other than ``skip``, with a stretch of ``within`` words that holds all ``words`` (the rarest first)."""
        around = self.at(words[0])
        for w in words[1:]:
            if not len(around):
                return set()
            lists = self.at(w)
            at = np.minimum(np.searchsorted(lists, around - within + 1), len(lists) - 1)
            around = around[np.abs(lists[at] - around) < within]
        docs = self.block.documents(around)
        found: set[int] = set()
        for p, d in zip(around[open_ := ~np.isin(docs, skip)].tolist(), docs[open_].tolist(), strict=True):
            if d in found:
                continue
            lo = max(int(self.block.starts[d]), p - within + 1)
            hi = min(int(self.block.starts[d] + self.block.words[d]), p + within)
            held = sorted((int(q), k) for k, w in enumerate(words) for q in self.at(w)[np.searchsorted(self.at(w), lo) : np.searchsorted(self.at(w), hi)])
            last = [-within] * len(words)
            for q, k in held:
                last[k] = q
                if q - min(last) < within and min(last) >= lo:
                    found.add(d)
                    break
        return found


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _find_in_block(block: Block, windows: list[tuple[tuple[str, ...], list[str]]], within: int) -> pa.RecordBatch | None:
    finder, exact, near, runs = _Finder(block), {}, {}, {}
    for window, items in windows:
        if any(w not in block.row for w in window):
            continue
        count = [int(block.count[block.row[w]]) for w in window]
        order = sorted(range(len(window)), key=count.__getitem__)
        starts = finder.exact(window, order)
        docs = block.documents(starts)
        for d, s in zip(docs.tolist(), (starts - block.starts[docs]).tolist(), strict=True):
            exact.setdefault(d, set()).update(items)
            runs.setdefault(d, set()).add((s, s + len(window)))
        if len(window) <= within:
            for d in {*docs.tolist(), *finder.near(list(dict.fromkeys(window[k] for k in order)), within, docs)}:
                near.setdefault(d, set()).update(items)
    if not exact and not near:
        return None
    every = sorted({*exact, *near})
    get = lambda of: [sorted(of.get(d, ())) for d in every]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(every), block.block)), pa.array(every, pa.int32()), pa.array(get(exact), pa.list_(pa.string())), pa.array(get(near), pa.list_(pa.string())), pa.array([_merged(runs.get(d, ())) for d in every], _ARROW.field("runs").type)], schema=_ARROW)


def find_windows(index: DataFrame, items: DataFrame, size: int = WINDOW, within: int = NEAR) -> DataFrame:
    """block, ord, exact, near (arrays of item_ids), runs (word ranges of the document that windows cover, ends exclusive)."""
    spark = index.sparkSession
    found = [spark.createDataFrame([], _HITS)]
    for rows in chunks(item_terms(items)):
        df = document_counts(index, sorted({t for r in rows for t in r["terms"]}))
        windows = [(w, sorted(ids)) for w, ids in windows_of(rows, size).items() if all(t in df for t in w)]
        if not windows:
            continue
        sent = spark.sparkContext.broadcast(windows)  # of one chunk: bounded

        def run(batches, sent=sent):
            for block in blocks(batches):
                out = _find_in_block(block, sent.value, within)
                if out is not None:
                    yield out

        found.append(by_block(index, sorted({t for w, _ in windows for t in w})).mapInArrow(run, _HITS))
    # Bounded by a document's words and by the items found in it.
    together = reduce(DataFrame.unionByName, found).groupBy("block", "ord").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("exact", "near", "runs")))
    return together


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, within: int = NEAR) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, exact and near (sorted item_ids), runs (hit word ranges)."""
    index = build_index(docs)
    hits = find_windows(index, items, size, within)
    own = index.where("term is null").select("block", "ord", "doc_id", F.col("cf").cast("long").alias("n_words"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], r["end"]).alias("upto"))
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step)["n"]
    out = own.join(hits, ["block", "ord"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), empty("exact", "array<string>"), empty("near", "array<string>"), empty("runs", "array<struct<start:int,end:int>>"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More columns: n_near long, items of which all distinct words of a window stand within 20 words of the document."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("exact").cast("long").alias("n_items"), F.sha2(F.array_join("exact", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DECONTAMINATION_SQL = f"""
with doc as (select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}'), []) as w from documents),
 item as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') as w from benchmark),
 cut as (select item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) as k from item where len(w) > 0),
 win as (select distinct item_id, w[k:k + {WINDOW} - 1] as w from cut),
 one as (select w, len(w) as size, row_number() over (order by w) as id from (select distinct w from win)),
 pos as (select doc_id, unnest(w) as t, unnest(range(1, len(w) + 1)) as p from doc),
 df as (select t, count(*) as c from pos group by t),
 term as (select id, size, unnest(w) as t, unnest(range(0, size)) as k from one),
 known as (select id, size, count(*) as n, count(distinct t) as kinds, arg_min({{'t': t, 'k': k}}, struct_pack(c := c, k := k)) as rare from term join df using (t) group by id, size),
 cand as (select doc_id, p - rare.k as s, id, size from known join pos on pos.t = rare.t where n = size),
 hit as (select c.doc_id, c.s, c.id, c.size from cand c join term using (id) join pos on pos.doc_id = c.doc_id and pos.p = c.s + term.k and pos.t = term.t group by all having count(*) = c.size),
 hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hit) group by doc_id),
 named as (select distinct doc_id, item_id from hit join one using (id) join win using (w)),
 names as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from named group by doc_id),
 around as (select distinct doc_id, id, kinds, p from known join pos on pos.t = rare.t where n = size and size <= {NEAR}),
 held as (select distinct a.doc_id, a.id, a.kinds, a.p, x.p as q, x.t from around a join (select distinct id, t from term) m using (id) join pos x on x.doc_id = a.doc_id and x.t = m.t and x.p between a.p - {NEAR} + 1 and a.p + {NEAR} - 1),
 enough as (select doc_id, id, p from held group by doc_id, id, p, kinds having count(distinct t) = kinds),
 opened as (select h.doc_id, h.id, h.kinds, h.q, h.t, h.p, unnest(range(greatest(h.q, h.p) - {NEAR} + 1, least(h.q, h.p) + 1)) as s from held h join enough using (doc_id, id, p)),
 close as (select distinct doc_id, id from (select doc_id, id, p, s from opened group by doc_id, id, p, s, kinds having count(distinct t) = kinds)),
 nears as (select doc_id, count(distinct item_id) as n_near from close join one using (id) join win using (w) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from doc d left join hits using (doc_id) left join names using (doc_id) left join nears using (doc_id)
"""
