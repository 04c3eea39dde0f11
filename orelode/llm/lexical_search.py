"""Ranked lexical search: term-at-a-time for short lists, document-at-a-time over long ones.

Every document is ranked for every item by a BM25-like score in whole numbers.
In each block of the index (``lexical_index``) an item's short posting lists are
added up term by term into sorted accumulators; these then count as one list
with one upper bound. It and the long lists are walked side by side in ranges
of documents: while the k-th best score so far exceeds what the lists of the
lowest bounds can add up to, these lists only serve lookups for documents that
another list brought up, and documents that can no longer reach that score are
skipped. The k best and their threshold go on from block to block of a task;
the last step merges the tasks' k best of each item.

Skipping is strict (a document that might reach the threshold is kept), so
results are exact: by falling score, equal scores by rising doc_id, null last.

Edge cases: a null or empty text has no terms and is never found. Rows of
documents and of items each count, also repeated ones; an item without terms,
or whose terms stand nowhere, has no rows. An empty table gives no rows. Other
columns are ignored. A long text is one document of its block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table
from .lexical_index import Block, blocks, build_index, by_block, chunks, document_counts, item_terms

TOP = 20
#: A list with postings in at most this share of a block's documents is short.
SHORT = 1 / 32
#: Documents that are walked at once.
RANGE = 2048
_FOUND = "item long, doc_id long, score long"


def _add_up(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct documents, and for each the sum of its scores."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[first], np.add.reduceat(scores[order], first) if len(first) else scores


class _Best:
    """The k best of one item: by falling score, then rising id, a missing id last."""

    def __init__(self, k: int):
        self.k, self.score, self.none, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.ids = score[order], none[order], ids[order]


def _walk(lists: list[tuple[np.ndarray, np.ndarray, int]], block: Block, best: _Best) -> None:
    """Document-at-a-time over ``lists(documents, scores, bound)``, with the lists of low bounds for lookups only."""
    lists = sorted(lists, key=lambda x: x[2])
    below = np.cumsum([x[2] for x in lists])  # what a list and all of lower bounds can give
    n = len(block.words)
    for lo in range(0, n, RANGE):
        lead = int(np.searchsorted(below, best.least))  # the first list whose documents must be looked at
        if lead == len(lists):
            return
        parts = []
        for docs, scores, _ in lists[lead:]:
            a, b = np.searchsorted(docs, (lo, lo + RANGE))
            if b > a:
                parts.append((docs[a:b], scores[a:b]))
        if not parts:
            continue
        docs, scores = parts[0] if len(parts) == 1 else _add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for k in range(lead - 1, -1, -1):
            stay = scores + below[k] >= best.least
            docs, scores = docs[stay], scores[stay]
            if not len(docs):
                break
            at = np.minimum(np.searchsorted(lists[k][0], docs), len(lists[k][0]) - 1)
            scores = scores + np.where(lists[k][0][at] == docs, lists[k][1][at], 0)
        stay = scores >= best.least
        if stay.any():
            best.add(scores[stay], block.no_id[docs[stay]], block.doc_ids[docs[stay]])


def _search_block(block: Block, items: list[tuple[int, list[tuple[str, int]]]], weights: dict[str, int], best: dict[int, _Best], total: int, words: int, short: float) -> None:
    m = 75 + 25 * block.words * total // words
    made: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

    def scored(term: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, scores and largest score of a term, once a block."""
        if term not in made:
            docs = block.documents(block.positions(block.row[term]))
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            tf = np.diff(np.append(first, len(docs)))
            docs = docs[first]
            scores = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
            made[term] = docs, scores, int(scores.max())
        return made[term]

    most = max(1, int(len(block.words) * short))
    for item, terms in items:
        few, lists = [], []
        for term, times in terms:
            if term in block.row:
                docs, scores, bound = scored(term)
                (few if len(docs) <= most else lists).append((docs, scores * times, bound * times))
        if few:
            docs, scores = _add_up(np.concatenate([x[0] for x in few]), np.concatenate([x[1] for x in few]))
            lists.append((docs, scores, int(scores.max())))
        if lists:
            _walk(lists, block, best[item])


def search(index: DataFrame, items: DataFrame, k: int = TOP, short: float = SHORT) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of an index for each of ``items(item_id, text)``."""
    spark = index.sparkSession
    asked = item_terms(items)
    n, words = index.where("term is null").agg(F.count_if(F.col("cf") > 0), F.coalesce(F.sum(F.col("cf").cast("long")), F.lit(0))).first()
    found = [spark.createDataFrame([], _FOUND)]
    for rows in chunks(asked) if words else ():
        df = document_counts(index, sorted({t for r in rows for t in r["terms"]}))
        counted = spark.createDataFrame(list(df.items()), "term string, df long") if df else None
        if not df:
            continue
        weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = {r["term"]: r["w"] for r in counted.select("term", weight.alias("w")).collect()}
        told = []
        for r in rows:
            times: dict[str, int] = {}
            for t in r["terms"]:
                if t in weights:
                    times[t] = times.get(t, 0) + 1
            told.append((r["item"], sorted(times.items())))
        sent = spark.sparkContext.broadcast((told, weights))  # a chunk: bounded

        def run(batches, sent=sent, n=n, words=words):
            told, weights = sent.value
            best = {item: _Best(k) for item, _ in told}
            for block in blocks(batches):
                _search_block(block, told, weights, best, n, words, short)
            for item, b in best.items():
                if len(b.score):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item)), pa.array(b.ids, mask=b.none), pa.array(b.score)], names=["item", "doc_id", "score"])

        found.append(by_block(index, list(weights)).mapInArrow(run, _FOUND))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    found = search(build_index(read_table(spark, sf_dir, "documents")), items)
    return found.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))


TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL_SEARCH_SQL = f"""
with doc as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) as term from documents),
 tf as (select doc_id, term, count(*) as tf from doc group by all),
 len as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
 tot as (select count(*) as big_n, sum(n)::bigint as big_l from len),
 df as (select term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::bigint as w from tf, tot group by term, big_n),
 ask as (select item_id, term, count(*) as q from (select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) as term from benchmark) group by all),
 sc as (select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint as score
   from ask join df using (term) join tf using (term) join len using (doc_id), tot group by item_id, doc_id),
 rk as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from sc where score > 0)
select item_id, rank, doc_id, score from rk where rank <= {TOP}
"""
