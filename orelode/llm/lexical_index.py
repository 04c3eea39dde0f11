"""A positional inverted index of documents, stored as a table.

``build_index`` cuts the documents of each task into blocks of about ``BLOCK``
words. A block has one row per term with all its postings in the block, and one
row per document:

* term rows: block, term, df (documents of the block with the term), cf (its
  occurrences), gaps (array<int>: the first position, then the distance from
  one to the next), doc_id and ord null;
* document rows: block, term null, ord (0, 1, .. in the block), doc_id, cf (its
  words).

Positions count the words of a block, with one place left empty after each
document, so a run of neighbouring positions never spans two documents. A term
of any frequency is spread over its blocks, and no block's postings exceed its
words, so a hot term is never one task's work. The table is written to the
shared folder; searches read the rows of the terms that they ask for.

Words are the maximal runs of characters other than ``\\x00-\\x2F \\x3A-\\x40
\\x5B-\\x60 \\x7B-\\x7F``, with A-Z lower-cased and nothing else changed.

Edge cases: a null or empty text is a document without words. Null ids and
repeated rows are documents of their own. A text of any length stays whole in
its block, which is then as long as the text. No rows give an empty index.
Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows, materialise, slices

#: Words of a block, so long as no single document is longer.
BLOCK = 2_000_000
#: Words of test items that are searched for at once: what is sent to every task is at most this large (a longer item is a chunk of its own).
CHUNK = 400_000
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _BREAKS else b for b in range(256))
_INDEX = "block long, term string, df int, cf int, gaps array<int>, ord int, doc_id long"
_ARROW = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("cf", pa.int32()), ("gaps", pa.list_(pa.int32())), ("ord", pa.int32()), ("doc_id", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class _Numbers(dict):
    """A number for each term, in order of its first use."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _block_rows(block: int, terms: list[bytes], words: list[np.ndarray], doc_ids: list[int | None]) -> Iterator[pa.RecordBatch]:
    """The rows of one block; ``words`` holds each document's term numbers."""
    docs, n = np.array([len(w) for w in words], np.int64), len(terms)
    none = lambda kind, size: pa.nulls(size, kind)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), block)), none(pa.string(), len(docs)), none(pa.int32(), len(docs)), pa.array(docs.astype(np.int32)), none(pa.list_(pa.int32()), len(docs)), pa.array(np.arange(len(docs), dtype=np.int32)), pa.array(doc_ids, pa.int64())], schema=_ARROW)
    if not n:
        return
    doc = np.repeat(np.arange(len(docs)), docs)
    # Term in the upper half, position in the lower one: one sort orders both.
    keys = (np.concatenate(words).astype(np.int64) << 32) | (np.arange(len(doc)) + doc)
    keys.sort()
    at, term = keys & 0xFFFFFFFF, keys >> 32
    first = np.searchsorted(term, np.arange(n + 1))
    gaps = np.diff(at, prepend=0)
    gaps[first[:-1]] = at[first[:-1]]
    # Another document begins where the term or the document changes.
    starts = np.concatenate(([0], np.cumsum(docs + 1)))[:-1]
    own = np.searchsorted(starts, at, "right")
    new = np.diff(own, prepend=0) != 0
    new[first[:-1]] = True
    df = np.add.reduceat(new, first[:-1], dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(gaps.astype(np.int32)))
    names = pa.array(terms, pa.binary()).cast(pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), names, pa.array(df.astype(np.int32)), pa.array(np.diff(first).astype(np.int32)), lists, none(pa.int32(), n), none(pa.int64(), n)], schema=_ARROW)


def build_index(docs: DataFrame, block_words: int = BLOCK) -> DataFrame:
    """The index of ``docs(doc_id, text)``, written to the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        numbers, words, ids = _Numbers(), [], []
        for b in slices(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = terms_of(text)
                if size and size + len(own) > block_words:
                    yield from _block_rows(block, list(numbers), words, ids)
                    block, size, numbers, words, ids = block + 1, 0, _Numbers(), [], []
                words.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                ids.append(doc_id)
                size += len(own) + 1
        if ids:
            yield from _block_rows(block, list(numbers), words, ids)

    return materialise(long_rows(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _INDEX), "lexical-index")


def item_terms(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """item long (a number of each row), item_id string, terms array<string>: the words of test items, written once."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["item"], b["item_id"], pa.array([[w.decode() for w in terms_of(t)] for t in b["text"].to_pylist()], pa.list_(pa.string()))], names=["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("string").alias("item_id"), "text")
    return materialise(long_rows(rows).mapInArrow(run, "item long, item_id string, terms array<string>"), "items")


def chunks(items: DataFrame, words: int = CHUNK) -> Iterator[list]:
    """The rows of ``item_terms`` in groups of about ``words`` words, by hash; each is small enough for every task."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, math.ceil(total / words))
    for k in range(n):
        if rows := items.where((F.pmod(F.xxhash64("item"), F.lit(n)) == k) & (F.size("terms") > 0)).collect():
            yield rows


def postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """The index's rows of some terms; ``terms`` are those of one chunk, so their broadcast is bounded."""
    asked = index.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return index.where("term is not null").join(F.broadcast(asked), "term", "left_semi")


def document_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of a chunk's terms stands; those that stand in none are left out."""
    return {r["term"]: r["df"] for r in postings(index, terms).groupBy("term").agg(F.sum("df").alias("df")).collect()}


def by_block(index: DataFrame, terms: list[str]) -> DataFrame:
    """Document rows and the postings of some terms, each block together and in order."""
    cols = ["block", "term", "cf", "gaps", "ord", "doc_id"]
    rows = index.where("term is null").select(cols).unionByName(postings(index, terms).select(cols))
    return rows.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first(), "ord")


class Block:
    """One block in a task: its documents' starts, words and ids, and ``positions`` of a term."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t["term"].null_count  # document rows come first, in the order of ord
        self.block = t["block"][0].as_py()
        self.words = t["cf"].slice(0, n).to_numpy().astype(np.int64)
        ids = t["doc_id"].slice(0, n)
        self.no_id = ids.is_null().to_numpy()
        self.doc_ids = ids.fill_null(0).to_numpy()
        self.starts = np.concatenate(([0], np.cumsum(self.words + 1)))[:-1]
        lists = t["gaps"].slice(n)
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        self._at, self._gaps = lists.offsets.to_numpy(), lists.values.to_numpy()
        self.row = {w: k for k, w in enumerate(t["term"].slice(n).to_pylist())}
        self.count = np.diff(self._at)

    def positions(self, row: int) -> np.ndarray:
        return np.cumsum(self._gaps[self._at[row] : self._at[row + 1]], dtype=np.int64)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def blocks(batches) -> Iterator[Block]:
    """The blocks of a task's batches, which ``by_block`` has put in order."""
    parts, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        own = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if own[lo] != now and parts:
                yield Block(parts)
                parts = []
            now = own[lo]
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield Block(parts)
