"""Token counts: rollups by source, language and tokenizer version, kept up to date by deltas.

A batch holds signed changes: inserts (+), deletes (-), and revised counts (the
old row with -, the new one with +). Committing a batch writes its sums by key
as Parquet under ``batch=<id>/attempt=<number>-<random>``; totals are sums over
the last complete attempt of each batch. Sums are additive, so batches may come
in any order, and a batch committed again replaces what it said before instead
of adding to it. An attempt counts once Spark has marked it as complete, so a
reader sees a batch as it was or as it is, never half of it, and a commit that
broke off changes nothing. ``vacuum`` deletes attempts that no longer count.

Edge cases: null source or language is a group of its own. A null or empty text
has no tokens and still counts as a document; texts are counted whole, a few
hundred rows at a time. Repeated rows each count. A key whose documents are all
deleted goes. An empty batch commits as no rows; a rollup without a commit has
no totals. Other columns of the input are not read, whatever they are called.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folders, long_rows, materialise, read_table, scratch_dir, slices, words_of
from .tokens import tokenizer_path, word_tokenizer

KEYS = ["source", "lang", "tokenizer"]
#: Spark's option for the mark of a complete write.
_MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, words, tokens of every row: white-space words and the ids of a public tokenizer."""
    path = path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")

    def run(batches):
        coder = word_tokenizer(path)
        for b in slices(batches):
            texts = b["text"].to_pylist()
            words = [len(words_of(t or "")) for t in texts]
            ids = [len(coder.encode_one(t or "")) // 4 for t in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["lang"], pa.array(words, pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "source", "lang", "words", "tokens"])

    return long_rows(docs).mapInArrow(run, "doc_id long, source string, lang string, words long, tokens long")


def change(rows: DataFrame, sign: int, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """``rows(source, lang, <tokens>)`` as signed changes of a batch."""
    return rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (F.col(tokens) * sign).cast("long").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Write the batch's sums as a new attempt; it replaces those before once it is complete."""
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        number = 1 + max((int(a.split("-")[0]) for b, a in self._attempts() if b == batch), default=0)
        path = f"{self.path}/batch={batch}/attempt={number:012d}-{uuid.uuid4().hex}"
        sums.coalesce(1).write.option(_MARK, "true").parquet(path)

    def _attempts(self) -> list[tuple[str, str]]:
        """(batch, attempt) of every complete attempt."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/attempt=*/_SUCCESS")
        found = [str(x.getPath().toString()).split("/")[-3:-1] for x in pattern.getFileSystem(conf).globStatus(pattern) or ()]
        return sorted((b.removeprefix("batch="), a.removeprefix("attempt=")) for b, a in found)

    def deltas(self) -> DataFrame:
        """The rows of each batch's last complete attempt, and the batch."""
        last = dict(self._attempts())  # sorted, so the last attempt of a batch stays
        kinds = _DELTA + ", batch string"
        if not last:
            return self.spark.createDataFrame([], kinds)
        paths = [f"{self.path}/batch={b}/attempt={a}" for b, a in last.items()]
        return self.spark.read.option("basePath", self.path).schema(kinds + ", attempt string").parquet(*paths).drop("attempt")

    def vacuum(self) -> None:
        """Delete complete attempts that a later one replaced; readers that began before may fail, but never get wrong totals."""
        done = self._attempts()
        last = dict(done)
        delete_folders(self.spark, [f"{self.path}/batch={b}/attempt={a}" for b, a in done if a != last[b]])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys without documents are left out."""
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self, name: str) -> "Rollup":
        """A rollup whose one batch holds the totals so far, beside this one."""
        out = Rollup(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}")
        out.commit(name, self.totals())
        return out


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus's history replayed over all of ``documents``.

    Batch ``insert-0..3`` adds every document (by hash of its id) with its word
    count; ``delete`` takes out those that were withdrawn for a time (``lang`` =
    'es' and an id hash in the upper half); ``revise`` counts the rest anew with
    the tokenizer; ``restore`` adds the withdrawn ones again, counted likewise.
    ``insert-1`` and ``revise`` are committed twice, which must change nothing.
    The totals are those of the tokenizer over all rows of ``documents``.
    """
    counted = materialise(count_tokens(read_table(spark, sf_dir, "documents")), "token-counts")
    part = counted.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    gone = (F.col("lang") == "es") & (F.col("part") >= 2)
    rollup = Rollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for k in (0, 1, 2, 3, 1):
        rollup.commit(f"insert-{k}", change(part.where(F.col("part") == k), 1, "words", "words"))
    rollup.commit("delete", change(part.where(gone), -1, "words", "words"))
    rest = part.where(~F.coalesce(gone, F.lit(False)))
    revised = reduce(DataFrame.unionByName, [change(rest, -1, "words", "words"), change(rest, 1, "word_bpe_49k")])
    for _ in range(2):
        rollup.commit("revise", revised)
    rollup.commit("restore", change(part.where(gone), 1, "word_bpe_49k"))
    return rollup.totals()
