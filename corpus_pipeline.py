"""A training corpus from ``documents``: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import WORD, delete_folders, materialise, noted, read_table
from orelode.llm.line_dedup import dedup_lines
from orelode.llm.minhash_dedup import near_documents
from orelode.llm.packing import pack_documents
from orelode.llm.source_mix import mix_sources
from orelode.llm.toxicity import grade_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't call toxic.

    Null and empty texts stay, repeated rows get one verdict, an empty table stays empty.
    """
    return grade_toxicity(docs, read_table(spark, sf_dir, "labels"), keep_columns=True).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier line of the corpus; n_chars follows.

    A document that loses its last line with a word to an earlier document is
    a copy of what others hold, and goes; one that lost no line stays as it is,
    so do null texts and rows without id. Repeated rows are treated alike.
    """
    done = dedup_lines(docs)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest id.

    Rows are numbered first, so rows that repeat an id, or have none, are told
    apart: of exact repeats one stays, of two texts with one id only the copy
    goes. Rows without id come last in a group. Null and blank texts stay.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-documents")
    found = near_documents(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first._row"), "_row").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rows without id and rows that repeat one as well.

    Null sources are one source; null and blank texts have no words and aren't taken.
    """
    taken = mix_sources(docs, keep_columns=True).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset.

    A null text is empty (one end token); longer texts are cut; every row, also
    one that repeats another, is packed on its own; no rows give no pieces.
    """
    return pack_documents(docs)


#: The columns that stages know; any others pass through under names that no stage uses.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _carry(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` on documents with any further columns: they come back unchanged, whatever they are called."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*(c if c in KNOWN else f"carried_{k}" for k, c in enumerate(names))), sf_dir).toDF(*names)

    return run_stage


STAGES = [("toxicity", _carry(toxicity)), ("line_dedup", _carry(line_dedup)), ("near_dedup", _carry(near_dedup)), ("mixing", _carry(mixing)), ("packing", packing)]

#: The model, the similarity joins and the tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written; then the scratch tables that the stage itself wrote go."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with noted() as scratch:
            result = stage(spark, docs, sf_dir)
        docs = materialise(result, f"pipeline-{name}")
        delete_folders(spark, scratch + before)
        before = [docs.scratch_path]
    return STAGES[-1][1](spark, docs, sf_dir)
