"""Quality rules: statistics of each text, fixed rules, and an isolation forest.

The forest isolates a document by random splits on its rule statistics: the
shorter the mean path, the more anomalous. It is grown on a bounded sample
(``trees`` x ``sample`` rows by hash order, as the method itself prescribes),
scores every document, and its threshold is set from all labelled rows.

Edge cases: a null or empty text has no words and fails the base rule. Very
long texts are read whole. Repeated rows each give a row. Without labelled
rows of both kinds the forest rejects nothing. An empty table gives no rows.
Other columns of the input are not read, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, first_by_hash, long_rows, materialise, read_table, slices, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("f_mean_word", "f_symbols", "f_dup_lines", "f_repeat")
TREES, SAMPLE, BINS = 64, 256, 1000


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = ids[:n].astype(np.int64)
    for k in range(1, width):
        code = code * (int(ids.max()) + 1) + ids[k : k + n]
        if k < width - 1 and (int(code.max()) + 1) > (1 << 62) // (int(ids.max()) + 1):
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts and the shares that the forest sees."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(SHARES)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    shares = [chars / n, symbols / chars, dups / len(lines), repeats / n]
    return [n, chars, symbols, dups, repeats], shares


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts (long) and the four shares (double) of every row."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            got = [text_statistics(t) for t in b["text"].to_pylist()]
            counts = np.array([x[0] for x in got], np.int64).reshape(-1, len(COUNTS))
            shares = np.array([x[1] for x in got], np.float64).reshape(-1, len(SHARES))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c) for c in counts.T), *(pa.array(c) for c in shares.T)], names=["doc_id", *COUNTS, *SHARES])

    return long_rows(docs).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in SHARES))


def _depth_left(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays: feature (-1: leaf), split, left, right, path length at a leaf."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        own = rows[rng.permutation(len(rows))[:sample]]
        limit = max(1, math.ceil(math.log2(max(2, len(own)))))
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _depth_left(len(part))])
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth < limit and len(part) > 1 and len(wide):
                f = int(rng.choice(wide))
                cut = rng.uniform(low[f], high[f])
                left = part[:, f] < cut
                nodes[at][:2] = [f, cut]
                nodes[at][2], nodes[at][3] = grow(part[left], depth + 1), grow(part[~left], depth + 1)
            return at

        grow(own, 0)
        t = np.array(nodes)
        forest.append((t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]))
    return forest


def anomaly(rows: np.ndarray, forest: list, sample: int = SAMPLE) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 anomalous, below 0.5 ordinary."""
    total = np.zeros(len(rows))
    for feature, cut, left, right, length in forest:
        at = np.zeros(len(rows), int)
        for _ in range(64):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = rows[np.arange(len(rows)), np.maximum(f, 0)] < cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += length[at]
    return 2.0 ** (-(total / max(1, len(forest))) / max(_depth_left(sample), 1e-9))


def anomaly_scores(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """``stats`` with a column score. The forest sees at most trees * sample rows, by hash of doc_id."""
    kept = [r[:] for r in first_by_hash(stats.where("n_words > 0").select(*SHARES, "doc_id"), F.xxhash64("doc_id", F.lit(11)), trees * sample, *SHARES)]
    rows = np.array([r[: len(SHARES)] for r in kept], float).reshape(-1, len(SHARES))
    forest = grow_forest(rows, trees, sample) if len(rows) else []
    told = stats.sparkSession.sparkContext.broadcast(forest)
    size = min(sample, max(2, len(rows)))

    def run(batches):
        for p in batches:
            p["score"] = anomaly(p[list(SHARES)].to_numpy(float), told.value, size)
            yield p

    return stats.mapInPandas(run, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def calibrate(scores: pd.DataFrame, keep_share: float) -> float:
    """The cut in score from counts by (bin, quality): the lowest that still keeps ``keep_share`` of the good rows.

    Above 1 (nothing is rejected) unless there are rows of both kinds and the
    rows above the cut are mostly bad ones, in share of their kind.
    """
    good, bad = (scores[scores["quality"] == q].groupby("bin")["n"].sum().reindex(range(BINS + 1), fill_value=0).to_numpy(float) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return 2.0
    above = 1 - np.cumsum(good) / good.sum()  # share of good rows in higher bins
    cut = int(np.argmax(above <= 1 - keep_share + 1e-12))
    if 1 - np.cumsum(bad)[cut] / bad.sum() <= above[cut]:
        return 2.0
    return (cut + 1) / BINS


def quality_rules(docs: DataFrame, labels: DataFrame, keep_share: float = 0.995, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts, base_failed, score, kept. ``labels(doc_id, quality)``: 1 good, 0 bad.

    The threshold keeps ``keep_share`` of the labelled good rows that pass the
    base rule; score counts by bin over all labelled rows are what it is set from.
    """
    stats = materialise(rule_statistics(docs), "rule-statistics")
    scored = anomaly_scores(stats, trees, sample).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = (
        scored.where("not base_failed").select("doc_id", F.least(F.floor(F.col("score") * BINS), F.lit(BINS)).alias("bin"))
        .join(marks, "doc_id").groupBy("bin", "quality").agg(F.count("*").alias("n"))
    )
    cut = calibrate(pd.DataFrame([r.asDict() for r in bins.collect()], columns=["bin", "quality", "n"]), keep_share)
    return scored.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("score") < cut)).alias("kept"), "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
