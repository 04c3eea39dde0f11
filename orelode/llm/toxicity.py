"""Toxicity: cumulative-link (proportional odds) regression over sparse text features.

Grades: 0 clean, then 1 to ``GRADES - 1`` by how much toxic matter a text holds. The
labels only say toxic or not; a toxic row's grade comes from how many features
it has that toxic rows have far more often than clean ones (tertiles over the
labelled sample); only these features get weights. P(grade > k) = sigmoid(w.x - b_k): one weight vector for all ordered
thresholds b_0 < b_1 < ... The result is the expected severity, the sum over k
of P(grade > k), and the verdict toxic from a cut on the score on. As a grade counts toxic matter, so does the severity.

Features, hashed into ``DIMENSIONS`` columns and present or not: words without
outer punctuation in lower case, and prefixes of 4 and 5 letters of words.

The fit uses a bounded sample of labelled rows (``max_rows`` a label, by hash
order); everything is scored, and the cut comes from counts over all other
labelled rows.

Edge cases: a null or empty text has no feature and is never toxic. Very long
texts are read whole. Rows without label are scored like the others. With no
toxic or no clean labelled row nothing is called toxic. Repeated rows each give
a row; columns named like the result's are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, long_rows, materialise, read_table, slices

DIMENSIONS = 1 << 18
GRADES = 4
MAX_ROWS = 4000
#: Scores less the first threshold are counted in this many bins between -FAR and FAR.
BINS, FAR = 4000, 40.0
_TRIM = ".,;:!?\"'()[]{}<>|#*$%&"


def _forms(word: str) -> tuple[str, ...]:
    w = word.strip(_TRIM)
    return (w,) + tuple("^" + w[:k] for k in (4, 5) if len(w) >= k) if w else ()


def features(text: str | None, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct columns of a text. ``cache`` keeps the columns of seen words."""
    got: set[int] = set()
    for w in set((text or "").lower().split()):
        cols = cache.get(w)
        if cols is None:
            cols = tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in _forms(w))
            if len(cache) >= 50_000:
                cache.clear()
            cache[w] = cols
        got.update(cols)
    return np.fromiter(sorted(got), np.int64, len(got))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def telling(rows: list[np.ndarray], toxic: np.ndarray, least: float = 3.0) -> np.ndarray:
    """Columns that toxic rows have ``least`` standard deviations more often than if labels didn't matter."""
    k1, k0 = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(x for x, y in zip(rows, toxic, strict=True) if y == t)]), minlength=DIMENSIONS) for t in (1, 0))
    expected = (k0 + k1) * float((toxic == 1).mean())
    return np.flatnonzero((k1 - expected) / np.sqrt(expected + 1) >= least)


def grades_of(found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ordered grades: 0 for clean rows; tertiles of the number of telling columns for toxic ones."""
    grade = np.zeros(len(found), int)
    if (toxic == 1).any():
        cuts = np.quantile(found[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
        grade[toxic == 1] = 1 + np.searchsorted(cuts, found[toxic == 1], side="right")
    return grade


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, columns: np.ndarray, rounds: int = 300, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all DIMENSIONS (0 outside ``columns``) and thresholds, by full-batch Adagrad on the cumulative-link log loss."""
    slim = [np.searchsorted(columns, x[np.isin(x, columns)]) for x in rows]
    col = np.concatenate([np.zeros(0, np.int64), *slim])
    of = np.repeat(np.arange(len(rows)), [len(x) for x in slim])
    w, b = np.zeros(len(columns)), np.linspace(0.5, 2.5, GRADES - 1)
    gw, gb = np.full(len(columns), 1e-8), np.full(GRADES - 1, 1e-8)
    y = (grade[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    for _ in range(rounds):
        score = np.bincount(of, w[col], len(rows))
        err = (_sigmoid(score[:, None] - b[None, :]) - y) / max(1, len(rows))
        dw = np.bincount(col, err.sum(1)[of], len(columns)) + l2 * w
        db = -err.sum(0)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b = np.sort(b - rate * db / np.sqrt(gb))
    full = np.zeros(DIMENSIONS)
    full[columns] = w
    return full, b


def severity(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold k."""
    return _sigmoid((w[x].sum() if len(x) else 0.0) - b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
    """Weights, thresholds and the ids of rows that the cut must not be set from, or None without rows of both labels.

    At most ``max_rows`` rows a label come to the driver, and a fifth of them is
    left out of the fit. Where that fifth has under 20 rows of a label all are
    fitted, and the cut is set from them too.
    """
    marks = _marks(labels)
    picked = [
        [r["doc_id"] for r in first_by_hash(marks.where(F.col("toxic") == t), F.xxhash64("doc_id", F.lit(5)), max_rows, "doc_id")] for t in (0, 1)
    ]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    enough = all(sum(map(held, own)) >= 20 for own in picked)
    if enough:
        picked = [[i for i in own if not held(i)] for own in picked]
    if not picked[0] or not picked[1]:
        return None
    wanted = docs.sparkSession.createDataFrame([(d, t) for t in (0, 1) for d in picked[t]], "id long, toxic int")

    def shrink(batches):
        cache: dict = {}
        for b in slices(batches):
            x = [features(t, cache).astype("<i4").tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["toxic"], pa.array(x, pa.binary())], names=["id", "toxic", "x"])

    # At most 2 * max_rows ids are broadcast; only hashed features travel, four bytes each.
    joined = long_rows(docs).select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(wanted), "id").select("id", "toxic", "text")
    got = joined.mapInArrow(shrink, "id long, toxic int, x binary").toPandas().sort_values(["id", "x"], kind="stable")
    rows, toxic = [np.frombuffer(x, "<i4").astype(np.int64) for x in got["x"]], got["toxic"].to_numpy()
    del got
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    columns = telling(rows, toxic)
    grade = grades_of(np.array([np.isin(x, columns).sum() for x in rows]), toxic)
    return (*fit_ordinal(rows, grade, columns), [i for own in picked for i in own] if enough else [])


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def best_cut(counts: pd.DataFrame, weight: float = 4.0) -> float:
    """The margin from which on a text is toxic, from counts n by (bin, toxic).

    It has the largest (toxic share caught) - weight * (clean share called toxic) and lies in the middle of its gap.
    """
    n = np.zeros((2, BINS + 1))
    for b, t, k in counts[["bin", "toxic", "n"]].itertuples(index=False):
        n[int(t), int(b)] += k
    above = n[:, ::-1].cumsum(1)[:, ::-1] / np.maximum(1, n.sum(1, keepdims=True))
    gain = above[1] - weight * above[0]
    full = n.sum(0) > 0
    if not full.any() or (best := np.where(full, gain, -np.inf)).max() <= 0:
        return float("inf")
    k = int(best.argmax())
    lower = np.flatnonzero(full[:k])
    return ((k + (lower[-1] + 1 if len(lower) else k)) / 2) / BINS * 2 * FAR - FAR


VERDICT = "expected_severity double, grade int, p_toxic double, toxic boolean, kept boolean"


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[int]] | None) -> DataFrame:
    """The columns of ``docs``, then expected_severity, grade (the most probable), p_toxic and margin (score less the first threshold)."""
    w, b = model[:2] if model else (np.zeros(DIMENSIONS), np.full(GRADES - 1, 35.0))
    told = docs.sparkSession.sparkContext.broadcast((w, b))
    out = docs.columns

    def run(batches):
        cache: dict = {}
        w, b = told.value
        for batch in slices(batches):
            score = np.array([w[x].sum() if len(x := features(t, cache)) else 0.0 for t in batch["text"].to_pylist()])
            p = _sigmoid(score[:, None] - b[None, :])
            each = -np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in out), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(score - b[0])],
                names=[*out, "expected_severity", "grade", "p_toxic", "margin"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    return long_rows(docs).mapInArrow(run, f"{kinds}, expected_severity double, grade int, p_toxic double, margin double")


def grade_toxicity(docs: DataFrame, labels: DataFrame, keep_columns: bool = False, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, expected_severity double, grade int, p_toxic double, toxic boolean, kept boolean for every row of ``docs(doc_id, text)``.

    The cut between clean and toxic is set from all labelled rows that the fit
    didn't see, counted by score. With ``keep_columns`` all columns of ``docs``
    stand before the verdict's (the text goes through the workers once);
    columns of ``docs`` named like the verdict's are then replaced.
    """
    names = [x.split()[0] for x in VERDICT.split(", ")]
    model = fit_toxicity(docs, labels, max_rows)
    docs = docs.select(*[c for c in docs.columns if c not in (*names, "margin")]) if keep_columns else docs.select("doc_id", "text")
    scored = score_toxicity(docs, model)
    scored = materialise(scored if keep_columns else scored.drop("text"), "toxicity-scores")
    cut = float("inf")
    if model:
        seen = docs.sparkSession.createDataFrame([(i,) for i in model[2]], "doc_id long")  # at most 2 * max_rows ids
        rest = _marks(labels).join(F.broadcast(seen), "doc_id", "left_anti")
        bin_ = F.floor((F.greatest(F.least("margin", F.lit(FAR)), F.lit(-FAR)) + FAR) / (2 * FAR) * BINS).cast("int").alias("bin")
        cut = best_cut(scored.select(F.col("doc_id").cast("long").alias("doc_id"), bin_).join(rest, "doc_id").groupBy("bin", "toxic").agg(F.count("*").alias("n")).toPandas())
    bad = F.col("margin") >= cut
    return scored.select(*(c for c in docs.columns if keep_columns or c == "doc_id"), *names[:3], bad.alias("toxic"), (~bad).alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
