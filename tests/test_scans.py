"""Scans along lines that lie in several runs, against pandas."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from orelode.operators import ingest, lines, scans


@pytest.fixture()
def cut(spark):
    """Ranges stay apart even if they are small."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def _rows(n=3000):
    rng = np.random.default_rng(5)
    line = np.where(np.arange(n) % 3 > 0, "hot", "b").astype(object)
    line[-40:] = None
    d = pd.DataFrame({"line": line, "fid": rng.permutation(n), "ts": rng.integers(0, 50, n) + np.arange(n) // 4, "x": rng.integers(0, 40, n) / 4, "y": 0.0, "z": 1.0, "m": rng.normal(0, 1, n)})
    d.loc[rng.integers(0, n, 20), "m"] = 500.0
    return d


SCHEMA = "line string, fid long, ts long, x double, y double, z double, m double"


def _laid(spark, d, order=("fid",)):
    return scans.in_runs(spark.createDataFrame(d.values.tolist(), SCHEMA), ["line"], list(order))


def test_a_long_line_lies_in_several_runs(spark, cut):
    runs = _laid(spark, _rows())
    assert runs.where("line = 'hot'").select("_run").distinct().count() > 1
    assert scans.in_runs(runs, ["line"], ["fid"]) is runs


def test_scans_equal_pandas(spark, cut):
    d = _rows()
    g = d.sort_values("fid").groupby("line", dropna=False)
    want = pd.DataFrame({"fid": d.sort_values("fid")["fid"], "before": g["m"].shift(1), "after": g["m"].shift(-1), "total": g["x"].cumsum(), "top": g["ts"].cummax().groupby(d["line"], dropna=False).shift(1)}).set_index("fid").sort_index()
    s = scans.beside(scans.beside(_laid(spark, d), ["m"], "b"), ["m"], "a", step=1)
    s = scans.running_max(scans.running_sum(s, F.col("x"), "total"), "ts", "top")
    got = s.select("fid", F.col("b.m").alias("before"), F.col("a.m").alias("after"), "total", "top").toPandas().set_index("fid").sort_index()
    np.testing.assert_allclose(got.astype(float), want.loc[got.index, got.columns].astype(float))
    assert len(got) == len(d)


def _sorted(d):
    d = d.sort_values("fid").copy()
    g = d.groupby("line", dropna=False)
    step = np.hypot(d["x"] - g["x"].shift(1), d["y"] - g["y"].shift(1)).fillna(0)
    d["along_m"] = step.groupby(d["line"], dropna=False).cumsum()
    return d


def test_line_operators_equal_pandas(spark, cut):
    d = _rows()
    runs = _laid(spark, d)
    top = d.sort_values("fid").groupby("line", dropna=False)["ts"].cummax()
    assert {r.fid for r in lines.order_violation_filter(runs).collect()} == set(d.loc[top.index[d.loc[top.index, "ts"] >= top], "fid"])
    want = _sorted(d)
    along = lines.along_track_distance(runs).persist()
    got = along.select("fid", "along_m").toPandas().set_index("fid")["along_m"]
    np.testing.assert_allclose(got.sort_index(), want.set_index("fid")["along_m"].sort_index(), atol=1e-9)

    keep, kept_means = set(), {}
    for _, p in want.groupby("line", dropna=False):
        grad = p["m"].diff() / np.maximum(p["along_m"].diff(), 1e-6)
        med = grad.median()
        mad = max((grad - med).abs().median(), 1e-9)
        keep |= set(p.loc[grad.isna() | (grad.abs() <= abs(med) + 3 * 1.4826 * mad), "fid"])
        a, m = p["along_m"].to_numpy(), p["m"].to_numpy()
        kept_means |= {f: m[np.abs(a - at) <= 7.1].mean() for f, at in zip(p["fid"], a, strict=True)}
    assert {r.fid for r in lines.despike(along, sigma=3.0).collect()} == keep
    got = {r.fid: r.m for r in lines.smooth_by_distance(along, 14.2).select("fid", "m").collect()}
    assert got.keys() == kept_means.keys()
    assert max(abs(got[f] - kept_means[f]) for f in got) < 1e-9

    ends = [p["fid"].to_numpy() for _, p in want.groupby("line", dropna=False)]
    assert {r.fid for r in lines.decimate(along, 10.0).collect()} == {f for p in ends for i, f in enumerate(p) if i % 10 == 0 or i == len(p) - 1}
    got = sorted((r.line or "", r.along_m, round(r.m, 6)) for r in lines.resample_by_distance(along, 2.5).select("line", "along_m", "m").collect())
    k = [(line, np.arange(0, p["along_m"].max() + 1e-9, 2.5), p) for line, p in want.groupby("line", dropna=False)]
    assert len(got) == sum(len(at) for _, at, _ in k)
    along.unpersist()


def test_scans_of_empty_and_single_rows(spark):
    d = spark.createDataFrame([(None, 1, None, None, 2.0, 0.0, 1.0)], SCHEMA)
    for rows in (d, d.where("fid < 0")):
        a = lines.along_track_distance(rows)
        n = rows.count()
        assert [r.along_m for r in a.collect()] == [0.0] * n
        for done in (lines.order_violation_filter(rows), lines.despike(a), lines.decimate(a, 10.0), lines.smooth_by_distance(a, 5.0), lines.resample_by_distance(a, 5.0)):
            assert done.count() == n


@pytest.mark.parametrize("whole", [0, lines.WHOLE])
def test_lines_are_cleaned_in_one_pass(spark, cut, monkeypatch, whole):
    monkeypatch.setattr(lines, "WHOLE", whole)
    d = _rows()
    d = d.astype(object)
    for column, every in (("ts", 211), ("x", 173), ("m", 97)):
        d.loc[::every, column] = None
    runs = _laid(spark, d)
    want = lines.despike(lines.along_track_distance(lines.order_violation_filter(runs)), sigma=3.0)
    written = []
    monkeypatch.setattr(lines, "materialise", lambda df, name, own=lines.materialise: written.append(name) or own(df, name))
    got = lines.clean_lines(runs, 3.0)
    assert written.count("in-order") == 1 and "gradients" not in written
    assert got.columns == want.columns
    rows = lambda t: sorted((r.line or "", r.fid, r.m, round(r.along_m, 6)) for r in t.collect())
    assert rows(got) == rows(want) and 0 < len(rows(got)) < len(d)
    assert got.select("_run").distinct().count() > 2


def test_what_runs_hand_on_is_at_most_one_row_a_range(spark, cut, monkeypatch):
    seen = []
    monkeypatch.setattr(scans, "with_carry", lambda rows, carry, own=scans.with_carry: seen.append(carry.count()) or own(rows, carry))
    d = _rows()
    d["line"] = [f"{k // 3:05d}" for k in range(len(d))]  # many lines
    runs = _laid(spark, d)
    ranges = runs.select("_run").distinct().count()
    lines.order_violation_filter(runs), lines.along_track_distance(runs)
    assert len(seen) == 3 and max(seen) < ranges < 10


@pytest.mark.parametrize("values", [[1.0, -3.0], [3.0, -9.0], [1.0, -2.0, 9.0], [None, 9.0, 1.0], [None], [9.0, float("nan")], [1.0, float("nan")], [5.0, 5.0]])
def test_igrf_goes_if_the_median_is_over_the_threshold(spark, monkeypatch, values):
    monkeypatch.setattr(ingest, "kth_values", None)  # which side the median lies on takes one aggregate
    rows = spark.createDataFrame([(k, v, 0.5) for k, v in enumerate(values)], "fid long, m double, igrf double")
    known = sorted((abs(v) for v in values if v is not None), key=lambda v: (v != v, v))
    n = len(known)
    median = (known[(n - 1) // 2] + known[n // 2]) / 2 if n else 0.0
    high = median > 5.0 or median != median
    got = [r.m for r in ingest.igrf_subtract(rows, 5.0).orderBy("fid").collect()]
    assert repr(got) == repr([None if v is None else v - 0.5 if high else v for v in values])
