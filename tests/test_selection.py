"""Radix selection against sorting."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from orelode.operators import selection, stats

FRACTIONS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def nearest(values, p):
    return sorted(values)[int((len(values) - 1) * p + 0.5)]


def columns():
    r = random.Random(4)
    return {
        "spread": [r.gauss(0, 1e3) for _ in range(3000)], "outlier": [r.random() for _ in range(999)] + [1e300], "ties": [float(r.randint(-2, 2)) for _ in range(2000)],
        "one": [7.5], "tiny": [5e-324, -5e-324, 0.0, -0.0, 1e-310], "infinite": [math.inf, -math.inf, 1.0, 2.0],
    }


@pytest.mark.parametrize("few", [0, 40, selection.FEW])
def test_groups_and_all_rows_equal_sorting(spark, monkeypatch, few):
    """With all four passes, and with the direct end."""
    monkeypatch.setattr(selection, "FEW", few)
    cols = columns()
    rows = [(g if g != "one" else None, v) for g, vs in cols.items() for v in vs] + [("spread", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for linear in (False, True):
        got = {(r.g["g"], r.i): r.value for r in selection.selected(selection.keyed(df, "v", ["g"]), FRACTIONS, linear).collect()}
        assert len(got) == len(cols) * len(FRACTIONS)
        for g, vs in cols.items():
            for i, p in enumerate(FRACTIONS):
                if linear and g == "infinite":
                    continue
                want = float(np.quantile(vs, p)) if linear else nearest(vs, p)
                assert math.isclose(got[None if g == "one" else g, i], want, rel_tol=1e-12, abs_tol=0.0 if not linear else 1e-320), (g, p, linear)
    every = [v for vs in cols.values() for v in vs]
    assert selection.kth_values(df, "v", FRACTIONS) == [nearest(every, p) for p in FRACTIONS]
    assert selection.kth_values(df.where("v is null"), "v", [0.5]) == [None]


def test_keys_keep_the_order_and_come_back():
    v = np.array(sorted(x for c in columns().values() for x in c))
    keys = selection.to_keys(v)
    assert (np.diff(keys) >= 0).all() and (selection.from_keys(keys) == v).all()
    assert selection.to_keys(np.array([np.nan]))[0] > selection.to_keys(np.array([np.inf]))[0]
    assert selection.to_keys(np.array([-0.0]))[0] == selection.to_keys(np.array([0.0]))[0]


def test_profile_with_an_outlier(spark):
    df = spark.createDataFrame([(str(k),) for k in range(101)] + [("1e308",), ("n/a",), (None,), ("1,5",)], "t string")
    r = stats.numeric_profile(df, "t").first()
    assert (r.n, r.missing, r.min, r.max, r.p50) == (103, 2, 0.0, 1e308, 50.0)
    assert stats.numeric_profile(df.where("t = 'n/a'"), "t").first().p50 is None


def test_median_mad_by_group(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", None), ("a", 2.0), ("a", 10.0), (None, 5.0), (None, 7.0), ("c", None), ("d", 3.0)]
    got = {r.k: (r.median, r.mad) for r in stats.median_mad(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert got == {"a": (3.0, 1.5), None: (6.0, 1.0), "c": (None, 1e-9), "d": (3.0, 1e-9)}
    assert stats.median_mad(spark.createDataFrame([], "k string, v double"), "v", ["k"]).count() == 0


def test_table_profile_ends(spark):
    for n in (0, 3, 40):
        d = spark.range(n).select((F.col("id") * 7 % 41).alias("k"), F.lit("x").alias("v"))
        keys = sorted(i * 7 % 41 for i in range(n))
        got = {(r.part, r.row_no): r["values"] for r in stats.table_profile(d, ["k"], 12).collect()}
        want = {("count", n): "k,v"}
        want |= {("head", i): f'{{"k":{keys[i]},"v":"x"}}' for i in range(min(n, 12))}
        want |= {("tail", i): f'{{"k":{keys[i]},"v":"x"}}' for i in range(max(n - 12, 0), n)}
        assert got == want
