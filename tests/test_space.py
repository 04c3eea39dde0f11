"""Pair sums and neighbour search by tiles and leaves, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelode.operators import blocks, leaves, neighbours, pairs

POINT = "pid long, x double, y double, z double, v double"


def cloud(n, seed=2, crowded=0.4, twins=0.1):
    """Spread points, a crowd a thousand times as dense, and points that repeat one place."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        u = r.random()
        at = (500.0, 500.0, 0.0) if u < twins else tuple(500 + r.gauss(0, 1) for _ in "xy") + (r.random(),) if u < twins + crowded else (r.uniform(0, 1000), r.uniform(0, 1000), r.uniform(0, 50))
        out.append((k, *at, float(r.randint(0, 9))))
    return out


@pytest.mark.parametrize(("n", "reach", "tile"), [(10_000, 60.0, 1024), (1_500, 300.0, 16), (400, 2.0, 8)])
def test_variogram_equals_all_pairs(spark, n, reach, tile):
    data = cloud(n)
    got = {r.lag: r for r in pairs.lag_sums(spark.createDataFrame(data, POINT).repartition(5), 8, reach, tile).collect()}
    p = np.array(data)
    counts, sums = np.zeros(8), np.zeros(8)
    for k in range(n - 1):
        d = np.sqrt(((p[k + 1 :, 1:4] - p[k, 1:4]) ** 2).sum(1))
        take = (d > 0) & (d <= reach)
        lag = np.minimum((d[take] / (reach / 8)).astype(int), 7)
        counts += np.bincount(lag, minlength=8)
        sums += np.bincount(lag, weights=0.5 * (p[k + 1 :, 4][take] - p[k, 4]) ** 2, minlength=8)
    assert [got[k].pairs if k in got else 0 for k in range(8)] == counts.tolist()
    assert np.allclose([got[k].gamma_sum if k in got else 0 for k in range(8)], sums)


def test_no_row_of_the_variogram_is_a_pair(spark):
    """Rows that leave the comparing tasks are lags, and joined rows are pairs of tiles."""
    points = spark.createDataFrame(cloud(3000), POINT)
    tiles = pairs.point_tiles(points.select(*"xyzv"), ("x", "y", "z"), [*"xyzv"], 100.0, 64)
    # Rows that are equal in all columns share a tile; lag_sums gives them one row with a weight before.
    assert tiles.agg(F.sum(F.size("p"))).first()[0] == 3000
    assert tiles.where("hi_x - lo_x < 20").agg(F.max(F.size("p"))).first()[0] < 3000
    plan = pairs.lag_sums(points, 8, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "half_sq" not in plan
    assert pairs.lag_sums(points, 8, 100.0).count() == 8


def test_pairs_are_dealt_over_units_and_rows_are_sent_a_bounded_number_of_times(spark):
    points = spark.createDataFrame(cloud(3000, twins=0.0), POINT).select(*"xyzv")
    for n in (1500, 3000):
        rows = pairs.block_pairs(points.limit(n), ("x", "y", "z"), [*"xyzv"], 1e5, 32)
        units = rows.groupBy("unit", "side").count().collect()
        assert len({u.unit for u in units}) >= 20 and max(u["count"] for u in units) <= n // 4
        assert sum(u["count"] for u in units) <= 5 * pairs.BLOCKS * n and rows.rdd.getNumPartitions() >= len({u.unit for u in units})


def test_variogram_of_few_points(spark):
    assert {r.pairs for r in blocks.variogram(spark.createDataFrame([], POINT)).collect()} == {0}
    assert {r.pairs for r in blocks.variogram(spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0)] * 5, POINT)).collect()} == {0}
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 3.0, 4.0, 0.0, 3.0), (3, None, 1.0, 1.0, 1.0)], POINT)
    assert [(r.lag_to, r.pairs, r.gamma) for r in blocks.variogram(one, 2, 10.0).orderBy("lag_to").collect()] == [(5.0, 0, 0.0), (10.0, 1, 2.0)]


def test_pair_rows_equal_all_pairs(spark):
    data = cloud(600)
    got = {(r.i, r.j): (r.d, r.half_sq_diff) for r in neighbours.pair_self_join(spark.createDataFrame(data, POINT), 3.0).collect()}
    p = np.array(data)
    d = np.sqrt(((p[:, None, 1:4] - p[None, :, 1:4]) ** 2).sum(2))
    want = {(a, b): (d[a, b], 0.5 * (p[a, 4] - p[b, 4]) ** 2) for a, b in zip(*np.nonzero(np.triu(d <= 3.0, 1)))}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    named = spark.createDataFrame([("b", 0.0, 0.0, 0.0, 1.0), ("a", 1.0, 0.0, 0.0, 1.0)], POINT.replace("pid long", "pid string"))
    assert [(r.i, r.j) for r in neighbours.pair_self_join(named, 3.0).collect()] == [("a", "b")]


def plain_nearest(left, points, k, dims, radius=0.0, exclude_self=False):
    out = []
    p = np.array([x[1 : 1 + dims] for x in points])
    ids = np.array([x[0] for x in points])
    for q in left:
        d = np.sqrt(((p - np.array(q[1 : 1 + dims])) ** 2).sum(1))
        if exclude_self:
            d[ids == q[0]] = np.inf
        order = [x for x in np.lexsort((ids, d))[: k + 1] if np.isfinite(d[x]) and (not radius or d[x] <= radius)][:k]
        out += [(q[0], int(ids[x]), rank, round(float(d[x]), 9)) for rank, x in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "radius", "leaf", "sample", "own"), [(5, 0.0, 24, 60, False), (3, 0.0, 64, 40, True), (4, 40.0, 30, 5000, False), (12, 0.0, 10, 3, False)])
def test_leaves_find_the_nearest(spark, k, radius, leaf, sample, own):
    """Crowds at a thousand times the density, a place of many points, far-off query rows, tiny samples."""
    from orelode.operators.leaves import nearest

    data = cloud(1200, 5)
    r = random.Random(8)
    left = [(x[0], *x[1:4]) for x in data[::9]] if own else [(k, r.uniform(-2000, 3000), r.uniform(-300, 1300), r.uniform(0, 50)) for k in range(60)] + [(100 + k, 500.0, 500.0, 0.0) for k in range(40)]
    got = nearest(spark.createDataFrame(left, "id long, x double, y double, z double").repartition(3), spark.createDataFrame(data, POINT).repartition(4), k, radius, ("x", "y", "z"), own, leaf, sample)
    assert sorted((x.id, x.pid, x["rank"], round(x.d, 9)) for x in got.collect()) == plain_nearest(left, data, k, 3, radius, own)


def test_no_leaf_is_large(spark):
    from orelode.operators import leaves

    points = spark.createDataFrame([x for x in cloud(4000, 3, twins=0.0)], POINT)
    for sample in (40, 3000):
        splits, sent = leaves.partition(points, ("x", "y"), 50, sample)
        sizes = [r["count"] for r in leaves.with_leaf(points, sent, ("x", "y")).groupBy("leaf").count().collect()]
        assert max(sizes) <= 50 and sum(sizes) == 4000 and len(sizes) <= splits.leaves


def test_methods_share_one_search(spark, tmp_path):
    """Four methods read one table of gathered neighbours: no search, window or shuffle of neighbours is repeated for each."""
    from orelode.plans import grid_queries

    spark.range(300).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(200).selectExpr("id as vec_id", "int(id % 3) as label", "transform(sequence(1, 4), k -> float((id * 37 * k) % 101) / 50 - 1) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = grid_queries.interpolate(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 1200 and not any(node in plan for node in ("MapIn", "Window", "Aggregate"))


def test_a_small_table_of_many_places_is_many_tasks(spark, monkeypatch):
    from orelode.operators import neighbours

    monkeypatch.setattr(neighbours, "TASK_PAIRS", 1000)
    left = spark.range(0, 100, 1, 1).selectExpr("id", "double(id % 10) as x", "double(id div 10) as y")
    points = spark.range(50).selectExpr("id as pid", "double(id % 10) as x", "double(id div 10) as y", "double(id) as v")
    got = neighbours.knn(left, points, 2)
    assert got.rdd.getNumPartitions() >= 5
    assert {(x.id, x.pid) for x in got.where("rank = 1").collect()} >= {(k, k) for k in range(50)}


def test_equal_distances_go_by_pid_though_their_squares_differ():
    import numpy as np

    from orelode.operators import leaves

    d2 = np.array([[2.0000000000000004, 2.0, 5.0]])
    assert np.sqrt(d2[0, 0]) == np.sqrt(d2[0, 1])
    assert leaves.smallest(d2, np.array([np.inf]), 1)[1].tolist() == [0]


def test_squares_rank_what_has_one_root(spark):
    """The places of a grid are often as far up to the last bits: by squares the smaller one comes first, whatever its pid, in both searches."""
    at = [(j * 1000 + i, i / 13 * 190.0, j / 66 * 990.0, float(i - j)) for j in range(67) for i in range(14)]
    points = [x for x in at if sum(divmod(x[0], 1000)) % 11]
    left = [x[:3] for x in at if not sum(divmod(x[0], 1000)) % 11]
    p = np.array(points)
    want, other = set(), set()
    for k, x, y in left:
        d2 = (x - p[:, 1]) ** 2 + (y - p[:, 2]) ** 2
        want |= {(k, int(p[j, 0]), r) for r, j in enumerate(np.lexsort((p[:, 0], d2))[:24], 1)}
        other |= {(k, int(p[j, 0]), r) for r, j in enumerate(np.lexsort((p[:, 0], np.sqrt(d2)))[:24], 1)}
    assert want != other
    left, points = spark.createDataFrame(left, "id long, x double, y double").repartition(3), spark.createDataFrame(points, "pid long, x double, y double, v double").repartition(3)
    for most in (50_000, 0):
        got = neighbours.knn(left, points, 24, broadcast_rows=most, squares=True).collect()
        assert {(x.id, x.pid, x["rank"]) for x in got} == want
        assert max(x.d for x in got) < 120  # roots, not squares


def test_rows_go_down_the_tree_by_level(monkeypatch):
    r = np.random.default_rng(3)
    seen = np.concatenate([r.normal(0, 1, (4000, 2)), np.full((500, 2), 0.25)])
    tree = leaves.Splits()
    tree.divide(0, seen, len(seen), 4, np.array([seen.min(0), seen.max(0)]))
    assert tree.leaves > 500

    def down(row):
        node = 0
        while tree.dim[node] >= 0:
            node = tree.kids[node][0 if row[tree.dim[node]] < tree.cut[node] else 1]
        return tree.leaf[node]

    rows = np.concatenate([seen[::10], r.normal(0, 3, (200, 2)), [[np.nan, 0.0], [np.inf, -np.inf]]])
    want = [down(row) for row in rows]

    class Counted(list):
        read = 0

        def __getitem__(self, k):
            Counted.read += 1
            return super().__getitem__(k)

    tree.dim = Counted(tree.dim)
    assert tree.of(rows).tolist() == want
    assert Counted.read < 50  # not one step a node
    assert tree.of(rows[:0]).tolist() == []
    big = tree.leaf.index(want[0])  # cut again: the arrays are made anew
    tree.divide(want[0], seen[:40], 40, 4, np.array([seen.min(0), seen.max(0)]))
    assert tree.dim[big] >= 0 and tree.of(rows).tolist() == [down(row) for row in rows]
