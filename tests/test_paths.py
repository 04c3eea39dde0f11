"""Contour lines and composites: places by joins and streams, against plain walks and folds."""

import random

import pytest

from orelode.operators import contours, drillhole

SEG = "level double, x0 double, y0 double, x1 double, y1 double"


def plain_lines(segments):
    """Each component walked from its smallest odd vertex (or smallest), always to the smallest next one."""
    beside = {}
    for _, x0, y0, x1, y1 in segments:
        a, b = (x0, y0), (x1, y1)
        if a != b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    todo, out = set(beside), []
    while todo:
        stack, comp = [min(todo)], set()
        while stack:
            v = stack.pop()
            if v not in comp:
                comp.add(v)
                stack += beside[v]
        todo -= comp
        left = {frozenset((a, b)) for a in comp for b in beside[a]}
        while left:
            degree = {v: sum(v in e for e in left) for v in comp}
            at = min((v for v in comp if degree[v] % 2), default=None) or min(v for v in comp if degree[v])
            path = [at]
            while nxt := [n for n in sorted(beside[at]) if frozenset((at, n)) in left]:
                left.discard(frozenset((at, nxt[0])))
                at = nxt[0]
                path.append(at)
            out.append((path, path[0] == path[-1]))
    return sorted(out)


def shapes():
    ring = [(float(x), float(y)) for x, y in [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]]
    closed = list(zip(ring, ring[1:] + ring[:1]))
    shifted = [((a + 10, b), (c + 10, d)) for (a, b), (c, d) in closed]
    line = [((20.0 + k, float((7 * k) % 5)), (21.0 + k, float((7 * k + 7) % 5))) for k in range(70)]
    eight = [((30.0 + a, 30.0 + b), (30.0 + c, 30.0 + d)) for (a, b), (c, d) in closed] + [((32.0 + a, 32.0 + b), (32.0 + c, 32.0 + d)) for (a, b), (c, d) in closed]
    star = [((50.0, 50.0), (50.0 + dx, 50.0 + dy)) for dx, dy in [(1, 0), (0, 1), (-1, 0)]] + [((51.0, 50.0), (52.0, 50.0)), ((52.0, 50.0), (53.0, 51.0))]
    lasso = [((60.0, 60.0), (61.0, 60.0)), ((61.0, 60.0), (62.0, 60.0))] + [((62.0 + a, 60.0 + b), (62.0 + c, 60.0 + d)) for (a, b), (c, d) in closed]
    theta = [((70.0 + a, 70.0 + b), (70.0 + c, 70.0 + d)) for (a, b), (c, d) in closed] + [((71.0, 70.0), (71.0, 71.0)), ((71.0, 71.0), (71.0, 72.0))]
    return [(1.0, *a, *b) for a, b in closed + shifted + line + eight + star + lasso + theta + [((90.0, 90.0), (90.0, 90.0)), ((80.0, 80.0), (81.0, 80.0))]]


def got_lines(df):
    lines = {}
    for r in df.collect():
        lines.setdefault((r.line_id, r.closed), []).append((r.seq, r.x, r.y))
    assert all([s for s, _, _ in sorted(v)] == list(range(len(v))) for v in lines.values())
    return sorted(([(round(x), round(y)) for _, x, y in sorted(v)], c) for (_, c), v in lines.items())


def test_lines_rings_and_junctions_equal_a_walk(spark):
    data = shapes()
    random.Random(2).shuffle(data)
    flipped = [(lv, c, d, a, b) if k % 3 else (lv, a, b, c, d) for k, (lv, a, b, c, d) in enumerate(data)]
    df = spark.createDataFrame(flipped + flipped[:9], SEG).repartition(4)
    assert got_lines(contours.stitch_contours(df)) == [([tuple(map(round, v)) for v in p], c) for p, c in plain_lines(data)]


@pytest.mark.parametrize("leaf", [4, 12, 40])
def test_lines_within_leaves_and_across_them_equal_a_walk(spark, leaf, monkeypatch):
    """Leaves of few edges: some lines stay within one, others go through joins over all."""
    taken, whole = [], contours._stitch
    monkeypatch.setattr(contours, "_stitch", lambda e, n: taken.append(e.count()) or whole(e, n))
    data = shapes()
    assert got_lines(contours.stitch_contours(spark.createDataFrame(data, SEG).repartition(3), leaf_edges=leaf)) == [([tuple(map(round, v)) for v in p], c) for p, c in plain_lines(data)]
    assert 0 < taken[0] < len(data) - 1


def test_lines_of_one_leaf_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(contours, "_stitch", None)
    data = shapes()
    assert got_lines(contours.stitch_contours(spark.createDataFrame(data, SEG))) == [([tuple(map(round, v)) for v in p], c) for p, c in plain_lines(data)]


def test_long_line_is_ranked_in_few_rounds(spark):
    """A bent line of 3000 segments: places from joins, well under its length in rounds."""
    points = [(float(k), float(abs((k % 200) - 100))) for k in range(3001)]
    df = spark.createDataFrame([(2.0, *a, *b) for a, b in zip(points, points[1:])], SEG).repartition(6)
    (path, closed), = got_lines(contours.stitch_contours(df, 25))
    assert path == [(round(x), round(y)) for x, y in points] and not closed


def test_no_segments(spark):
    assert contours.stitch_contours(spark.createDataFrame([], SEG)).count() == 0
    assert contours.stitch_contours(spark.createDataFrame([(1.0, 2.0, 2.0, 2.0, 2.0)], SEG)).count() == 0


SAMPLE = "hole_id string, from_m double, to_m double, depth_m double, x double, y double, z double, v double, sg double"


def test_composites_equal_a_fold(spark):
    r = random.Random(6)
    rows = [(r.choice("abcd"), round(k * 1.0, 1), round(k + r.choice([0.5, 1.0, 1.5, 0.0]), 1), None if k % 7 == 0 else k + 0.5, 1.0 * k, 2.0, 3.0, r.random(), r.choice([2.0, None])) for k in range(900)]
    got = sorted((x.hole_id, x.from_m, x.to_m, round(x.support_m, 6), round(x.v, 9)) for x in drillhole.composite_intervals(spark.createDataFrame(rows, SAMPLE).repartition(5), 3.0).collect())
    want = []
    for h in "abcd":
        own, group, total = sorted(x for x in rows if x[0] == h), [], 0.0
        for k, x in enumerate(own):
            w = x[2] - x[1] if x[2] > x[1] else 1.0
            group.append((w, x))
            total += w
            if total >= 3.0 or k == len(own) - 1:
                want.append((h, group[0][1][1], group[-1][1][2], round(sum(w for w, _ in group), 6), round(sum(w * x[7] for w, x in group) / sum(w for w, _ in group), 9)))
                group, total = [], 0.0
    assert got == sorted(want)


@pytest.mark.parametrize("batch", [100, 10_000])
def test_one_long_hole_streams(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        hole = spark.range(50_000).selectExpr("'h' as hole_id", "id * 0.5D as from_m", "id * 0.5D + 0.5D as to_m", "id * 0.5D as depth_m", "0D as x", "0D as y", "0D as z", "cast(id as double) as v", "2D as sg")
        df = drillhole.composite_intervals(hole, 2.0)
        assert df.count() == 12_500 and df.agg({"support_m": "min"}).first()[0] == 2.0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
