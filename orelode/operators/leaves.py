"""Nearest neighbours by an adaptive partition of space.

k-d splits come from a bounded sample of the points; leaves that turn out to
hold too many are sampled and split again, until none holds more than
``LEAF``. Only splits and the leaves' bounding boxes go to the driver and the
tasks. A query row first meets its own leaf; its k-th distance there tells
which other leaves its ball touches, and it is sent to these, the nearest
first, a few at a time, so that a far-off row shrinks its ball before it goes
to many. Crowds of any density have small leaves; nothing is widened.

Of the points at one place only the first ``k`` + 1 by pid can be among the
nearest, so the others go beforehand and a place is never larger than a leaf.
Query rows of one leaf are packed in groups, so a crowd of them is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Points of a leaf; with over MOST_LEAVES times that many points leaves are larger, as every task gets the splits.
LEAF, MOST_LEAVES = 4096, 200_000
#: Points that the driver sees at once when it chooses splits.
SAMPLE = 50_000
#: Query rows that meet a leaf in one row of the plan, and leaves that a row is sent to at first.
QUERIES, AT_ONCE = 2048, 8


class Splits:
    """A k-d tree: per node its dimension (-1: a leaf), cut, children, leaf number; later each node's bounding box."""

    def __init__(self):
        self.dim, self.cut, self.kids, self.leaf = [-1], [0.0], [(0, 0)], [0]
        self.leaves = 1
        self.box: np.ndarray | None = None
        self._flat: tuple[np.ndarray, ...] | None = None  # the lists as arrays; nodes only come in pairs, so the length tells if they are old

    def divide(self, leaf: int, rows: np.ndarray, count: float, most: float, whole: np.ndarray) -> None:
        """Cut a leaf by medians of its sample until its parts should hold at most ``most`` of ``count`` points."""
        share = count / max(len(rows), 1)
        todo = [(self.leaf.index(leaf), rows, True)]
        while todo:
            node, own, first = todo.pop()
            if not first and (len(own) * share <= most or len(own) < 4):
                continue
            found = self._median(own)
            if found is None and first:  # the sample sees one place only: halve the leaf's box
                k = int(np.argmax(whole[1] - whole[0]))
                found = k, float(whole[0][k] + (whole[1][k] - whole[0][k]) / 2)
                found = found if found[1] > whole[0][k] else (k, float(whole[1][k]))
            if found is None:
                continue
            k, cut = found
            at = len(self.dim)
            self.dim += [-1, -1]
            self.cut += [0.0, 0.0]
            self.kids += [(0, 0), (0, 0)]
            self.leaf += [self.leaf[node], self.leaves]
            self.leaves += 1
            self.dim[node], self.cut[node], self.kids[node], self.leaf[node] = k, cut, (at, at + 1), -1
            left = own[:, k] < cut if len(own) else np.zeros(0, bool)
            todo += [(at, own[left], False), (at + 1, own[~left], False)]

    @staticmethod
    def _median(rows: np.ndarray) -> tuple[int, float] | None:
        if len(rows) < 2:
            return None
        k = int(np.argmax(rows.max(0) - rows.min(0)))
        values = np.sort(rows[:, k])
        if values[0] == values[-1]:
            return None
        cut = values[len(values) // 2]
        return k, float(cut if cut > values[0] else values[np.searchsorted(values, cut, "right")])

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row lies in: all rows go down a level at once, so a batch costs the tree's depth, not its nodes."""
        if self._flat is None or len(self._flat[0]) != len(self.dim):
            self._flat = np.array(self.dim, np.int32), np.array(self.cut, float), np.array(self.kids, np.int32), np.array(self.leaf, np.int32)
        dim, cut, kids, leaf = self._flat
        node, own = np.zeros(len(rows), np.int32), np.arange(len(rows))
        while len(own := own[dim[node[own]] >= 0]):
            at = node[own]
            right = ~(rows[own, dim[at]] < cut[at])
            node[own] = kids[at, right.astype(np.int32)]
        return leaf[node]

    def bound(self, boxes: dict[int, np.ndarray], dims: int) -> None:
        """Each node's box (least and largest coordinates) from its leaves'; a leaf without points is nowhere."""
        self.box = np.empty((len(self.dim), 2, dims))
        for node in range(len(self.dim) - 1, -1, -1):  # children come after their parent
            if self.dim[node] < 0:
                self.box[node] = boxes.get(self.leaf[node], np.array([[np.inf] * dims, [-np.inf] * dims]))
            else:
                a, b = (self.box[k] for k in self.kids[node])
                self.box[node] = np.minimum(a[0], b[0]), np.maximum(a[1], b[1])

    def touching(self, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, leaf, distance of every leaf whose box is within a row's reach."""
        found, todo = [], [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            lo, hi = self.box[node]
            if not len(own) or lo[0] > hi[0]:
                continue
            d = np.sqrt((np.maximum(np.maximum(lo - rows[own], rows[own] - hi), 0.0) ** 2).sum(1))
            near = d <= reach[own] * (1 + 1e-12)
            own, d = own[near], d[near]
            if self.dim[node] < 0:
                found.append((own, np.full(len(own), self.leaf[node]), d))
            else:
                todo += [(k, own) for k in self.kids[node]]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(3))


def _matrix(batch, dims: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(d).to_numpy(zero_copy_only=False).astype(float) for d in dims], 1) if batch.num_rows else np.zeros((0, len(dims)))


def with_leaf(df: DataFrame, splits, dims: tuple[str, ...], name: str = "leaf") -> DataFrame:
    """``df`` with the leaf of each row; ``splits`` is a broadcast."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.value.of(_matrix(b, dims)))], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` int")


def partition(points: DataFrame, dims: tuple[str, ...], leaf_rows: int = LEAF, sample: int = SAMPLE) -> tuple[Splits, object]:
    """Splits under which no leaf holds over ``leaf_rows`` points (unless they are at one place), and their broadcast."""
    splits, spark = Splits(), points.sparkSession
    least = [f(d).alias(f"{n}_{d}") for n, f in (("lo", F.min), ("hi", F.max)) for d in dims]
    while True:
        sent = spark.sparkContext.broadcast(splits)
        own = with_leaf(points.select(*dims), sent, dims)
        rows = own.groupBy("leaf").agg(F.count("*").alias("n"), *least).collect()  # a row a leaf
        boxes = {r["leaf"]: np.array([[r[f"{n}_{d}"] for d in dims] for n in ("lo", "hi")]) for r in rows}
        big = {r["leaf"]: r["n"] for r in rows if r["n"] > leaf_rows and (boxes[r["leaf"]][0] < boxes[r["leaf"]][1]).any()}
        if not big:
            splits.bound(boxes, len(dims))
            return splits, spark.sparkContext.broadcast(splits)
        share = min(1.0, sample / sum(big.values()))
        seen = own.where(F.col("leaf").isin(list(big)) & (F.pmod(F.xxhash64(*dims), F.lit(1_000_003)) < share * 1_000_003)).toPandas()
        parts = {k: g[list(dims)].to_numpy(float) for k, g in seen.groupby("leaf")}
        for leaf, n in big.items():
            splits.divide(leaf, parts.get(leaf, np.zeros((0, len(dims)))), n, leaf_rows / 2, boxes[leaf])


def smallest(d2: np.ndarray, reach: np.ndarray, k: int, squares: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance (its square, if ``squares``) of each row's k smallest within its reach; equal ones in order of columns."""
    if d2.shape[1] > k:
        least = np.partition(d2, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(d2 <= least[:, None] * (1 + 1e-15))  # squares that differ in their last bits have one root
    else:
        i, j = np.nonzero(np.isfinite(d2))
    d = np.sqrt(d2[i, j])
    near = np.isfinite(d) & (d <= reach[i])
    i, j, d = i[near], j[near], (d2[i, j] if squares else d)[near]
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], d[place < k]


def _meet(queries: DataFrame, leaves: DataFrame, dims: tuple[str, ...], k: int, exclude_self: bool, schema: str, squares: bool = False) -> DataFrame:
    """id, pid, d (its square, if ``squares``), v: the k nearest points of ``queries(id, dims, reach, leaf)`` in that leaf, equal d by pid."""
    # Nothing is shuffled by leaf alone: of few leaves one can hold most rows. The counts are a row a leaf (bounded by MOST_LEAVES).
    parts = F.broadcast(queries.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).alias("_n")))
    packed = queries.join(parts, "leaf").groupBy("leaf", F.pmod(F.xxhash64("id", *dims), F.col("_n")).alias("_part")).agg(F.collect_list(F.struct("id", *dims, "reach")).alias("q"))
    copies = leaves.join(parts, "leaf").select("leaf", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_part"))
    both = packed.join(copies, ["leaf", "_part"]).select("q", "p")

    def run(batches):
        for batch in batches:
            cuts = [(x.offsets.to_numpy(), x.values) for x in (batch.column("q"), batch.column("p"))]
            for row in range(batch.num_rows):
                q, p = (values.slice(at[row], at[row + 1] - at[row]) for at, values in cuts)
                xq, xp = (np.stack([np.asarray(s.field(d), float) for d in dims], 1) for s in (q, p))
                reach = np.asarray(q.field("reach"), float)
                own = np.asarray(pc.fill_null(pc.index_in(q.field("id"), p.field("pid")), -1)) if exclude_self else None
                step = max(1, (1 << 20) // len(p))
                for lo in range(0, len(q), step):
                    d2 = np.zeros((min(step, len(q) - lo), len(p)))
                    for n in range(len(dims)):
                        d2 += (xq[lo : lo + step, n, None] - xp[None, :, n]) ** 2
                    if exclude_self:
                        at = np.flatnonzero(own[lo : lo + step] >= 0)
                        d2[at, own[lo : lo + step][at]] = np.inf
                    i, j, d = smallest(d2, reach[lo : lo + step], k, squares)
                    yield pa.RecordBatch.from_arrays([q.field("id").take(pa.array(lo + i)), p.field("pid").take(pa.array(j)), pa.array(d), p.field("v").take(pa.array(j))], names=["id", "pid", "d", "v"])

    return both.mapInArrow(run, schema)


def nearest(left: DataFrame, points: DataFrame, k: int, radius: float, dims: tuple[str, ...], exclude_self: bool = False, leaf_rows: int = LEAF, sample: int = SAMPLE, squares: bool = False) -> DataFrame:
    """id, pid, rank, d, v: the k nearest of ``points(pid, dims, v)`` to each row of ``left(id, dims)``; ids are unique, equal distances (their squares, if ``squares``) go by pid."""
    root = F.sqrt if squares else F.col  # d is a square until the end
    known = lambda df, key: df.where(" and ".join(f"`{d}` is not null and not isnan(`{d}`)" for d in dims)).select(key, *(F.col(d).cast("double").alias(d) for d in dims), *(["v"] if key == "pid" else []))
    place = Window.partitionBy(*dims).orderBy("pid")
    first = known(points, "pid").withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r")
    first = materialise(first.withColumn("v", F.col("v").cast("double")), "points")
    leaf_rows = max(leaf_rows, 4 * (k + 1), -(-first.count() * 4 // MOST_LEAVES))
    _, splits = partition(first, dims, leaf_rows, sample)
    leaves = materialise(with_leaf(first, splits, dims).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pid", *dims, "v"))).alias("p")), "leaves")
    kinds = left.schema["id"].dataType.simpleString(), points.schema["pid"].dataType.simpleString()
    found = f"id {kinds[0]}, pid {kinds[1]}, d double, v double"
    limit = float(radius) if radius > 0 else float("inf")
    w = Window.partitionBy("id").orderBy("d", "pid")
    queries = materialise(with_leaf(known(left, "id"), splits, dims).withColumn("reach", F.lit(limit)), "queries")
    best = materialise(_meet(queries, leaves, dims, k, exclude_self, found, squares), "nearest")
    todo, at_once = queries.select("id", *dims, F.col("leaf").alias("own"), F.lit(-1.0).alias("last_d"), F.lit(-1).alias("last_leaf")), AT_ONCE
    names = ["id", *dims, "own", "reach", "leaf", "last_d", "last_leaf", "more"]
    schema = f"id {kinds[0]}, {', '.join(f'`{d}` double' for d in dims)}, own int, reach double, leaf int, last_d double, last_leaf int, more boolean"
    while True:
        far = best.groupBy("id").agg(F.count("*").alias("_n"), F.max("d").alias("_d"))
        rows = todo.join(far, "id", "left").withColumn("reach", F.when(F.col("_n") >= k, root("_d")).otherwise(F.lit(limit))).select("id", *dims, "own", "reach", "last_d", "last_leaf")

        def send(batches, at_once=at_once):
            for b in batches:
                x, reach = _matrix(b, dims), b.column("reach").to_numpy()
                own, last_d, last_leaf = (b.column(c).to_numpy() for c in ("own", "last_d", "last_leaf"))
                i, leaf, d = splits.value.touching(x, reach)
                new = (leaf != own[i]) & ((d > last_d[i]) | ((d == last_d[i]) & (leaf > last_leaf[i])))
                i, leaf, d = i[new], leaf[new], d[new]
                order = np.lexsort((leaf, d, i))
                i, leaf, d = i[order], leaf[order], d[order]
                start = np.searchsorted(i, i)
                place = np.arange(len(i)) - start
                more = np.bincount(i, minlength=b.num_rows)[i] > at_once
                last = (np.minimum(start + at_once, np.searchsorted(i, i, "right")) - 1)[place < at_once]
                take = place < at_once
                t = pa.array(i[take])
                yield pa.RecordBatch.from_arrays([b.column("id").take(t), *(b.column(c).take(t) for c in dims), b.column("own").take(t), b.column("reach").take(t), pa.array(leaf[take].astype(np.int32)), pa.array(d[last].astype(float)), pa.array(leaf[last].astype(np.int32)), pa.array(more[take])], names=names)

        sent = materialise(rows.mapInArrow(send, schema), "touched")
        if sent.isEmpty():
            return best.withColumn("rank", F.row_number().over(w)).select("id", "pid", "rank", root("d").alias("d"), "v")
        got = best.unionByName(_meet(sent.select("id", *dims, "reach", "leaf"), leaves, dims, k, exclude_self, found, squares))
        best = materialise(got.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"), "nearest")
        todo = sent.where("more").groupBy("id").agg(*(F.first(c).alias(c) for c in (*dims, "own", "last_d", "last_leaf")))
        at_once *= 4
