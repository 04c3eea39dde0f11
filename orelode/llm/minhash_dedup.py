"""MinHash near-dedup by an LSH forest over sets of word shingles.

Each distinct set has ``TREES`` signature orders of ``DEPTH`` min-hashes. The
orders are sorted over all partitions; neighbours in an order whose longest
common prefix has at least ``shared`` hashes are a region (4 at 0.8 or more: the
chance that a pair at the threshold is in none is (1 - t ** 4) ** 16, 2e-4 at
0.8 and 7e-6 at 0.85). Where over ``REGION`` documents share a prefix the depth
adapts: each meets those next to it in the order, with the longest prefixes.
Crowded regions whose documents the links don't hold together by then get a
second forest of longer orders (``DEEP_SHARED`` hashes in common, as many trees
as keep the chance under ``MISS``). What is crowded in that one too, and still
isn't one component, is compared block by block. A region cut by a partition's
end loses pairs in one tree only.

In a region the share of equal min-hashes over all trees estimates the
similarity; pairs whose estimate lies ``SIGMAS`` deviations below the threshold
are dropped. Components of the others are compared on full sets: small ones in
one group each; in larger ones each document first meets its two likeliest
neighbours of each region, then all others that this left in another component.

Edge cases: a null or blank text has no set (n_shingles 0) and links with
nothing. A text of fewer words than a shingle has is one shingle. A null doc_id
is its own component. Rows that share an id are one document, which links with
what any of its texts links with. Very long texts are read whole. Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, long_rows, lower_ascii, materialise, read_table, roots, slices
from .embedding_dedup import contiguous

TREES, DEPTH = 16, 8
REGION, BLOCK, SIGMAS, MISS = 64, 256, 3.5, 3e-4
#: Orders of crowded documents: their length, and how many hashes documents of a region share.
DEEP, DEEP_SHARED = 12, 8
#: Rows of a sorted order in one task.
ORDER_ROWS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words."""
    words = lower_ascii(text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    s = np.full(n, len(words[:width]), np.uint64)
    for k in range(min(width, len(h))):
        s = s * _STEP + h[k : k + n]
    return np.unique(_mix(s))


def _odd(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def signature(own: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash, one for each multiplier."""
    low = np.full(len(odd), np.iinfo(np.uint64).max)
    for k in range(0, len(own), 2048):
        low = np.minimum(low, (own[k : k + 2048, None] * odd[None, :]).min(0))
    return (_mix(low) >> np.uint64(48)).astype("<u2")


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def document_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), sig (binary)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        hashes, odd = _WordHash(), _odd(TREES * DEPTH)
        for b in slices(batches):
            own = [shingle_set(t, hashes, width) for t in b["text"].to_pylist()]
            sig = [signature(x, odd).tobytes() if len(x) else None for x in own]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, own), pa.int64()), pa.array(map(_digest, own), pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "key", "sig"])

    return long_rows(docs).mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary")


def set_classes(sets: DataFrame) -> DataFrame:
    """id (a number for each distinct set), rep (its smallest doc_id), key, sig; written once, so the numbers stay."""
    own = sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    return materialise(own.select(F.monotonically_increasing_id().alias("id"), "rep", "key", "sig"), "set-classes")


def full_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members(id, rep, key, ...)`` with their sets (shingles, array of hashes) instead of rep and key."""
    names = members.columns
    rows = long_rows(docs).select(F.col("doc_id").cast("long").alias("rep"), "text").hint("merge").join(members, "rep").select(*names, "text")

    def run(batches):
        hashes = _WordHash()
        for b in slices(batches):
            own = [shingle_set(t, hashes, width) for t in b["text"].to_pylist()]
            right = [k for k, (x, key) in enumerate(zip(own, b["key"].to_pylist(), strict=True)) if _digest(x) == key]
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(right, pa.int64())) for c in names), pa.array([own[k].astype(np.int64) for k in right], pa.list_(pa.int64()))], names=[*names, "shingles"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return materialise(rows.mapInArrow(run, f"{fields}, shingles array<long>").dropDuplicates(["id"]).drop("rep", "key"), "full-sets")


def sorted_orders(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """tree, order (big-endian hashes), id of ``classes(id, sig)``: the forest's signature orders, sorted over all partitions.

    The id is part of the order, so a prefix that a third of all documents
    share is dealt over many partitions.
    """

    def run(batches):
        for p in batches:
            sig = np.frombuffer(b"".join(p["sig"]), "<u2").reshape(len(p), trees, depth).astype(">u2")
            for t in range(trees):
                flat = sig[:, t].tobytes()
                yield pd.DataFrame({"tree": np.full(len(p), t, np.int32), "order": [flat[k : k + 2 * depth] for k in range(0, len(flat), 2 * depth)], "id": p["id"].to_numpy()})

    rows = classes.select("id", "sig").mapInPandas(run, "tree int, order binary, id long")
    parts = max(1, -(-classes.count() * trees // ORDER_ROWS))
    return rows.repartitionByRange(parts, "tree", "order", "id").sortWithinPartitions("tree", "order", "id")


def regions_of(tree: np.ndarray, h: np.ndarray, shared: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, region, crowded) from a sorted order's rows: neighbours whose common prefix has at least ``shared`` hashes.

    Up to REGION such neighbours are one region. Where there are more, each
    row meets those next to it in the order, which have the longest prefixes in
    common: windows of REGION rows, a quarter over the next. So the depth adapts.
    """
    lcp = np.cumprod(h[1:] == h[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
    start = np.flatnonzero(np.append(True, lcp < shared))
    size = np.diff(np.append(start, len(h)))
    of = np.repeat(np.arange(len(start)), size)
    crowded, at = size[of] > REGION, np.arange(len(h)) - start[of]
    key = tree.astype(np.uint64) + np.uint64(1)
    for k in range(shared):
        key = _mix(key * _STEP + h[:, k].astype(np.uint64))
    stride = max(1, REGION * 3 // 4)
    window = at // stride
    own = np.where(crowded, _mix(key + _STEP * (window + 1).astype(np.uint64) + np.uint64(part + 1)), key)
    last = _mix(key + _STEP * window.astype(np.uint64) + np.uint64(part + 1))
    rows, again = np.flatnonzero(size[of] > 1), np.flatnonzero(crowded & (window > 0) & (at % stride < REGION - stride))
    return np.append(rows, again), np.append(own[rows], last[again]).astype(np.int64), crowded[np.append(rows, again)]


def forest_regions(orders: DataFrame, depth: int, shared: int) -> DataFrame:
    """region, id, crowded, run (of all its neighbours) for the rows of the sorted orders that have neighbours."""

    def run(batches):
        from pyspark import TaskContext

        parts = [(p["tree"].to_numpy(), np.frombuffer(b"".join(p["order"]), ">u2").reshape(-1, depth), p["id"].to_numpy()) for p in batches if len(p)]
        if parts:
            tree, h, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows, region, crowded = regions_of(tree, h, shared, TaskContext.get().partitionId())
            whole = tree.astype(np.uint64) + np.uint64(1)
            for k in range(shared):
                whole = _mix(whole * _STEP + h[:, k].astype(np.uint64))
            for k in range(0, len(rows), 50_000):
                r = rows[k : k + 50_000]
                yield pd.DataFrame({"region": region[k : k + 50_000], "id": ids[r], "crowded": crowded[k : k + 50_000], "run": whole[r].astype(np.int64)})

    return materialise(orders.mapInPandas(run, "region long, id long, crowded boolean, run long"), "regions")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal min-hashes of each row of a with each row of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(b), 64):
        out[:, k : k + 64] = (a[:, None, :] == b[None, k : k + 64, :]).mean(2)
    return out


def _likely(threshold: float, hashes: int = TREES * DEPTH) -> float:
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / hashes)


def _candidates(threshold: float, what: str):
    """Pairs of each region that the estimate doesn't rule out.

    ``forest``: as many as connect what they connect. ``best``: each document
    with the two likeliest. ``across``: all in different components (comp).
    """

    def run(batches):
        for p, groups in contiguous(batches, ["region"]):
            ids, left, right = p["id"].to_numpy(), [], []
            sig = np.frombuffer(b"".join(p["sig"]), "<u2").reshape(len(p), -1)
            least = _likely(threshold, sig.shape[1])
            comp = p["comp"].to_numpy() if what == "across" else None
            for a, b in groups:
                if b - a > 1:
                    est = _alike(sig[a:b], sig[a:b])
                    np.fill_diagonal(est, 0)
                    if what == "best":
                        j = np.argsort(-est, axis=1)[:, :2]
                        i = np.repeat(np.arange(b - a), j.shape[1])
                        j = j.ravel()
                        on = est[i, j] >= least
                        i, j = i[on], j[on]
                    else:
                        on = np.triu(est >= least, 1)
                        if what == "across":
                            on &= comp[a:b, None] != comp[None, a:b]
                        i, j = np.nonzero(on)
                    left.append(ids[a + i])
                    right.append(ids[a + j])
            if left and sum(map(len, left)):
                x, y = np.concatenate(left), np.concatenate(right)
                if what == "forest":
                    nodes, low = roots(x, y)
                    yield pd.DataFrame({"a": nodes, "b": low})[nodes != low]
                else:
                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).query("a < b").drop_duplicates()

    return run


def by_document(regions: DataFrame) -> DataFrame:
    """id, regions of ``regions(region, id)``: one row a document, with two regions a tree at most. Joins on id keep to that."""
    return materialise(regions.groupBy("id").agg(F.collect_list("region").alias("regions")), "regions-by-document")


def region_pairs(own: DataFrame, classes: DataFrame, threshold: float, what: str, parts: int) -> DataFrame:
    """a, b from ``own(id, regions[, comp])``, one row a document."""
    rows = own.join(classes.select("id", "sig"), "id").select(F.explode("regions").alias("region"), "id", "sig", *(["comp"] if what == "across" else []))
    return rows.repartition(parts, "region").sortWithinPartitions("region").mapInPandas(_candidates(threshold, what), "a long, b long")


def _least_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest value that each row of x shares with the same row of y; both are padded, with a value of their own each."""
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        a, b = x[k : k + 4096], y[k : k + 4096]
        on = (a[:, :, None] == b[:, None, :]).any(2)
        out[k : k + 4096] = np.where(on, a, np.iinfo(np.int64).max).min(1)
    return out


def _padded(lists: list, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for row, own in zip(out, lists, strict=True):
        row[: len(own)] = own
    return out


def _across_blocks(threshold: float):
    """Candidates in different components, of one pair of blocks of a crowded run; a pair that shares several runs comes from the smallest."""

    def run(batches):
        for p, groups in contiguous(batches, ["run", "bi", "bj"]):
            ids, comp, blk, left, right = p["id"].to_numpy(), p["comp"].to_numpy(), p["blk"].to_numpy(), [], []
            sig = np.frombuffer(b"".join(p["sig"]), "<u2").reshape(len(p), -1)
            least = _likely(threshold, sig.shape[1])
            for a, b in groups:
                x = a + np.flatnonzero(blk[a:b] == p["bi"].iloc[a])
                y = a + np.flatnonzero(blk[a:b] == p["bj"].iloc[a])
                if not len(x) or not len(y) or (comp[x][:, None] == comp[y][None, :]).all():
                    continue
                i, j = np.nonzero((_alike(sig[x], sig[y]) >= least) & (comp[x][:, None] != comp[y][None, :]))
                if len(i):
                    runs = p["runs"].iloc[a:b].to_list()
                    once = _least_common(_padded(runs, -1)[x[i] - a], _padded(runs, -2)[y[j] - a]) == p["run"].iloc[a]
                    left.append(ids[x[i[once]]])
                    right.append(ids[y[j[once]]])
            if left and sum(map(len, left)):
                x, y = np.concatenate(left), np.concatenate(right)
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    return run


def loose_runs(crowded: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, id, comp) of ``crowded(run, id)``, and (run, m) of the runs that ``comps(id, comp)`` doesn't hold together."""
    rows = crowded.distinct().join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    return rows, rows.groupBy("run").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("run", "m")


def crowded_pairs(crowded: DataFrame, comps: DataFrame, signed: DataFrame, threshold: float, parts: int) -> DataFrame:
    """a, b: candidates of ``crowded(run, id)`` that ``comps(id, comp)`` doesn't hold together, block by block."""
    rows, loose = loose_runs(crowded, comps)
    rows = materialise(rows.join(loose.select("run", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")), "run"), "loose-runs")
    own = rows.groupBy("id").agg(F.first("comp").alias("comp"), F.collect_set(F.struct("run", "nb")).alias("own"))  # one a tree at most
    rows = own.join(signed.select("id", "sig"), "id").select("id", "comp", "sig", F.col("own.run").alias("runs"), F.explode("own").alias("o")).select("id", "comp", "sig", "runs", "o.run", "o.nb")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("run", F.least("blk", "_o").alias("bi"), F.greatest("blk", "_o").alias("bj"), "blk", "id", "comp", "sig", "runs")
    rows = rows.repartition(parts, "run", "bi", "bj").sortWithinPartitions("run", "bi", "bj")
    return rows.mapInPandas(_across_blocks(threshold), "a long, b long")


def new_pairs(pairs: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """The distinct pairs (a, b) that aren't in ``tried``: what full sets have decided once isn't compared again."""
    found = pairs.distinct()
    return materialise(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "candidate-pairs")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets, ``sets(id, shingles)``, are similar."""
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("o", F.size(F.array_intersect("s_a", "s_b")))
    return materialise(both.where(f"100L * o >= {percent}L * (size(s_a) + size(s_b) - o)").select("a", "b"), "document-links")


def _small_components(percent: int):
    """Links within each component on full sets, as a spanning forest."""
    least = _likely(percent / 100)

    def run(batches):
        for p, groups in contiguous(batches, ["comp"]):
            ids, left, right = p["id"].to_numpy(), [], []
            for a, b in groups:
                sig = np.frombuffer(b"".join(p["sig"].iloc[a:b]), "<u2").reshape(b - a, -1)
                i, j = np.nonzero(np.triu(_alike(sig, sig) >= least, 1))
                if len(i):
                    sets = list(p["shingles"].iloc[a:b])
                    size = np.array([len(s) for s in sets])
                    both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
                    on = 100 * both >= percent * (size[i] + size[j] - both)
                    left.append(ids[a + i[on]])
                    right.append(ids[a + j[on]])
            if left and sum(map(len, left)):
                nodes, low = roots(np.concatenate(left), np.concatenate(right))
                yield pd.DataFrame({"a": nodes, "b": low})[nodes != low]

    return run


def _comps(edges: DataFrame) -> DataFrame:
    return materialise(connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("comp")), "components")


def set_links(docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """a, b: links between classes, enough of them to connect all that are linked."""
    threshold, parts = percent / 100, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = max([1, *(d for d in range(1, 5) if (1 - threshold**d) ** TREES <= MISS)])
    regions = forest_regions(sorted_orders(classes, TREES, DEPTH), DEPTH, shared)
    regions_of_each = by_document(regions)
    comps = _comps(region_pairs(regions_of_each, classes, threshold, "forest", parts))
    crowded = materialise(regions.where("crowded").select("run", "id").distinct(), "crowded-runs")
    comps = comps.unionByName(crowded.select("id").distinct().join(comps, "id", "left_anti").select("id", F.col("id").alias("comp")))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("m"))
    members = comps.join(sizes, "comp").join(classes, "id").select("id", "rep", "key", "comp", "sig", F.expr(f"m <= {BLOCK}").alias("small"))
    full = full_sets(docs, members, width)
    small = full.where("small").select("comp", "id", "sig", "shingles").repartition(parts, "comp").sortWithinPartitions("comp")
    links = small.mapInPandas(_small_components(percent), "a long, b long")
    large, tried = full.where("not small").select("id", "shingles"), None
    if not large.isEmpty():
        # Each document of a large component meets its likeliest neighbours first, then only those that this left apart.
        own = regions_of_each.join(large.select("id"), "id")
        tried = new_pairs(region_pairs(own, classes, threshold, "best", parts))
        first = linked_pairs(tried, large, percent)
        own = own.join(_comps(first), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        others = new_pairs(region_pairs(own, classes, threshold, "across", parts), tried)
        links, tried = links.unionByName(first).unionByName(linked_pairs(others, large, percent)), tried.unionByName(others)
    links = materialise(links, "set-links")

    linked = _comps(links)
    rows, loose = loose_runs(crowded, linked)
    apart = materialise(rows.join(loose, "run").select("id").distinct(), "crowded-documents")
    if apart.isEmpty():
        discard(full, regions, regions_of_each)
        return links
    trees = math.ceil(math.log(MISS) / math.log(1 - threshold**DEEP_SHARED))
    deep = materialise(full.join(apart, "id").select("id", "shingles").mapInArrow(_deep_signatures(trees), "id long, sig binary"), "deep-signatures")
    seen = forest_regions(sorted_orders(deep, trees, DEEP), DEEP, DEEP_SHARED)
    seen_of_each = by_document(seen)
    own = seen_of_each.join(linked, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    others = new_pairs(region_pairs(own, deep, threshold, "across", parts), tried)
    links, tried = links.unionByName(linked_pairs(others, full, percent)), others if tried is None else tried.unionByName(others)
    pairs = crowded_pairs(seen.where("crowded").select("run", "id"), _comps(links), deep, threshold, parts)
    links = links.unionByName(linked_pairs(new_pairs(pairs, tried), full, percent))
    discard(full, regions, regions_of_each, seen, seen_of_each, deep)
    return links


def _deep_signatures(trees: int):
    def run(batches):
        odd = _odd(TREES * DEPTH + trees * DEEP)[TREES * DEPTH :]
        for b in slices(batches):
            values, at = b["shingles"].values.to_numpy(), b["shingles"].offsets.to_numpy()
            sig = [signature(values[x:y].view(np.uint64), odd).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sig, pa.binary())], names=["id", "sig"])

    return run


def near_documents(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``; links: 100 * intersection >= percent * union."""
    sets = materialise(document_sets(docs, width), "document-sets")
    classes = set_classes(sets)
    rows = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(classes.select("key", "id"), "key", "left")
    rows = materialise(rows.select("doc_id", "n_shingles", "id"), "document-classes")
    # An id with several texts is one document, which links with what any of them links with.
    several = rows.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    same = rows.join(several, "doc_id").select("a", F.col("id").alias("b"))
    comps = _comps(set_links(docs, classes, percent, width).unionByName(same))
    by_class = classes.select("id", "rep").join(comps, "id", "left").select("id", "rep", F.coalesce("comp", "id").alias("comp"))
    lowest = by_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    out = rows.join(by_class.join(lowest, "comp").select("id", "component_id"), "id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read_table(spark, sf_dir, "documents"))
