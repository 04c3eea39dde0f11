"""Embedding near-dedup: binary codes of randomly rotated vectors with stored correction factors.

A unit vector o is rotated by R random rotations P; its code is s = sign(Po),
its stored factor <s, Po>. For another unit vector q, <s, Pq> / <s, Po> is an
unbiased estimate of <o, q>, and its error is orthogonal to o: a standard
deviation of sqrt(1 - x^2) / x / sqrt(R(D - 1)) times sqrt(1 - <o, q>^2), where
x is the factor over its largest value. A pair whose estimate lies more than
``SIGMAS`` of these below the threshold is dropped; every other pair is
computed again in double precision.

1. Equal vectors become one class (its smallest id, its number of rows).
2. Bits of the codes make keys of ``bands`` x ``bits`` (random hyperplanes).
   Pairs in a bucket that the bounds don't drop are candidate edges; a bucket of
   over ``HOT`` classes links all to its smallest, untested. More bits are used
   on more vectors, and as many bands as keep the chance to miss a pair at the
   threshold under ``MISS``.
3. Components of the candidate edges hold every link found. Each is compared
   block by block (``BLOCK`` classes a side), so a hot component is many tasks;
   a task gives link counts and a spanning forest, never the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; nor do vectors of different lengths. A null
vec_id is its own component. Repeated rows are copies and count as links. Rows
with one vec_id and different vectors each link by their own vector, and all
that any of them links with is one component. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, read_table, roots

SIGMAS, MISS, HOT, BLOCK = 3.5, 0.005, 512, 256


@lru_cache(maxsize=4)
def rotations(dim: int, times: int, seed: int = 3) -> np.ndarray:
    """``times`` random rotations of ``dim`` dimensions, stacked: (times * dim, dim)."""
    rng = np.random.default_rng([seed, dim])
    return np.vstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(times)])


def bands_for(n: int, threshold: float) -> tuple[int, int]:
    """(bands, bits) for n vectors: buckets of about eight, and a chance under MISS to miss a pair at the threshold."""
    bits = max(8, math.ceil(math.log2(max(2, n))) - 3)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - same)), bits


def slack(x: np.ndarray, dim: int, times: int, threshold: float) -> np.ndarray:
    """How far below the threshold the estimate of a linked pair may lie; x: factor over its largest value."""
    sigma = np.sqrt(np.maximum(0, 1 - x * x)) / np.maximum(x, 1e-6) / math.sqrt(max(1, times * (dim - 1)))
    return SIGMAS * sigma * math.sqrt(max(0.0, 1 - threshold * threshold)) + 0.02 / math.sqrt(dim)  # the last: rounding of 8-bit queries


def encode_vectors(vectors: DataFrame, times: int) -> DataFrame:
    """vec_id, key (null: links with nothing), dim, code, factor, query (the unit vector in 8 bits)."""
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = b.num_rows
            key, dim, code, factor, query = [None] * n, np.zeros(n, np.int32), [None] * n, np.zeros(n), [None] * n
            values, offsets = b["embedding"].values, b["embedding"].offsets.to_numpy()
            flat = values.to_numpy(zero_copy_only=False)
            sizes = np.where(np.asarray(b["embedding"].is_valid()), np.diff(offsets), 0)
            for d in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == d)
                x = flat[offsets[at][:, None] + np.arange(d)[None, :]]
                with np.errstate(all="ignore"):
                    scale = np.abs(x).max(1, keepdims=True)
                    u = x / scale
                    u = u / np.linalg.norm(u, axis=1, keepdims=True)
                good = np.isfinite(u).all(1)
                at, x, u = at[good], x[good], u[good]
                y = u @ rotations(int(d), times).T
                packed = np.packbits(y > 0, axis=1)
                small = np.rint(u * 127).astype(np.int8)
                for i, k in enumerate(at):
                    key[k], dim[k], code[k], factor[k], query[k] = _key(x[i]), d, packed[i].tobytes(), np.abs(y[i]).sum(), small[i].tobytes()
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(key, pa.binary()), pa.array(dim), pa.array(code, pa.binary()), pa.array(factor), pa.array(query, pa.binary())], names=["vec_id", "key", "dim", "code", "factor", "query"])

    return vectors.mapInArrow(run, f"vec_id {kind}, key binary, dim int, code binary, factor double, query binary")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """rep, key, vec of every vector that can link: ``encode_vectors``' key and the unit vector's doubles, once per rep and key."""
    vectors = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("rep"), F.col("embedding").cast("array<double>").alias("v")).where("size(v) > 0")

    def run(batches):
        for p in batches:
            key, vec = [], []
            for x in p["v"]:
                x = np.asarray(x, float)
                with np.errstate(all="ignore"):
                    u = x / np.abs(x).max()
                    u = u / np.linalg.norm(u)
                good = np.isfinite(u).all()
                key.append(_key(x) if good else None)
                vec.append(u.tobytes() if good else None)
            yield pd.DataFrame({"rep": p["rep"], "key": key, "vec": vec})

    return vectors.mapInPandas(run, "rep long, key binary, vec binary").where("key is not null").dropDuplicates(["rep", "key"])


def _key(x: np.ndarray) -> bytes:
    """Equal vectors have one key; -0.0 is 0.0."""
    return hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()


def _band_rows(times: int, bands: int, bits: int):
    def run(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for p in batches:
            for d, g in p.groupby("dim"):
                code = np.unpackbits(np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), -1), axis=1)[:, : times * d]
                for k in range(bands):
                    own = code[:, k * bits : (k + 1) * bits].astype(np.int64) @ weights
                    yield g.assign(bucket=((own * bands + k) << 16) + int(d) % 65536)[["bucket", "id", "dim", "code", "factor", "query"]]

    return run


def contiguous(batches, key: list[str]):
    """(batch, [(start, stop), ...]) of the groups in a stream sorted by ``key``; a group is never cut."""
    rest = None
    for p in batches:
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        if not len(p):
            continue
        cols = [p[k].to_numpy() for k in key]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *new.tolist()]
        rest = p.iloc[edges[-1] :].reset_index(drop=True)
        if len(edges) > 1:
            yield p, list(zip(edges[:-1], edges[1:], strict=True))
    if rest is not None and len(rest):
        yield rest, [(0, len(rest))]


def _signs(codes, dim: int, times: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, : times * dim]
    return bits.astype(np.float32) * 2 - 1


def _candidates(times: int, threshold: float):
    def run(batches):
        for p, groups in contiguous(batches, ["bucket"]):
            groups = [(a, b) for a, b in groups if b - a > 1]
            if not groups:
                continue
            ids, dims = p["id"].to_numpy(), p["dim"].to_numpy()
            for d in np.unique(dims):  # a bucket holds one length only, short of a collision of lengths
                mine = np.flatnonzero(dims == d)
                where = np.full(len(p), -1)
                where[mine] = np.arange(len(mine))
                sign = _signs(p["code"].to_numpy()[mine], int(d), times)
                q = np.frombuffer(b"".join(p["query"].to_numpy()[mine]), np.int8).reshape(len(mine), d).astype(np.float32) / 127
                z = q @ rotations(int(d), times).T.astype(np.float32)
                factor = p["factor"].to_numpy()[mine].astype(np.float32)
                least = threshold - slack(factor / (times * math.sqrt(d)), int(d), times, threshold)
                left, right = [], []
                for a, b in groups:
                    k = where[a:b][where[a:b] >= 0]
                    if len(k) < 2:
                        continue
                    lo, hi = int(k[0]), int(k[-1]) + 1
                    est = (sign[lo:hi] @ z[lo:hi].T) / factor[lo:hi, None]
                    i, j = np.nonzero(est >= least[lo:hi, None])
                    far = i != j
                    if far.any():
                        left.append(ids[mine[lo + i[far]]])
                        right.append(ids[mine[lo + j[far]]])
                if left:
                    nodes, low = roots(np.concatenate(left), np.concatenate(right))
                    yield pd.DataFrame({"a": nodes, "b": low})[nodes != low]

    return run


def _compare(times: int, threshold: float):
    """Exact link counts and a spanning forest of one pair of blocks."""

    def run(batches):
        for p, groups in contiguous(batches, ["comp", "bi", "bj"]):
            out = []
            for a, b in groups:
                g = p.iloc[a:b]
                ids, n, blk, dims = g["id"].to_numpy(), g["n"].to_numpy(), g["blk"].to_numpy(), g["dim"].to_numpy()
                bi, bj = g["bi"].iloc[0], g["bj"].iloc[0]
                for d in np.unique(dims):
                    left, right = np.flatnonzero((blk == bi) & (dims == d)), np.flatnonzero((blk == bj) & (dims == d))
                    if not len(left) or not len(right):
                        continue
                    v = np.frombuffer(b"".join(g["vec"].to_numpy()), np.float64) if (dims == d).all() else None
                    v = v.reshape(len(g), d) if v is not None else np.stack([np.frombuffer(x, np.float64) if len(x) == 8 * d else np.zeros(d) for x in g["vec"]])
                    factor = g["factor"].to_numpy()[left]
                    least = threshold - slack(factor / (times * math.sqrt(d)), int(d), times, threshold)
                    z = v[right] @ rotations(int(d), times).T
                    est = (_signs(g["code"].to_numpy()[left], int(d), times) @ z.T) / factor[:, None]
                    i, j = np.nonzero(est >= least[:, None])
                    keep = (i < j) if bi == bj else np.ones(len(i), bool)
                    i, j = left[i[keep]], right[j[keep]]
                    for k in range(0, len(i), 20_000):
                        s, t = i[k : k + 20_000], j[k : k + 20_000]
                        linked = np.einsum("ij,ij->i", v[s], v[t]) >= threshold
                        out.append((s[linked] + a, t[linked] + a))
            if out:
                s, t = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
                if len(s):
                    ids, n = p["id"].to_numpy(), p["n"].to_numpy()
                    links = np.bincount(s, n[t], len(p)) + np.bincount(t, n[s], len(p))
                    near = np.flatnonzero(links)
                    nodes, low = roots(ids[s], ids[t])
                    yield pd.DataFrame({"id": ids[near], "links": links[near].astype(np.int64), "root": low[np.searchsorted(nodes, ids[near])]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    size = F.size("embedding")
    count, dim, least_dim = vectors.agg(F.count("*"), F.max(size), F.min(F.when(size > 0, size))).first()
    dim, least_dim = max(1, dim or 1), least_dim or 1
    bands, bits = bands_for(count, threshold)
    times = max(1, math.ceil(max(256 / dim, bands * bits / least_dim)))
    coded = materialise(encode_vectors(vectors, times), "vector-codes")
    linkable = coded.where("key is not null and vec_id is not null").withColumn("rep", F.col("vec_id").cast("long"))
    # Rows of one key have one code, factor and query, so any row's will do.
    classes = linkable.groupBy("key").agg(F.min("rep").alias("rep"), F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("dim", "code", "factor", "query")))
    reps = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    classes = reps.select("key", "id", "rep", "n")

    rows = "bucket long, id long, dim int, code binary, factor double, query binary"
    banded = reps.select("id", "dim", "code", "factor", "query").mapInPandas(_band_rows(times, bands, bits), rows)
    size = banded.select("bucket", "id").groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("low")).where(f"m > {HOT}")
    hot = materialise(size, "hot-buckets")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = banded.join(hot.select("bucket"), "bucket", "left_anti")
    tested = own.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_candidates(times, threshold), "a long, b long")
    untested = banded.select("bucket", "id").join(hot, "bucket").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    comps = materialise(connected_components(tested.unionByName(untested)).select(F.col("node").alias("id"), F.col("component").alias("comp")), "candidate-components")

    blocks = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    members = comps.join(blocks, "comp").join(reps.drop("query"), "id").join(unit_vectors(vectors), ["rep", "key"])
    spread = members.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    spread = spread.select("id", "comp", "nb", "n", "dim", "code", "factor", "blk", "vec")
    spread = spread.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_o", "nb")
    spread = spread.repartition(parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    found = materialise(spread.mapInPandas(_compare(times, threshold), "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    several = linkable.groupBy("rep").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    ids = classes.select("key", "id")
    with_low = several.join(ids.select(F.col("key").alias("low"), F.col("id").alias("a")), "low").select("rep", "a")
    same = linkable.select("rep", "key").join(with_low, "rep").join(ids.withColumnRenamed("id", "b"), "key").select("a", "b").where("a <> b").distinct()
    joined = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same))
    by_class = classes.join(links, "id", "left").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    by_class = by_class.select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("comp"))
    by_class = materialise(by_class, "vector-components")
    lowest = by_class.groupBy("comp").agg(F.min("rep").alias("component"))
    by_class = by_class.join(lowest, "comp").select("key", "n_links", "component")
    out = coded.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(by_class, "key", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").cast("long").eqNullSafe(component).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
