"""Connected components, for both parts of the library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.shared import materialise


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b, and for each the smallest node that it reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)].copy(), flat[len(a) :].copy()
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            return nodes, nodes[parent]
        u, v = u[open_], v[open_]
        np.minimum.at(parent, np.maximum(pu, pv)[open_], np.minimum(pu, pv)[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(batches):
    parts = [(p["a"].to_numpy(), p["b"].to_numpy()) for p in batches]
    if parts:
        nodes, low = roots(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        far = nodes != low
        yield pd.DataFrame({"a": nodes[far], "b": low[far]})


def _rounds(e: DataFrame, max_rounds: int) -> DataFrame:
    """Large-star and small-star rounds until no edge changes."""
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        e = materialise(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state:
            return e
        state = now
    raise RuntimeError("components did not settle; raise max_rounds")


#: Edges that one task contracts at a time.
TASK_EDGES = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reached.

    Each partition first replaces its edges by stars, which keeps what is
    connected and leaves at most one row per node; then the stars of several
    partitions, TASK_EDGES at a time, are contracted again, so that nodes which
    many partitions hold don't enter the rounds many times. Then large-star and
    small-star rounds run until no edge changes. A hub's neighbours are never
    gathered: only minima are aggregated (with map-side partials) and joined
    back, so a skewed join can be split. Each round is written to the shared
    folder. Null ends and self loops are ignored.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = materialise(e.mapInPandas(_contract, "a long, b long"), "edges")
    tasks = max(1, -(-e.count() // TASK_EDGES))
    if tasks < len(e.inputFiles()):
        e = materialise(e.coalesce(tasks).mapInPandas(_contract, "a long, b long"), "edges")
    if tasks > 1:  # stars of one task are settled
        e = _rounds(e, max_rounds)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
