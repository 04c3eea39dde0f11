"""Dataset versions: differences, merges, lineage, retention, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise


def _row(prefix: str, compare: list[str]):
    return F.struct(*(F.col(f"{prefix}_{c}") for c in compare))


def _side(df: DataFrame, prefix: str, key: list[str], compare: list[str]) -> DataFrame:
    return df.select(*key, *(F.col(c).alias(f"{prefix}_{c}") for c in compare), F.lit(True).alias(f"{prefix}_in"))


def snapshot_diff(a: DataFrame, b: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key, status: added, removed or changed from a to b; equal rows are left out."""
    j = _side(a, "a", key, compare).join(_side(b, "b", key, compare), key, "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    status = F.when(F.col("a_in").isNull(), "added").when(F.col("b_in").isNull(), "removed").when(~same, "changed")
    return j.select(*key, status.alias("status")).where("status is not null")


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges only in b (added) or only in a (removed), as multisets."""
    return b.exceptAll(a).withColumn("status", F.lit("added")).unionByName(a.exceptAll(b).withColumn("status", F.lit("removed")))


def three_way_merge(base: DataFrame, source: DataFrame, target: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key, compare columns and conflict (null if none) of source merged into target.

    A side that changed wins over one that didn't; equal changes agree. Kinds
    of conflict: same_added_differently, edited_vs_deleted, edited_differently
    (the target's row is shown). Rows deleted on one side and unchanged on the
    other go.
    """
    j = _side(base, "b", key, compare).join(_side(source, "s", key, compare), key, "full_outer").join(_side(target, "t", key, compare), key, "full_outer")

    def same(p: str, q: str):
        out = F.col(f"{p}_in").eqNullSafe(F.col(f"{q}_in"))
        for c in compare:
            out = out & F.col(f"{p}_{c}").eqNullSafe(F.col(f"{q}_{c}"))
        return out

    b, s, t = (F.col(f"{p}_in").isNotNull() for p in "bst")
    conflict = (
        F.when(same("s", "t") | same("s", "b") | same("t", "b"), F.lit(None).cast("string"))
        .when(~b, "same_added_differently").when(~s | ~t, "edited_vs_deleted").otherwise("edited_differently")
    )
    from_source = (same("t", "b") & ~same("s", "b")) | (~t & conflict.isNotNull())
    there = F.when(from_source, s).otherwise(t)
    j = j.withColumn("_there", there).withColumn("_src", from_source).withColumn("conflict", conflict)
    return j.where(F.col("_there") | F.col("conflict").isNotNull()).select(*key, *(F.when(F.col("_src"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in compare), "conflict")


def merge_edges(base: DataFrame, source: DataFrame, target: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of both sides without those that either removed from base; conflict = dangling_edge where an end isn't in ``nodes(node)``."""
    own = [src, dst]
    gone = base.select(*own).join(source.select(*own), own, "left_anti").unionByName(base.select(*own).join(target.select(*own), own, "left_anti"))
    kept = source.select(*own).unionByName(target.select(*own)).distinct().join(gone.distinct(), own, "left_anti")
    n = nodes.select("node").distinct()
    ok = kept.join(n.withColumnRenamed("node", src).withColumn("_a", F.lit(True)), src, "left").join(n.withColumnRenamed("node", dst).withColumn("_b", F.lit(True)), dst, "left")
    return ok.select(src, dst, F.when(F.col("_a").isNull() | F.col("_b").isNull(), "dangling_edge").alias("conflict"))


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: the largest ``order``, by a max over a struct with map-side partials."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*(F.col(c) if c in key else F.col(f"_m.{c}") for c in df.columns))


def keep_last_versions(df: DataFrame, key: list[str], order: list[str], hash_cols: list[str], n: int = 2) -> DataFrame:
    """Versions whose hash differs from the one before, then the newest ``n`` of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for c in hash_cols:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    fresh = df.withColumn("_new", first | ~same).where("_new").drop("_new")
    last = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return fresh.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def upstream_inputs(edges: DataFrame, versions: DataFrame, node) -> DataFrame:
    """key, hash, media: the newest version of every artifact of the nodes that feed ``node``."""
    feeding = edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()
    return latest_per_key(versions.join(feeding, "node", "left_semi"), ["node", "key"], ["created_at", "id"]).select("node", "key", "hash", "media")


def lineage_downstream(edges: DataFrame, roots: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node: the roots and all that can be reached from them, level by level with an anti join against what is known."""
    e = edges.select("src", "dst").distinct()
    seen = front = materialise(roots.select("node").distinct(), "lineage")
    for _ in range(max_rounds):
        front = e.join(front, e["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = materialise(front, "lineage")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("edges are deeper than max_rounds")


def lineage_upstream_sources(edges: DataFrame, artifacts: DataFrame, node, max_depth: int = 12) -> DataFrame:
    """depth, node, artifact of all that feeds ``node``, up to ``max_depth`` steps away; every depth at which a node occurs."""
    e = edges.select("src", "dst").distinct()
    front = e.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit(1).alias("depth"))
    levels = front
    for d in range(2, max_depth + 1):
        front = e.join(front.select(F.col("node").alias("dst")).distinct(), "dst").select(F.col("src").alias("node"), F.lit(d).alias("depth")).distinct()
        levels = levels.unionByName(front)
    return levels.distinct().join(artifacts.select("node", "artifact"), "node").select("depth", "node", "artifact")


def attach_metadata(df: DataFrame, meta: DataFrame) -> DataFrame:
    """The one row of ``meta`` on every row of ``df``; values that ``df`` has win."""
    m = meta.limit(1).select(*(F.col(c).alias(f"_m_{c}") for c in meta.columns))
    j = df.crossJoin(F.broadcast(m))  # one row
    own = [F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in meta.columns else F.col(c) for c in df.columns]
    return j.select(*own, *(F.col(f"_m_{c}").alias(c) for c in meta.columns if c not in df.columns))


def _exact_text(c: str, kind: str) -> Column:
    """A value as text that no other value and no neighbour's text can be read as: its length and itself, or N."""
    t = F.hex(c) if kind == "binary" else F.to_json(F.struct(c)) if kind.startswith(("array", "map", "struct")) else F.col(c).cast("string")
    return F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("N"))


def dataset_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """hash: SHA-256 of the rows as a multiset: their number, and the sums of their digests in four lanes modulo 2^64.

    Sums are taken map-side, so a task sends one row. Rows in any order and any
    split give the same hash; a row more or less, also an equal one, another.
    """
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat(*(_exact_text(c, kinds[c]) for c in cols)), 256)
    lanes = [F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(28,0)") for k in range(4)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k, x in enumerate(lanes)))
    ring = F.lit(str(2**64)).cast("decimal(38,0)")
    return sums.select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *((F.col(f"s{k}") % ring).cast("decimal(20,0)").cast("string") for k in range(4))), 256).alias("hash"))
