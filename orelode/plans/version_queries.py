"""Dataset version and lineage queries over customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as v
from .registry import query
from .views import table

_COLS = ["c_acctbal", "c_mktsegment"]
_SNAP = """with base as (select c_custkey, c_acctbal, c_mktsegment from customer),
 source as (select c_custkey, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 11 <> 0
   union all select c_custkey + 10000000, c_acctbal, c_mktsegment from customer where c_custkey % 13 = 0),
 target as (select c_custkey, case when c_custkey % 35 = 0 then c_acctbal - 1 else c_acctbal end as c_acctbal, case when c_custkey % 5 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment from customer where c_custkey % 17 <> 0
   union all select c_custkey + 10000000, case when c_custkey % 2 = 0 then c_acctbal else 0 end, c_mktsegment from customer where c_custkey % 26 = 0 or c_custkey % 39 = 0)"""


def _snapshots(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", *_COLS)
    k = F.col("c_custkey")
    later = c.withColumn("c_custkey", k + 10000000)
    source = c.where(k % 11 != 0).withColumn("c_acctbal", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).unionByName(later.where((k - 10000000) % 13 == 0))
    target = c.where(k % 17 != 0).withColumn("c_acctbal", F.when(k % 35 == 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(k % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    o = k - 10000000
    target = target.unionByName(later.where((o % 26 == 0) | (o % 39 == 0)).withColumn("c_acctbal", F.when(o % 2 == 0, F.col("c_acctbal")).otherwise(0.0)))
    return c, source, target


@query(f"{_SNAP} select coalesce(b.c_custkey, s.c_custkey) as c_custkey, case when b.c_custkey is null then 'added' when s.c_custkey is null then 'removed' else 'changed' end as status from base b full join source s on b.c_custkey = s.c_custkey where b.c_custkey is null or s.c_custkey is null or b.c_acctbal is distinct from s.c_acctbal or b.c_mktsegment is distinct from s.c_mktsegment")
def snapshot_diff(spark, sf_dir):
    base, source, _ = _snapshots(spark, sf_dir)
    return v.snapshot_diff(base, source, ["c_custkey"], _COLS)


@query(f"{_SNAP}, a as (select c_custkey, c_mktsegment from base), b as (select c_custkey, c_mktsegment from target) select *, 'added' as status from (select * from b except all select * from a) union all select *, 'removed' from (select * from a except all select * from b)")
def edge_diff(spark, sf_dir):
    base, _, target = _snapshots(spark, sf_dir)
    return v.edge_diff(base.select("c_custkey", "c_mktsegment"), target.select("c_custkey", "c_mktsegment"))


@query(f"""{_SNAP}, j as (select k as c_custkey, b.c_custkey is not null as bi, s.c_custkey is not null as si, t.c_custkey is not null as ti, b, s, t from (select c_custkey as k from base union select c_custkey from source union select c_custkey from target)
   left join base b on b.c_custkey = k left join source s on s.c_custkey = k left join target t on t.c_custkey = k),
 m as (select *, case when si = ti and s is not distinct from t or si = bi and s is not distinct from b or ti = bi and t is not distinct from b then null when not bi then 'same_added_differently' when not si or not ti then 'edited_vs_deleted' else 'edited_differently' end as conflict,
   (ti = bi and t is not distinct from b) and not (si = bi and s is not distinct from b) as fs from j),
 n as (select *, fs or (not ti and conflict is not null) as src from m)
 select c_custkey, case when src then s.c_acctbal else t.c_acctbal end as c_acctbal, case when src then s.c_mktsegment else t.c_mktsegment end as c_mktsegment, conflict from n where (case when src then si else ti end) or conflict is not null""")
def three_way_merge(spark, sf_dir):
    return v.three_way_merge(*_snapshots(spark, sf_dir), ["c_custkey"], _COLS)


@query("""with e as (select n_regionkey as src, n_nationkey + 100 as dst from nation union all select s_nationkey + 100, s_suppkey + 1000 from supplier),
 a as (select * from e where dst % 5 <> 0), b as (select * from e where dst % 7 <> 0 union all select src, dst + 5000000 from e where dst % 3 = 0),
 gone as (select * from e except select * from a union (select * from e except select * from b)), u as (select * from a union select * from b), n as (select src as node from e union select dst from e)
 select src, dst, case when src in (select node from n) and dst in (select node from n) then null else 'dangling_edge' end as conflict from (select * from u except select * from gone)""")
def merge_edges(spark, sf_dir):
    e = _edges(spark, sf_dir, customers=False)
    a = e.where("dst % 5 <> 0")
    b = e.where("dst % 7 <> 0").unionByName(e.where("dst % 3 = 0").select("src", (F.col("dst") + 5000000).alias("dst")))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return v.merge_edges(e, a, b, nodes)


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("node"), F.col("event_type").alias("key"), F.floor(F.col("value") / 20).cast("string").alias("hash"), F.lit("application/json").alias("media"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))


_VERS = "with ver as (select user_id as node, event_type as key, floor(value / 20)::bigint::varchar as hash, 'application/json' as media, ts as created_at, event_id as id from events)"


@query(f"{_VERS} select node, key, hash, id from ver qualify row_number() over (partition by node, key order by created_at desc, id desc) = 1")
def latest_per_key(spark, sf_dir):
    return v.latest_per_key(_versions(spark, sf_dir), ["node", "key"], ["created_at", "id"]).select("node", "key", "hash", "id")


@query(f"{_VERS}, f as (select * from ver qualify lag(hash) over (partition by node, key order by created_at, id) is distinct from hash) select node, key, hash, id from f qualify row_number() over (partition by node, key order by created_at desc, id desc) <= 2")
def keep_last_versions(spark, sf_dir):
    return v.keep_last_versions(_versions(spark, sf_dir), ["node", "key"], ["created_at", "id"], ["hash"]).select("node", "key", "hash", "id")


def _edges(spark, sf_dir, customers: bool = True):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    e = n.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    e = e.unionByName(s.select((F.col("s_nationkey") + 100).cast("long").alias("src"), (F.col("s_suppkey") + 1000).cast("long").alias("dst")))
    if customers:
        c = table(spark, sf_dir, "customer")
        e = e.unionByName(c.select((F.col("c_custkey") % F.lit(10) + 1001).cast("long").alias("src"), (F.col("c_custkey") + 10000000).cast("long").alias("dst")))
    return e


_EDGES = "e as (select n_regionkey as src, n_nationkey + 100 as dst from nation union all select s_nationkey + 100, s_suppkey + 1000 from supplier union all select c_custkey % 10 + 1001, c_custkey + 10000000 from customer)"


@query(f"{_VERS}, up as (select distinct c_custkey % 100 + 1 as node from customer where c_nationkey = 3) select node, key, hash, media from ver where node in (select node from up) qualify row_number() over (partition by node, key order by created_at desc, id desc) = 1")
def upstream_inputs(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100 + 1).alias("src"), F.col("c_nationkey").alias("dst"))
    return v.upstream_inputs(edges, _versions(spark, sf_dir), 3)


@query(f"with recursive {_EDGES}, d as (select 2::bigint as node union select e.dst from e join d on e.src = d.node) select node from d")
def lineage_downstream(spark, sf_dir):
    roots = table(spark, sf_dir, "region").where("r_regionkey = 2").select(F.col("r_regionkey").cast("long").alias("node"))
    return v.lineage_downstream(_edges(spark, sf_dir), roots)


@query(f"with recursive {_EDGES}, u as (select src as node, 1 as depth from e where dst = 10000003 union select e.src, u.depth + 1 from e join u on e.dst = u.node where u.depth < 12) select depth, node, 'a' || node as artifact from u")
def lineage_upstream_sources(spark, sf_dir):
    e = _edges(spark, sf_dir)
    artifacts = e.select(F.col("src").alias("node")).distinct().withColumn("artifact", F.concat(F.lit("a"), F.col("node").cast("string")))
    return v.lineage_upstream_sources(e, artifacts, 10000003)


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, 'default') as segment, 32630 as epsg from customer")
def attach_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    return v.attach_metadata(c, spark.createDataFrame([("default", 32630)], "segment string, epsg int"))


_ROW = "sha256(" + " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, 'N')" for c in ("c_custkey", "c_mktsegment", "c_nationkey")) + ")"
_LANES = ", ".join(f"(sum(('0x' || h[{16 * k + 1}:{16 * k + 16}])::ubigint::hugeint) % 18446744073709551616::hugeint)::varchar as s{k}" for k in range(4))


@query(f"with h as (select {_ROW} as h from customer), s as (select count(*)::varchar as n, {_LANES} from h) select sha256(n || ',' || s0 || ',' || s1 || ',' || s2 || ',' || s3) as hash from s")
def dataset_fingerprint(spark, sf_dir):
    return v.dataset_fingerprint(table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey"])


