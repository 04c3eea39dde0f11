"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code point order (null last) have weights that repeat; the
budget is shared by weight and no source gets more than ``most`` times its
size, what is above being shared again among the others. That is the water
level L with sum(min(cap, L * weight)) = budget, found from one row per source.

Selection: a source whose target is r times its size takes every document
floor(r) times; the rest of the target is an Efraimidis-Spirakis sample: each
document draws the key -ln(u) / quality, and documents are taken in key order
while they fit. The order is never built for a whole source: keys fall into
ranges, sums of sizes by range tell in which range the budget ends, and only
that range is sorted. What is left, less than the first document that doesn't
fit, is filled in ``rounds`` further passes over later documents that do.

u comes from a digest of the id and the seed, so reruns agree.

Edge cases: a null or empty text has size 0 and takes nothing. Null sources are
one source. Rows with the same id draw the same key; ties are broken by size
and then arbitrarily among equal rows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, read_table

WEIGHTS = (3, 1, 2)
RANGES = 4096


def document_size() -> Column:
    """Words of the text, 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def document_quality() -> Column:
    """A weight in (0, 1]: near 1 where words have usual lengths, low for very short or glued ones."""
    mean = F.length("text") / F.greatest(F.col("size"), F.lit(1))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6) / 6), F.lit(1.0))


def draw(seed: int) -> Column:
    """u in (0, 1) from 52 bits of a digest of doc_id and the seed."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"/{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most: int = 2) -> DataFrame:
    """source, source_size, target from ``sizes(source, source_size)``, one row per source.

    Exact integer arithmetic up to one division: the level is
    (budget - caps of full sources) / (weights of the others).
    """
    everything = Window.partitionBy(F.lit(1))  # one small row per source
    by_source = everything.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))).cast("int") + 1)
    w = sizes.withColumn("_w", pick.cast("long")).withColumn("_cap", F.col("source_size") * most)
    by_level = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("_den", (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
        .withColumn("_num", F.sum("source_size").over(everything) * share_percent - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * 100)
        # Full if the level that would hold from here on reaches its cap.
        .withColumn("_full", F.col("_num") * F.col("_w") >= F.col("_cap") * 100 * F.col("_den"))
    )
    # Fullness is a prefix in this order; the first open source has the level.
    level = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("_num").alias("num"), F.col("_den").alias("den")))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_w") * level["num"]).cast("double") / (level["den"] * 100).cast("double"))
    return w.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _of(left: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``marks``, one row per source; null sources match."""
    m = marks.withColumnRenamed("source", "_s")
    return left.join(m, left["source"].eqNullSafe(m["_s"]), how).drop("_s")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most: int = 2, seed: int = 17, rounds: int = 3,
    size: Column | None = None, quality: Column | None = None, keep_columns: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), taken, per row of ``docs(doc_id, text, source)``.

    With ``keep_columns`` the columns of ``docs`` and copies instead (a column
    of ``docs`` of that name is left out): each row meets the marks of its
    source, so nothing is joined by id.
    """
    own = F.struct(*(c for c in docs.columns if c != "copies"))
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", own.alias("_own")).withColumn("size", document_size() if size is None else size)
    base = base.withColumn("_q", F.greatest(document_quality() if quality is None else quality, F.lit(1e-9)))
    # Keys are exponential with mean 1 / quality; 1 - exp(-key) puts them into [0, 1) in the same order.
    base = base.withColumn("_key", -F.log(draw(seed)) / F.col("_q"))
    base = base.withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))
    whole = base  # the rows with their texts are computed again, not stored
    base = materialise(base.select("doc_id", "source", "size", "_key", "_range"), "mix-sizes")
    ranges = materialise(base.groupBy("source", "_range").agg(F.sum("size").alias("size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    marks = targets.withColumn("_epochs", epochs).withColumn("_left0", F.col("target") - F.col("_epochs") * F.col("source_size"))
    marks = materialise(marks, "mix-targets")
    place = F.struct("_key", "doc_id", "size")
    pool, sums = base, ranges
    for t in range(rounds):
        if t:  # documents after the one that didn't fit, if small enough
            pool = _of(base, marks.select("source", f"_left{t}", f"_stop{t - 1}")).where((F.col("size") > 0) & (F.col("size") <= F.col(f"_left{t}")) & (place > F.col(f"_stop{t - 1}"))).select(*base.columns)
            sums = pool.groupBy("source", "_range").agg(F.sum("size").alias("size"))
        left = F.col(f"_left{t}")
        run = F.sum("size").over(Window.partitionBy("source").orderBy("_range"))
        ends = _of(sums.withColumn("_run", run), marks.select("source", f"_left{t}"))
        ends = ends.groupBy("source").agg(
            F.min(F.when(F.col("_run") > left, F.struct("_range", (F.col("_run") - F.col("size")).alias("before")))).alias("_end"), F.max("_run").alias("_all")
        )
        ends = materialise(ends.select("source", "_all", F.col("_end._range").alias("_end"), F.col("_end.before").alias("_before")), "mix-ends")
        edge = _of(pool, _of(ends, marks.select("source", f"_left{t}"))).where("_range = _end")
        # The default frame counts rows that tie together: equal rows are taken or left as one.
        edge = edge.withColumn("_run", F.sum("size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "size")) + F.col("_before"))
        stop = edge.groupBy("source").agg(F.min(F.when(F.col("_run") > left, place)).alias(f"_stop{t}"), F.max(F.when(F.col("_run") <= left, F.col("_run"))).alias("_got"))
        state = _of(ends, stop, "left").select("source", f"_stop{t}", F.coalesce(F.when(F.col("_end").isNull(), F.col("_all")), F.col("_got"), F.col("_before"), F.lit(0)).alias("_got"))
        marks = _of(marks, state, "left").withColumn(f"_left{t + 1}", left - F.coalesce("_got", F.lit(0))).drop("_got")
        marks = materialise(marks, f"mix-marks-{t}")
    out = _of(whole if keep_columns else base, marks)
    picked = place < F.col("_stop0")
    picked = F.coalesce(picked, F.lit(True))
    for t in range(1, rounds):
        later = (F.col("size") <= F.col(f"_left{t}")) & (place > F.col(f"_stop{t - 1}")) & F.coalesce(place < F.col(f"_stop{t}"), F.lit(True))
        picked = picked | F.coalesce(later, F.lit(False))
    # The first document that didn't fit is taken after all where that brings the source nearer to its target.
    picked = picked | F.coalesce((place == F.col("_stop0")) & (2 * F.col(f"_left{rounds}") > F.col("size")), F.lit(False))
    copies = F.col("_epochs") + F.when(picked & (F.col("size") > 0), F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", copies.cast("long"))
    if keep_columns:
        return out.select("_own.*", "copies")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _turn(t: int) -> str:
    pool = "select doc_id, source, size, key from sized" if not t else (
        f"select d.doc_id, d.source, d.size, d.key from sized d join m{t} m on d.source is not distinct from m.source "
        f"where d.size > 0 and d.size <= m.rest and (d.key > m.stop_key or (d.key = m.stop_key and d.doc_id > m.stop_id))"
    )
    return f"""
 p{t} as ({pool}),
 r{t} as (select p.*, sum(size) over (partition by source order by key, doc_id, size) as run from p{t} p),
 f{t} as (select r.*, m.rest, run <= m.rest as fits from r{t} r join m{t} m on r.source is not distinct from m.source),
 m{t + 1} as (select m.source, m.source_size, m.target, m.epochs, m.rest - coalesce(g.got, 0) as rest, g.stop_key, g.stop_id from m{t} m left join
   (select source, max(run) filter (fits) as got, min(key) filter (not fits) as stop_key, arg_min(doc_id, key) filter (not fits) as stop_id from f{t} group by source) g on m.source is not distinct from g.source),"""


#: The same rows from whole-source sorts; ids are taken as unique.
SOURCE_MIX_SQL = f"""
with recursive s0 as (select doc_id, source, coalesce(length(text), 0) as chars, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, text is null as none,
   (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/17'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
 sized as (select doc_id, source, size, -ln(u) / greatest(case when none then 1.0::double else 1.0::double / (1.0::double + abs(chars::double / greatest(size, 1) - 6) / 6) end, 1e-9::double) as key from s0),
 src as (select source, sum(size)::bigint as source_size from sized group by source),
 w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, 2 * source_size as cap from src),
 lv as (select *, (sum(source_size) over () * 150 - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) * 100)::bigint as num,
   (sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::bigint as den from w),
 fl as (select *, num * w >= cap * 100 * den as is_full from lv),
 op as (select num as lnum, den as lden from fl where not is_full order by cap / w, source nulls last limit 1),
 tg as (select source, source_size, case when is_full then cap::double else (w * lnum)::double / (lden * 100)::double end as target from fl left join op on true),
 m0 as (select source, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs,
   target - (case when source_size > 0 then floor(target / source_size)::bigint else 0 end) * source_size as rest from tg),
 {"".join(_turn(t) for t in range(3))}
 picked as (select doc_id from f0 where fits union all select doc_id from f1 where fits union all select doc_id from f2 where fits
   union all select d.doc_id from sized d join m1 on d.source is not distinct from m1.source join m3 on d.source is not distinct from m3.source
     where d.key = m1.stop_key and d.doc_id = m1.stop_id and 2 * m3.rest > d.size)
select d.doc_id, d.size, m.source_size, m.target, (m.epochs + case when d.size > 0 and k.doc_id is not null then 1 else 0 end) * d.size as taken
from sized d join m0 m on d.source is not distinct from m.source left join (select distinct doc_id from picked) k on d.doc_id = k.doc_id
"""
