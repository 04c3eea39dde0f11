"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import ingest, stats
from .drillhole_queries import ASSAY_POINTS, points, segments
from .registry import query, r, rounded
from .views import collars, part_grid, points3d, survey_lines, table, with_views



def _text(spark, sf_dir):
    """Cells that are blank, numbers with comma or blanks, letters, and numbers with a suffix."""
    n, q = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int").cast("string")
    t = F.when(n == 0, "").when(n == 1, F.concat(F.lit("1"), F.lit(","), q)).when(n == 2, F.concat(F.lit(" "), q, F.lit(" "))).when(n == 3, F.col("l_returnflag")).otherwise(F.concat(q, F.lit("d")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), t.alias("t"))


_TEXT = "with t as (select l_orderkey as k, l_partkey as p, l_suppkey as s, case l_linenumber % 5 when 0 then '' when 1 then '1,' || l_quantity::int when 2 then ' ' || l_quantity::int || ' ' when 3 then l_returnflag else l_quantity::int || 'd' end as t from lineitem), v as (select *, case when regexp_matches(trim(t), '^[+-]?([0-9]+[.,]?[0-9]*)$') then replace(trim(t), ',', '.')::double end as v from t)"


@query(f"{_TEXT} select k, p, s, t, v from v")
def parse_numeric(spark, sf_dir):
    return _text(spark, sf_dir).withColumn("v", fn.parse_numeric("t"))


@query(f"{with_views('lines')} select fid, {r('case when m > 0 then log10(m) end', 'lg')}, {r('case when m > 0 then ln(m) end', 'ln')}, {r('case when m >= 0 then sqrt(m) end', 'sq')} from lines")
def scale_transform(spark, sf_dir):
    return rounded(survey_lines(spark, sf_dir).select("fid", *(fn.scale_transform("m", k).alias(a) for a, k in (("lg", "log10"), ("ln", "ln"), ("sq", "sqrt")))))


@query("select event_id, (props::json->>'k')::bigint as k from events")
def json_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.json_path_extract("props", "k").cast("long").alias("k"))


@query(f"{with_views('collars', 'points')}, u as (select x, y from collars union all select x, y from points), e as (select min(x) a, max(x) b, min(y) c, max(y) d from u) select {r('a - .25 * (b - a)', 'xmin')}, {r('b + .25 * (b - a)', 'xmax')}, {r('c - .25 * (d - c)', 'ymin')}, {r('d + .25 * (d - c)', 'ymax')} from e")
def extent_2d(spark, sf_dir):
    return rounded(stats.extent_2d([collars(spark, sf_dir), points3d(spark, sf_dir)]))


@query(f"{with_views('collars')}, e as (select min(x) a, max(x) b, min(y) c, max(y) d, min(z) e, max(z) f from collars) select {r('a - (b - a) * .05 - 20', 'xmin')}, {r('b + (b - a) * .05 + 20', 'xmax')}, {r('c - (d - c) * .05 - 20', 'ymin')}, {r('d + (d - c) * .05 + 20', 'ymax')}, {r('e - (f - e) * .05 - 20', 'zmin')}, {r('f + (f - e) * .05 + 20', 'zmax')} from e")
def extent_3d(spark, sf_dir):
    return rounded(stats.extent_3d(collars(spark, sf_dir)))


@query(f"{with_views('segments')}, u as (select x, y, z from collars union all select x_from, y_from, z_from from segments union all select x_to, y_to, z_to from segments) select count(*) as n, {r('sum(x - 500000)', 'sx', 1)}, {r('min(z)', 'zmin')} from u")
def collect_coordinates(spark, sf_dir):
    c = stats.collect_coordinates([collars(spark, sf_dir), segments(spark, sf_dir)])
    return c.agg(F.count("*").alias("n"), (F.round(F.sum(F.col("x") - 500000), 1) + 0.0).alias("sx"), (F.round(F.min("z"), 4) + 0.0).alias("zmin"))


@query(f"{with_views('collars')}, e as (select min(x) a, max(x) b, min(y) c, max(y) d, count(*) as inferred_n from collars) select {r('a - .25 * (b - a)', 'xmin')}, {r('b + .25 * (b - a)', 'xmax')}, {r('c - .25 * (d - c)', 'ymin')}, {r('d + .25 * (d - c)', 'ymax')}, inferred_n, 5 as corners from e")
def aoi(spark, sf_dir):
    a = stats.aoi(collars(spark, sf_dir))
    return rounded(a.select("xmin", "xmax", "ymin", "ymax", "inferred_n", F.size("ring").alias("corners")))


@query(f"{with_views('segments')} select hole_id, {r('least(min(x_from), min(x_to))', 'xmin')}, {r('greatest(max(x_from), max(x_to))', 'xmax')}, {r('least(min(y_from), min(y_to))', 'ymin')}, {r('greatest(max(y_from), max(y_to))', 'ymax')} from segments group by 1")
def geometry_bbox(spark, sf_dir):
    from ..operators.drillhole import trace_polylines

    t = trace_polylines(segments(spark, sf_dir)).withColumnRenamed("vertices", "ring")
    return rounded(stats.geometry_bbox(t).select("hole_id", "xmin", "xmax", "ymin", "ymax"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("with u as (" + " union all ".join(f"select '{c}' as \"column\", {c} as v from lineitem" for c in _COLS) + f") select \"column\", min(v) as min, max(v) as max, {r('avg(v)', 'mean')}, count(v) as count from u group by 1")
def numeric_summary(spark, sf_dir):
    return rounded(stats.numeric_summary(table(spark, sf_dir, "lineitem"), _COLS), only=["mean"])


def _rank(p: str) -> str:
    return f"max(v) filter (k = floor((n - 1) * {p} + 0.5))"


@query(f"{_TEXT}, o as (select v, row_number() over (order by v) - 1 as k, count(*) over () as n from v where v is not null) select max(n) as n, (select count(*) from v where v is null) as missing, min(v) as min, {', '.join(f'{_rank(p)} as {a}' for a, p in (('p05', '.05'), ('p25', '.25'), ('p50', '.5'), ('p75', '.75'), ('p95', '.95')))}, max(v) as max, {r('avg(v)', 'mean')} from o")
def numeric_profile(spark, sf_dir):
    return rounded(stats.numeric_profile(_text(spark, sf_dir), "t"), only=["mean"])


_KINDS = f"""{_TEXT}, u as (select 't' as "column", trim(t) as t from t union all select 'k', k::varchar from t),
 k as (select *, lower(t) in ('', 'null', 'na', 'n/a') as none, regexp_matches(t, '^[+-]?([0-9]+[.,]?[0-9]*)$') as number, lower(t) in ('true', 'false', 'yes', 'no') as boolean from u)"""


@query(_KINDS + """, c as (select "column", count(*) filter (none) as null_like, count(*) filter (number) as numeric, count(*) filter (not none and not number and boolean) as bool, count(*) filter (not none and not number and not boolean) as text from k group by 1),
 d as (select "column", t, row_number() over (partition by "column" order by t) as i from (select distinct "column", t from k where not none)),
 s as (select "column", string_agg(t, ' | ' order by t) as samples from d where i <= 3 group by 1)
 select c.*, case when greatest(numeric, bool, text) = 0 then 'empty' when numeric = greatest(numeric, bool, text) then 'number' when bool = greatest(numeric, bool, text) then 'boolean' else 'text' end as type, samples from c join s using ("column")""")
def type_profile(spark, sf_dir):
    return stats.type_profile(_text(spark, sf_dir).select("k", "t"))


@query(_KINDS + """, g as (select "column", count(*) filter (number) as num, count(*) filter (not none) as non_empty from k group by 1)
 select "column", round(0.7 * num / non_empty, 3) as score, round(num / non_empty, 6) as numeric_ratio, 0.0::double as name_score, non_empty from g""")
def measure_ranking(spark, sf_dir):
    m = stats.measure_ranking(_text(spark, sf_dir).select("k", "t"))
    return m.withColumn("numeric_ratio", F.round("numeric_ratio", 6))


@query("with o as (select c_custkey, row_number() over (order by c_custkey) - 1 as k, count(*) over () as n from customer) select 'head' as part, k as row_no from o where k < 12 union all select 'tail', k from o where k >= n - 12 union all select 'count', count(*) from o")
def table_profile(spark, sf_dir):
    return stats.table_profile(table(spark, sf_dir, "customer"), ["c_custkey"]).select("part", "row_no")


@query(f"with e as (select min(o_totalprice) lo, max(o_totalprice) hi from orders), b as (select least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) as b, count(*) as count from orders, e group by 1) select {r('lo + i * ((hi - lo) / 10)', 'from_v')}, {r('lo + (i + 1) * ((hi - lo) / 10)', 'to_v')}, coalesce(count, 0) as count from e, (select unnest(range(10)) as i) left join b on b.b = i")
def histogram(spark, sf_dir):
    h = stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(h.withColumnsRenamed({"from": "from_v", "to": "to_v"}))


@query(f"with d as (select l_extendedprice / 1000 - l_quantity as residual from lineitem) select count(*) as n, {r('avg(abs(residual))', 'mae')}, {r('sqrt(avg(residual * residual))', 'rmse')}, {r('avg(residual)', 'bias')} from d")
def fit_residual_metrics(spark, sf_dir):
    return rounded(stats.fit_residual_metrics(table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("residual"))))


@query(f"{with_views('lines')}, a as (select line, median(m) as med from lines group by 1) select line, {r('med', 'median')}, {r('greatest(median(abs(m - med)), 1e-9)', 'mad')} from lines join a using (line) group by line, med")
def median_mad(spark, sf_dir):
    return rounded(stats.median_mad(survey_lines(spark, sf_dir), "m", ["line"]))


@query("with o as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem) select l_returnflag, v as value from o where k = floor((n - 1) * .95 + 0.5)")
def percentile_nearest_rank(spark, sf_dir):
    return stats.percentile_nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"])


@query("with o as (select l_extendedprice as v, row_number() over (order by l_extendedprice) - 1 as k, count(*) over () as n from lineitem) select v as value from o where k = floor((n - 1) * .95 + 0.5)")
def percentile_nearest_rank_all(spark, sf_dir):
    return stats.percentile_nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95)


@query(f"select l_returnflag, {r('quantile_cont(l_extendedprice, .95)', 'value')} from lineitem group by 1")
def percentile_linear(spark, sf_dir):
    return rounded(stats.percentile_linear(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"]))


@query(f"{ASSAY_POINTS}, u as (select log10(grade) as v from assays where grade > 0 union all select log10(grade) from ap where grade > 0) select {r('quantile_cont(v, .02)', 'lo')}, {r('quantile_cont(v, .98)', 'hi')} from u")
def measure_domain(spark, sf_dir):
    from .views import assays

    return rounded(stats.measure_domain([assays(spark, sf_dir), points(spark, sf_dir)], "grade", "log10"))


@query(f"{with_views('segments')}, u as (select 'collar' as kind, x, y, z, case when hole_id % 10 = 0 then 32631 else 32630 end as epsg from collars union all select 'segment', x_to, y_to, case when hole_id % 7 = 0 then null else z_to end, 32630 from segments), b as (select min(x) a, max(x) b, min(y) c, max(y) d from collars) select 'outside_bounds_' || kind as \"check\", count(*) filter (x < a or x > b.b or y < c or y > d) as count from u, b group by 1 union all select 'wrong_epsg', count(*) filter (epsg <> 32630) from u union all select 'missing_z', count(*) filter (z is null) from u")
def scene_qa(spark, sf_dir):
    c, s = collars(spark, sf_dir), segments(spark, sf_dir)
    f = c.select(F.lit("collar").alias("kind"), "x", "y", "z", F.when(F.col("hole_id") % 10 == 0, 32631).otherwise(32630).alias("epsg"))
    f = f.unionByName(s.select(F.lit("segment").alias("kind"), F.col("x_to").alias("x"), F.col("y_to").alias("y"), F.when(F.col("hole_id") % 7 != 0, F.col("z_to")).alias("z"), F.lit(32630).alias("epsg")))
    return stats.scene_qa(f, stats.extent_2d(c, pad=0.0), 32630)


@query("select count(v) as n, min(v) as min, max(v) as max from (select (p_size + p_retailprice / 100)::double as v from part)")
def grid_stats(spark, sf_dir):
    return stats.grid_stats(part_grid(spark, sf_dir)[0])


def attribute_rows(spark, sf_dir):
    """Events with their numbers in a map: value, and one key by event type."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.create_map(F.lit("value"), F.col("value"), F.concat(F.lit("n_"), "event_type"), F.lit(1.0), F.lit("x"), F.lit(0.0)).alias("num_attrs"))


@query("select distinct 'n_' || event_type as \"column\" from events union select 'value' union select 'x'")
def column_inventory(spark, sf_dir):
    return stats.column_inventory(attribute_rows(spark, sf_dir), "num_attrs")


@query("select 'n_' || event_type as field, count(*) as n from events group by 1 union all select 'value', count(value) from events")
def numeric_fields(spark, sf_dir):
    return ingest.numeric_fields(attribute_rows(spark, sf_dir))


@query("with u as (select 'n_' || event_type as field from events union all select 'value' from events union all select 'x' from events) select field, count(*) as n from u group by 1 order by 2 desc, 1 limit 20")
def top_attributes(spark, sf_dir):
    return ingest.top_attributes(attribute_rows(spark, sf_dir))


@query("with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders) select o_orderkey from o where k % greatest(ceil(n / 1000), 1)::bigint = 0")
def preview_sample(spark, sf_dir):
    return stats.preview_sample(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


@query("(select o_orderkey, 'head' as part from orders order by 1 limit 8) union all (select o_orderkey, 'tail' from orders order by 1 desc limit 8)")
def head_tail(spark, sf_dir):
    return stats.head_tail(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(f"{_TEXT} select k, p, s, t from v order by v asc nulls last, k, p, s limit 3000")
def sort_limit(spark, sf_dir):
    return stats.sort_limit(_text(spark, sf_dir), "t", 3000, ["k", "p", "s"])


@query(f"{with_views('lines')}, o as (select m, row_number() over (order by m) - 1 as k, count(*) over () as n from lines), p as (select max(m) filter (k = floor((n - 1) * .02 + .5)) as lo, max(m) filter (k = floor((n - 1) * .98 + .5)) as hi from o) select fid, greatest(least(m, hi), lo) as m from lines, p")
def percentile_clamp(spark, sf_dir):
    return ingest.percentile_clamp(survey_lines(spark, sf_dir).select("fid", "m"), "m", 2, 98)


@query(f"{with_views('lines')}, o as (select m, row_number() over (order by m) - 1 as k, count(*) over () as n from lines), p as (select max(m) filter (k = floor((n - 1) * .995 + .5)) as cap from o) select fid, least(m, cap) as m, m > cap as was_capped from lines, p")
def top_cut(spark, sf_dir):
    return ingest.top_cut(survey_lines(spark, sf_dir).select("fid", "m"), "m", "percentile")
