"""From raw text tables to typed records: columns by alias, coordinates, flags."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank_to_null, lonlat_to_mercator, lonlat_to_utm, mercator_to_lonlat, parse_numeric, utm_epsg, utm_to_lonlat
from .selection import kth_values

#: Names under which a field is found, in canonical form.
ALIASES = {
    "hole_id": ("holeid", "hole", "bhid", "dhid", "drillhole", "collarid"),
    "x": ("x", "xwgs84", "easting", "east", "xcoord", "utme", "xm", "fx"),
    "y": ("y", "ywgs84", "northing", "north", "ycoord", "utmn", "ym", "fy"),
    "z": ("z", "elevation", "elev", "rl", "altitude", "alt", "gpsz", "fz"),
    "depth_m": ("depth", "depthm", "md", "at"),
    "azimuth_deg": ("azimuth", "azi", "azimuthdeg", "bearing"),
    "dip_deg": ("dip", "dipdeg", "inclination"),
    "from_m": ("from", "fromm", "depthfrom", "fromdepth"),
    "to_m": ("to", "tom", "depthto", "todepth"),
    "id": ("id", "sampleid", "sample"),
    "lon": ("lon", "longitude", "long", "lng"),
    "lat": ("lat", "latitude"),
    "ts": ("utc", "time", "timestamp", "datetime", "date"),
    "segment_id": ("segment", "segmentid", "line", "lineid", "flightline", "group"),
}


def canonical(name: str) -> str:
    return re.sub(r"[_\-. ]", "", name.strip().lower())


def _field_of(name: str) -> str | None:
    """The measured field that a canonical name belongs to: by an alias that it equals, else by the longest that it contains."""
    measured = (f for f in ALIASES if f not in ("hole_id", "id", "segment_id", "ts"))
    held = [(a == name, len(a), f) for f in measured for a in ALIASES[f] if a == name or (len(a) > 2 and a in name)]
    return max(held)[2] if held else None


def infer_mapping(columns: list[str], fields: list[str]) -> dict[str, str]:
    """field -> column: the first alias that equals a column's canonical name, else one that it contains; a column serves once.

    A name that only contains an alias serves no field if another field's alias
    names it better (``from_azimuth`` is no start of an interval).
    """
    out, names = {}, {c: canonical(c) for c in columns}
    for exact in (True, False):
        for f in fields:
            for a in () if f in out else ALIASES.get(f, (f,)):
                free = [c for c in columns if c not in out.values() and (names[c] == a if exact else len(a) > 2 and a in names[c] and (_field_of(names[c]) or f) == f)]
                if free:
                    out[f] = free[0]
                    break
    return out


def _mapped(df: DataFrame, fields: list[str], mapping: dict[str, str] | None) -> dict[str, str]:
    return infer_mapping(df.columns, fields) | {k: v for k, v in (mapping or {}).items() if v in df.columns}


def _strict(m: dict[str, str], field: str):
    return parse_numeric(m[field], decimal_comma=False) if field in m else F.lit(None).cast("double")


def _attributes(df: DataFrame, used: list[str]) -> list:
    """num_attrs and text_attrs: every other non-blank cell, as number where it is one."""
    rest = [c for c in df.columns if c not in used]
    if not rest:
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        return [empty.alias("num_attrs"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("text_attrs")]
    names = F.array(*(F.lit(c) for c in rest))
    numbers = F.map_filter(F.map_from_arrays(names, F.array(*(parse_numeric(c) for c in rest))), lambda k, v: v.isNotNull())
    texts = F.map_filter(F.map_from_arrays(names, F.array(*(F.when(parse_numeric(c).isNull(), blank_to_null(c)) for c in rest))), lambda k, v: v.isNotNull())
    return [numbers.alias("num_attrs"), texts.alias("text_attrs")]


def reproject_xy(df: DataFrame, target_epsg: int) -> DataFrame:
    """``df(x, y, epsg)`` with x, y in the target system: 4326, 3857 or UTM (326zz, 327zz); z is untouched, unknown systems give null."""
    x, y, e = F.col("x"), F.col("y"), F.col("epsg")
    utm = e.between(32601, 32660) | e.between(32701, 32760)
    ux, uy = utm_to_lonlat(x, y, e)
    mx, my = mercator_to_lonlat(x, y)
    lon = F.when(e == 4326, x).when(e == 3857, mx).when(utm, ux)
    lat = F.when(e == 4326, y).when(e == 3857, my).when(utm, uy)
    out = df.withColumn("_lon", lon).withColumn("_lat", lat)
    if target_epsg == 4326:
        tx, ty = F.col("_lon"), F.col("_lat")
    elif target_epsg == 3857:
        tx, ty = lonlat_to_mercator(F.col("_lon"), F.col("_lat"))
    else:
        tx, ty = lonlat_to_utm(F.col("_lon"), F.col("_lat"), F.lit(target_epsg))
    same = e == target_epsg
    return out.withColumn("_x", F.when(same, x).otherwise(tx)).withColumn("_y", F.when(same, y).otherwise(ty)).withColumn("x", F.col("_x")).withColumn("y", F.col("_y")).withColumn("epsg", F.lit(target_epsg)).drop("_lon", "_lat", "_x", "_y")


def collar_ingest(df: DataFrame, mapping=None, source_epsg: int | None = 4326, target_epsg: int | None = None, z_is_relative: bool = False) -> DataFrame:
    """hole_id, x, y, z, epsg, qa_flags; rows without a hole or with unreadable x, y go; z is 0 if absent."""
    m = _mapped(df, ["hole_id", "x", "y", "z"], mapping)
    flags = [f for f, on in (("z_is_relative", z_is_relative), ("project_crs_missing", source_epsg is None)) if on]
    moved = target_epsg is not None and source_epsg is not None and target_epsg != source_epsg
    out = df.select(blank_to_null(m["hole_id"]).alias("hole_id"), _strict(m, "x").alias("x"), _strict(m, "y").alias("y"), F.coalesce(_strict(m, "z"), F.lit(0.0)).alias("z"), F.lit(source_epsg).cast("int").alias("epsg"))
    out = out.where("hole_id is not null and x is not null and y is not null")
    if moved:
        out = reproject_xy(out, target_epsg)
        flags.append("reprojected_xy")
    return out.withColumn("qa_flags", F.array(*(F.lit(f) for f in flags)).cast("array<string>"))


def survey_ingest(df: DataFrame, mapping=None) -> DataFrame:
    """hole_id, depth_m, azimuth_deg, dip_deg, qa_flags (segment_id:<v> where there is one); rows that lack one go."""
    m = _mapped(df, ["hole_id", "depth_m", "azimuth_deg", "dip_deg", "segment_id"], mapping)
    seg = blank_to_null(m["segment_id"]) if "segment_id" in m else F.lit(None).cast("string")
    flags = F.when(seg.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("segment_id:"), seg)))
    out = df.select(blank_to_null(m["hole_id"]).alias("hole_id"), *(_strict(m, f).alias(f) for f in ("depth_m", "azimuth_deg", "dip_deg")), flags.alias("qa_flags"))
    return out.dropna(subset=["hole_id", "depth_m", "azimuth_deg", "dip_deg"])


def assay_ingest(df: DataFrame, mapping=None) -> DataFrame:
    """hole_id, from_m, to_m, num_attrs, text_attrs, qa_flags."""
    m = _mapped(df, ["hole_id", "from_m", "to_m"], mapping)
    out = df.select(blank_to_null(m["hole_id"]).alias("hole_id"), _strict(m, "from_m").alias("from_m"), _strict(m, "to_m").alias("to_m"), *_attributes(df, list(m.values())), F.array().cast("array<string>").alias("qa_flags"))
    return out.dropna(subset=["hole_id", "from_m", "to_m"])


def surface_sample_ingest(df: DataFrame, grid: DataFrame | None = None, spec: dict | None = None, mapping=None, epsg: int = 4326, row_id: str | None = None) -> DataFrame:
    """id, x, y, z, epsg, num_attrs, text_attrs, qa_flags; ids default to S<row>; missing z come from a terrain grid, flagged."""
    m = _mapped(df, ["id", "x", "y", "z"], mapping)
    made = F.concat(F.lit("S"), (F.col(row_id) if row_id else F.monotonically_increasing_id() + 1).cast("string"))
    ident = F.coalesce(blank_to_null(m["id"]), made) if "id" in m else made
    used = [*m.values(), *([row_id] if row_id else [])]
    out = df.select(ident.alias("id"), _strict(m, "x").alias("x"), _strict(m, "y").alias("y"), _strict(m, "z").alias("z"), F.lit(epsg).alias("epsg"), *_attributes(df, used)).where("x is not null and y is not null")
    flag = F.array().cast("array<string>")
    if grid is None:
        return out.withColumn("qa_flags", flag)
    from .grids import bilinear_sample

    out = bilinear_sample(out, grid, spec, name="_t")
    filled = F.col("z").isNull() & F.col("_t").isNotNull()
    return out.withColumn("qa_flags", F.when(filled, F.array(F.lit("z_from_terrain_grid"))).otherwise(flag)).withColumn("z", F.coalesce("z", "_t")).drop("_t")


def choose_coord_mode(df: DataFrame, source_epsg: int = 4326) -> DataFrame:
    """mode, target_epsg, seen, plausible from ``df(x, y, lon, lat)`` in one aggregate.

    projected if at least half of the x, y rows look projected (outside
    degrees, both over 500); back to lonlat if the source is UTM, under half
    are plausible in it, and there are lon, lat. The target is the UTM zone of
    the mean lon, lat.
    """
    xy = F.col("x").isNotNull() & F.col("y").isNotNull()
    geographic = (F.abs("x") <= 180) & (F.abs("y") <= 90)
    looks = xy & ~geographic & (F.abs("x") > 500) & (F.abs("y") > 500)
    plausible = xy & F.col("x").between(1e5, 9e5) & F.col("y").between(0, 1e7)
    a = df.agg(F.count_if(xy).alias("seen"), F.count_if(looks).alias("p"), F.count_if(plausible).alias("plausible"), F.count_if(F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("geo"), F.avg("lon").alias("mlon"), F.avg("lat").alias("mlat"))
    utm = 32601 <= source_epsg <= 32660 or 32701 <= source_epsg <= 32760
    projected = (F.col("seen") > 0) & (F.col("p") * 2 >= F.col("seen"))
    back = F.lit(utm) & (F.col("plausible") * 2 < F.col("seen")) & (F.col("geo") > 0)
    mode = F.when(projected & ~back, "projected").otherwise("lonlat")
    target = F.when(mode == "projected", F.lit(source_epsg)).otherwise(F.coalesce(utm_epsg(F.col("mlon"), F.col("mlat")), F.lit(source_epsg)))
    return a.select(mode.alias("mode"), target.cast("int").alias("target_epsg"), "seen", "plausible")


def observation_ingest(df: DataFrame, mapping=None, source_epsg: int = 4326) -> DataFrame:
    """x, y, z, ts, segment_id, epsg, num_attrs, text_attrs of a raw observation table."""
    m = _mapped(df, ["x", "y", "z", "lon", "lat", "ts", "segment_id"], mapping)
    text = lambda f: blank_to_null(m[f]) if f in m else F.lit(None).cast("string")
    num = lambda f: parse_numeric(m[f]) if f in m else F.lit(None).cast("double")
    rows = df.select(*(num(f).alias(f) for f in ("x", "y", "z", "lon", "lat")), text("ts").alias("ts"), text("segment_id").alias("segment_id"), *_attributes(df, list(m.values())))
    mode, target, *_ = choose_coord_mode(rows, source_epsg).first()  # one row
    if mode == "projected":
        rows = rows.where("x is not null and y is not null").withColumn("epsg", F.lit(source_epsg))
    else:
        rows = rows.withColumn("x", F.coalesce("lon", "x")).withColumn("y", F.coalesce("lat", "y")).withColumn("epsg", F.lit(4326)).where("abs(x) <= 180 and abs(y) <= 90")
        rows = reproject_xy(rows, target)
    return rows.select("x", "y", F.coalesce("z", F.lit(0.0)).alias("z"), "ts", "segment_id", "epsg", "num_attrs", "text_attrs")


def ingest_report(raw: DataFrame, points: DataFrame, mode: DataFrame) -> DataFrame:
    """One row: rows_in, points_out, malformed_dropped, mode, epsg, seen, plausible."""
    a, b = raw.agg(F.count("*").alias("rows_in")), points.agg(F.count("*").alias("points_out"))
    return a.crossJoin(b).crossJoin(mode).select("rows_in", "points_out", (F.col("rows_in") - F.col("points_out")).alias("malformed_dropped"), "mode", F.col("target_epsg").alias("epsg"), "seen", "plausible")


def magnetic_row_filter(df: DataFrame) -> DataFrame:
    """Rows with coordinates (x, y or lon, lat) and a signal (tmf or mag_lev)."""
    has = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in df.columns else F.lit(False) for c in cs])
    return df.where((has("x", "y") | has("lon", "lat")) & (has("tmf") | has("mag_lev")))


def table_transform(df: DataFrame, rename: dict[str, str] | None = None, constants: dict | None = None, select: list[str] | None = None) -> DataFrame:
    """Renames (in order of the old names; a target that exists is replaced), constants, then a selection (unknown names skipped)."""
    for old in sorted(rename or {}):
        if old in df.columns and rename[old] != old:
            df = df.drop(rename[old]).withColumnRenamed(old, rename[old])
    for k, v in (constants or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df.select(*(c for c in select if c in df.columns)) if select else df


_NOT_MEASURES = ("x", "y", "z", "id", "hole_id", "from_m", "to_m", "depth_m", "crs", "epsg")


def numeric_fields(df: DataFrame, attrs: str = "num_attrs", by_count: bool = False) -> DataFrame:
    """field, n: attributes with a number, without coordinates, ids and depths."""
    e = df.select(F.explode(attrs).alias("field", "v")).where(F.col("v").isNotNull() & ~F.lower("field").isin(*_NOT_MEASURES))
    out = e.groupBy("field").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "field") if by_count else out


def top_attributes(df: DataFrame, attrs: str = "num_attrs", k: int = 20) -> DataFrame:
    e = df.select(F.explode(F.map_keys(attrs)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("n"), "field").limit(k)


def igrf_subtract(df: DataFrame, threshold: float = 5000.0) -> DataFrame:
    """m less igrf, if any row has igrf and the median of |m| is over ``threshold``; else m as it is."""
    v, over = F.abs(F.col("m").cast("double")), F.abs(F.col("m").cast("double")) > threshold
    # How many values lie over the threshold tells on which side of it the median is; only with one half on each side do the values next to it count.
    n, k, lo, hi = df.agg(F.count(v), F.count_if(over), F.max(F.when(~over, v)), F.min(F.when(over, v))).first()
    high = 2 * k > n or (0 < n == 2 * k and not 0.5 * lo + 0.5 * hi <= threshold)
    if not high or df.where("igrf is not null").isEmpty():
        return df
    return df.withColumn("m", F.when(F.col("igrf").isNotNull(), F.col("m") - F.col("igrf")).otherwise(F.col("m")))


def percentile_clamp(df: DataFrame, column: str = "v", lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Values clipped to the nearest-rank percentiles lo and hi."""
    a, b = kth_values(df, column, [lo / 100, hi / 100])
    return df if a is None else df.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.lit(b)), F.lit(a))))


def top_cut(df: DataFrame, column: str = "v", mode: str = "none", value: float | None = None, pct: float = 99.5) -> DataFrame:
    """``df`` with the column capped (hard_cap: at ``value``; percentile: at the nearest rank of ``pct``) and was_capped."""
    cap = {"none": None, "hard_cap": value, "percentile": kth_values(df, column, [pct / 100])[0] if mode == "percentile" else None}[mode]
    if cap is None:
        return df.withColumn("was_capped", F.lit(False))
    return df.withColumn("was_capped", F.coalesce(F.col(column) > cap, F.lit(False))).withColumn(column, F.least(F.col(column), F.lit(float(cap))))


def row_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def explode_row_arrays(dfs: list[DataFrame], key: str | None = None) -> DataFrame:
    """Rows from the first array column present (or ``key``) of each input, put together."""
    #: The order in which arrays are looked for.
    order = ("rows", "assays", "assay_points", "collars", "surveys", "segments", "points", "samples", "surface_samples", "trajectory")
    parts = []
    for d in dfs:
        own = [c for c in ([key] if key else order) if c in d.columns]
        if own:
            arrays = [F.when(F.size(c) >= 0, F.to_json(c)) for c in own]
            parts.append(d.select(F.explode(own[0]).alias("r")).select("r.*") if len(own) == 1 else d.select(F.explode(F.from_json(F.coalesce(*arrays), d.schema[own[0]].dataType)).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
