"""Readers and writers. Every reader gives a DataFrame; nothing is read on the driver but a few head lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import blank_to_null, parse_numeric
from ..operators.ingest import explode_row_arrays, infer_mapping  # noqa: F401
from ..operators.shared import scratch_path
from ..operators.versions import dataset_fingerprint
from .splits import before, json_objects, pieces

SEPARATORS = (",", ";", "\t", "|")


def sniff_separator(spark: SparkSession, path: str, lines: int = 30) -> str:
    """The most frequent separator in the first lines."""
    head = [r[0] for r in spark.read.text(path).limit(lines).collect()]
    return max(SEPARATORS, key=lambda s: sum(x.count(s) for x in head))


def detect_format(path: str, media_type: str = "", head: str = "") -> str:
    """csv, tsv, json or geojson: by extension, then media type, then content."""
    low = path.lower()
    for ext, kind in ((".geojson", "geojson"), (".json", "json"), (".tsv", "tsv"), (".csv", "csv"), (".asc", "ascii_grid")):
        if low.endswith(ext):
            return kind
    for part, kind in (("geo+json", "geojson"), ("json", "json"), ("tab-separated", "tsv"), ("csv", "csv")):
        if part in media_type:
            return kind
    text = head.lstrip()
    if text[:1] in ("{", "["):
        return "geojson" if '"FeatureCollection"' in text else "json"
    return "tsv" if text.count("\t") > text.count(",") else "csv"


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """Text columns, trimmed, blank cells null; short rows are filled, all-blank rows go."""
    raw = spark.read.csv(path, sep=sep or sniff_separator(spark, path), header=header, inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = raw.select(*(blank_to_null(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns))
    return df.dropna(how="all")


def _lines(objects: DataFrame, name: str) -> str:
    """The folder that one object a line was written to."""
    spark = objects.sparkSession
    path = scratch_path(spark, name)
    objects.write.text(path)
    return path


def _opens_with(spark: SparkSession, path: str) -> str:
    """The first character of the first file that isn't white space."""
    first = min(spark.read.option("recursiveFileLookup", "true").text(path).inputFiles(), default=None)
    row = first and pieces(spark, first, "}").where("start = 0").orderBy("no").select(F.substring(F.ltrim(F.regexp_replace("value", r"^[\\s\ufeff]+", "")), 1, 1)).first()
    return row[0] if row else ""


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of objects in any layout, or of objects one after another; columns are the union of keys."""
    return spark.read.json(_lines(json_objects(spark, path, 2 if _opens_with(spark, path) == "[" else 1), "json-rows"))


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """The features' properties with lon, lat and z (null if absent), of one or many feature collections."""
    kept = json_objects(spark, path, 3, "features").where(F.get_json_object("value", "$.geometry.type") == "Point")
    written = _lines(kept, "point-features")
    kind = next((f.dataType for f in spark.read.json(written).schema if f.name == "properties"), None)
    props = isinstance(kind, StructType)
    f = spark.read.text(written).select(F.from_json("value", StructType([StructField("geometry", _POINT), *([StructField("properties", kind)] if props else [])])).alias("f"))
    place = [F.get("f.geometry.coordinates", F.lit(k)).alias(n) for k, n in enumerate(("lon", "lat", "z"))]
    return f.select(*(["f.properties.*"] if props else []), *place)


_POINT = StructType([StructField("coordinates", ArrayType(DoubleType()))])


#: Properties that hold a line's level, in this order.
LEVEL_KEYS = ("elevation", "elev", "z", "contour", "level", "height", "value")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """x0, y0, z0, x1, y1, z1, level, has_z: consecutive vertices of LineString and MultiLineString features."""
    levels = ", ".join(f"`{k}`: string" for k in LEVEL_KEYS)
    f = json_objects(spark, path, 3, "features").select(F.from_json("value", f"geometry struct<type: string, coordinates: string>, properties struct<{levels}>").alias("f"))
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    level = F.coalesce(*(parse_numeric(F.col(f"f.properties.{k}"), decimal_comma=False) for k in LEVEL_KEYS))
    one = F.array(F.from_json(coords, "array<array<double>>"))
    f = f.select(level.alias("level"), F.explode(F.when(kind == "LineString", one).when(kind == "MultiLineString", F.from_json(coords, "array<array<array<double>>>"))).alias("line"))
    n = F.size("line")
    seg = f.where(n >= 2).select("level", F.explode(F.arrays_zip(F.slice("line", F.lit(1), n - 1).alias("a"), F.slice("line", F.lit(2), n - 1).alias("b"))).alias("s"))
    p = lambda e, k: F.get(F.col(f"s.{e}"), F.lit(k))
    return seg.select(*(p(e, k).alias(f"{c}{i}") for i, e in enumerate("ab") for k, c in enumerate("xyz")), "level", (p("a", 2).isNotNull() & p("b", 2).isNotNull()).alias("has_z"))


def read_ascii_grid(spark: SparkSession, path: str, nodata: float = -32768.0) -> tuple[DataFrame, dict]:
    """(grid, spec) of an Esri ASCII grid: six header lines in any case, then rows from north to south.

    Values are numbered by how many stand before them, in whole byte ranges and
    in their own (``splits``), so a file is read by many tasks and a row is one
    line. A folder counts as its files in the order of their names. Missing
    values are null, surplus ones are dropped.
    """
    first = min(spark.read.option("recursiveFileLookup", "true").text(path).inputFiles())
    head: dict[str, float] = {}
    for r in pieces(spark, first).where("start = 0").orderBy("no").limit(6).collect():
        parts = r[0].split()
        if len(parts) == 2 and not parts[0][0].isdigit():
            head[parts[0].lower()] = float(parts[1])
    nx, ny, size = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    none = head.get("nodata_value", nodata)
    x0 = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2)
    y0 = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2)
    rows = pieces(spark, path).where(~F.col("value").rlike(r"^[ \t]*[A-Za-z_]+[ \t]+\S+[ \t\r]*$")).withColumn("v", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))
    rows = before(rows.where("trim(value) <> ''").withColumn("n", F.size("v")), "n", "k0")
    cells = rows.select("k0", F.posexplode("v").alias("i", "t")).select((F.col("k0") + F.col("i")).alias("k"), parse_numeric("t", decimal_comma=False).alias("v")).where(F.col("k") < nx * ny)
    every = spark.range(nx * ny).select(F.col("id").alias("k")).join(cells, "k", "left")
    ix, iy = F.col("k") % nx, ny - 1 - F.floor(F.col("k") / nx)
    g = every.select(ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), (x0 + (ix + 0.5) * size).alias("x"), (y0 + (iy + 0.5) * size).alias("y"), F.when(F.col("v") != none, F.col("v")).alias("v"))
    return g, {"nx": nx, "ny": ny, "xmin": x0 + size / 2, "xmax": x0 + (nx - 0.5) * size, "ymin": y0 + size / 2, "ymax": y0 + (ny - 0.5) * size}


def geojson_features(df: DataFrame) -> DataFrame:
    """value: one GeoJSON feature a row, a point from x, y[, z] or a line from x0, y0, x1, y1; other columns are properties."""
    line = "x0" in df.columns
    used = {"x0", "y0", "x1", "y1"} if line else {"x", "y", "z"}
    props = F.struct(*[c for c in df.columns if c not in used] or [F.lit(None).alias("none")])
    at = F.array(F.array("x0", "y0"), F.array("x1", "y1")) if line else F.array("x", "y", *(["z"] if "z" in df.columns else []))
    geometry = F.struct(F.lit("LineString" if line else "Point").alias("type"), at.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    """Sharded text files with one feature a line."""
    geojson_features(df).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str, form: str = "parquet") -> DataFrame:
    """Write the rows and give the hash of their content, whatever their order."""
    df.write.mode("overwrite").format(form).save(path)
    return dataset_fingerprint(df, df.columns)


