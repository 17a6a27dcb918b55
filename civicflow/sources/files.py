"""File sources and sinks.

Readers always take an explicit schema (no inference pass over the data) and
return lazy DataFrames; writers are plain ``DataFrameWriter`` calls. Landed JSON
in the shapes the reference's services return is decoded with ``from_json`` /
``explode`` -- nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# A1 / A2: CSV + Parquet
# ---------------------------------------------------------------------------


def write_csv_and_parquet(df: DataFrame, csv_path: str, parquet_path: str, partition_by: list[str] | None = None) -> None:
    """A2: the same table as header CSV (quotes / newlines escaped) and as Parquet.

    A task sorts its rows by the partition columns before it writes them, so these are rebalanced
    first: a task then holds rows of one or a few partitions, as many as AQE's advisory size allows,
    whatever the size of the task that made them (which AQE sizes by the narrower rows it read)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(csv_path)
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(parquet_path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """A1: header CSV with an explicit schema. A file is read by several tasks unless
    ``multi_line`` is set, which quoted fields with line breaks need (then one task a file)."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def first_rows(df: DataFrame, order_col: str, n: int | None) -> DataFrame:
    """An optional row cap on input ordered by its id (the ingest's max_records)."""
    return df if n is None else df.orderBy(order_col).limit(n)


# ---------------------------------------------------------------------------
# A3: feature pages  {"features": [{"attributes": {...}, "geometry": {"x", "y"}}], ...}
# ---------------------------------------------------------------------------

def page_schema(attributes: T.StructType) -> T.StructType:
    feature = T.StructType([
        T.StructField("attributes", attributes),
        T.StructField("geometry", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])),
    ])
    return T.StructType([
        T.StructField("features", T.ArrayType(feature)),
        T.StructField("exceededTransferLimit", T.BooleanType()),
    ])


def write_feature_pages(rows: DataFrame, key: str, page_size: int, path: str, x: str = "x", y: str = "y") -> None:
    """Land rows as REST-style pages of ``page_size`` features (one JSON document per line)."""
    attrs = [c for c in rows.columns if c not in (x, y)]
    feat = F.struct(F.struct(*attrs).alias("attributes"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("geometry"))
    pages = rows.groupBy(F.floor(F.col(key) / page_size).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(key).alias("_k"), feat.alias("f")))).alias("_fs")
    )  # one page holds at most page_size features
    last = rows.agg(F.max(F.floor(F.col(key) / page_size)).alias("_last"))
    pages = pages.crossJoin(F.broadcast(last)).select(  # one-row frame
        F.transform("_fs", lambda e: e["f"]).alias("features"), (F.col("page") < F.col("_last")).alias("exceededTransferLimit")
    )
    pages.write.mode("overwrite").json(path)


def read_feature_pages(spark: SparkSession, path: str, attributes: T.StructType,
                       epoch_ms_cols: tuple[str, ...] = ()) -> DataFrame:
    """A3: pages -> one row per feature: attributes flattened, geometry x/y -> longitude /
    latitude, epoch-millisecond attributes -> timestamps."""
    pages = spark.read.schema(page_schema(attributes)).json(path)
    f = pages.select(F.explode("features").alias("f"))
    cols: list[Column] = []
    for fld in attributes.fields:
        c = F.col(f"f.attributes.{fld.name}")
        if fld.name in epoch_ms_cols:
            c = F.timestamp_millis(c).cast("timestamp_ntz")
        cols.append(c.alias(fld.name))
    return f.select(*cols, F.col("f.geometry.x").alias("long"), F.col("f.geometry.y").alias("lat"))


# ---------------------------------------------------------------------------
# A4: header-row JSON arrays  [["NAME","B01003_001E",...],["x","123",...],...]
# ---------------------------------------------------------------------------

def write_header_arrays(rows: DataFrame, group: str, columns: list[str], path: str) -> None:
    """Land one header-row JSON array per ``group`` value (one response per county)."""
    as_text = F.array(*[F.col(c).cast("string") for c in columns])
    docs = rows.groupBy(group).agg(F.collect_list(as_text).alias("_rows"))  # one county's rows
    header = F.array(F.array(*[F.lit(c) for c in columns]))
    docs.select(F.to_json(F.concat(header, F.col("_rows"))).alias("value")).write.mode("overwrite").text(path)


def read_header_arrays(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame:
    """A4 + S17: each document's first row names the columns; values are looked up by
    name and coerced with ``try_cast`` (malformed -> null)."""
    docs = spark.read.text(path).select(F.from_json("value", "array<array<string>>").alias("a"))
    rows = docs.select(F.col("a")[0].alias("header"), F.posexplode("a").alias("pos", "r")).filter(F.col("pos") > 0)
    return rows.select(*[
        F.element_at("r", F.array_position("header", F.lit(name)).cast("int")).try_cast(t).alias(name)
        for name, t in types.items()
    ])


# ---------------------------------------------------------------------------
# GeoJSON polygon layers
# ---------------------------------------------------------------------------

_COORDS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
_MULTI = T.ArrayType(_COORDS)


def feature_schema(props: T.StructType) -> T.StructType:
    geom = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    return T.StructType([
        T.StructField("type", T.StringType()), T.StructField("properties", props), T.StructField("geometry", geom)
    ])


def geojson_schema(props: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature_schema(props)))
    ])


def write_feature_lines(features: DataFrame, props: list[str], path: str, geometry: str = "rings") -> None:
    """A6-A8 sink: one GeoJSON feature per line, written where the row is (no shuffle, no row that
    holds a layer). ``geometry`` names the column: ``rings`` gives Polygons, ``parts`` (an array
    of rings) MultiPolygons, ``path`` LineStrings."""
    def positions(points):
        return F.transform(points, lambda p: F.array(p["x"], p["y"]))

    def polygon(rings):
        return F.transform(rings, positions)

    kinds = {"rings": ("Polygon", polygon), "path": ("LineString", positions),
             "parts": ("MultiPolygon", lambda parts: F.transform(parts, polygon))}
    kind, coordinates = kinds[geometry]
    features.select(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(p) for p in props]).alias("properties"),
        F.struct(F.lit(kind).alias("type"), coordinates(F.col(geometry)).alias("coordinates")).alias("geometry"),
    ).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_feature_lines(spark: SparkSession, path: str, props: T.StructType) -> DataFrame:
    """One feature per line -> one row per polygon part, as ``read_geojson`` gives; a file is
    read by as many tasks as it has splits."""
    return _polygon_parts(spark.read.schema(feature_schema(props)).json(path).select(F.struct("*").alias("f")))


def read_feature_lines_of_roads(spark: SparkSession, path: str, props: T.StructType) -> DataFrame:
    """One line feature per line of text -> one row per part, as ``read_geojson_lines`` gives."""
    return _line_parts(spark.read.schema(feature_schema(props)).json(path).select(F.struct("*").alias("f")))


def write_geojson(polys: DataFrame, props: list[str], path: str, group: str) -> None:
    """One FeatureCollection per ``group`` value (e.g. county), Polygon geometries
    with [x, y] positions; attribute tables go through ``write_csv_and_parquet``."""
    coords = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(p) for p in props]).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
    )
    fc = polys.groupBy(group).agg(F.collect_list(feat).alias("features"))  # one county's polygons
    fc.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_geojson(spark: SparkSession, path: str, props: T.StructType) -> DataFrame:
    """FeatureCollections -> one row per polygon part: properties + rings
    (array<array<struct<x,y>>>, outer ring first). MultiPolygons yield one row per part."""
    docs = spark.read.text(path).select(F.from_json("value", geojson_schema(props)).alias("d"))
    return _polygon_parts(docs.select(F.explode("d.features").alias("f")))


def _polygon_parts(f: DataFrame) -> DataFrame:
    g = f.select(
        "f.properties.*",
        F.col("f.geometry.type").alias("gtype"),
        F.col("f.geometry.coordinates").alias("coords"),
    )
    multi = F.when(F.col("gtype") == "MultiPolygon", F.from_json("coords", _MULTI)).otherwise(
        F.array(F.from_json("coords", _COORDS))
    )
    parts = g.select(*[c for c in g.columns if c not in ("gtype", "coords")], F.posexplode(multi).alias("part", "poly"))
    rings = F.transform("poly", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return parts.select(*[c for c in parts.columns if c != "poly"], rings.alias("rings"))


def layer_summary(polys: DataFrame) -> DataFrame:
    """Feature count and total bounds of a layer."""
    pts = polys.select(F.explode(F.flatten("rings")).alias("p"))
    bounds = pts.agg(
        F.min("p.x").alias("min_x"), F.min("p.y").alias("min_y"), F.max("p.x").alias("max_x"), F.max("p.y").alias("max_y")
    )
    return polys.agg(F.count(F.lit(1)).cast("long").alias("n_features")).crossJoin(bounds)  # two one-row frames


_LINE = T.ArrayType(T.ArrayType(T.DoubleType()))
_MULTILINE = T.ArrayType(_LINE)


def write_geojson_lines(lines: DataFrame, props: list[str], path: str, group: str) -> None:
    """A8 sink side: LineString features (``path`` array<struct<x,y>>), one collection per group."""
    coords = F.transform("path", lambda p: F.array(p["x"], p["y"]))
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(p) for p in props]).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
    )
    fc = lines.groupBy(group).agg(F.collect_list(feat).alias("features"))  # one group's lines
    fc.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_geojson_lines(spark: SparkSession, path: str, props: T.StructType) -> DataFrame:
    """Road-style line layers; LineString and MultiLineString -> one row per part
    with ``path`` array<struct<x,y>>."""
    docs = spark.read.text(path).select(F.from_json("value", geojson_schema(props)).alias("d"))
    return _line_parts(docs.select(F.explode("d.features").alias("f")))


def _line_parts(f: DataFrame) -> DataFrame:
    f = f.select(
        "f.properties.*", F.col("f.geometry.type").alias("gtype"), F.col("f.geometry.coordinates").alias("coords")
    )
    multi = F.when(F.col("gtype") == "MultiLineString", F.from_json("coords", _MULTILINE)).otherwise(
        F.array(F.from_json("coords", _LINE))
    )
    parts = f.select(*[c for c in f.columns if c not in ("gtype", "coords")], F.posexplode(multi).alias("part", "line"))
    return parts.select(
        *[c for c in parts.columns if c != "line"],
        F.transform("line", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("path"),
    )
