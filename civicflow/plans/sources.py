"""Registered source / sink queries: each writes landed data derived from the
given tables into the shared checkpoint folder and reads it back through the
reader under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.plans import geo as PG
from civicflow.plans.weather import _DAILY, _MERGED, merged
from civicflow.operators import clean, weather
from civicflow.plans.standins import (
    CLEAN_REQUESTS_SQL, RAW_REQUESTS_SQL, key_to_lat, key_to_lon, raw_requests, sql_lat, sql_lon, station_day,
)
from civicflow.session import scratch_path
from civicflow.sources import files as S
from civicflow.sources import ingest as I
from civicflow.sources.tables import read_table

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])
PAGE_ATTRIBUTES = T.StructType([
    T.StructField("OBJECTID", T.LongType()), T.StructField("service_request_id", T.LongType()),
    T.StructField("category", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("requested_datetime", T.LongType()),
])
PAGE_SIZE = 1000
CENSUS_TYPES = {
    "NAME": T.StringType(), "B01003_001E": T.LongType(), "B19013_001E": T.LongType(), "B25077_001E": T.LongType(),
    "state": T.StringType(), "county": T.StringType(), "tract": T.StringType(),
}
LAYER_PROPS = T.StructType([
    T.StructField("GEOID", T.StringType()), T.StructField("COUNTYFP", T.StringType()), T.StructField("NAME", T.StringType())
])


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def q_csv_parquet_roundtrip(spark, sf_dir):
    """A1 + A2: customer -> CSV + Parquet (partitioned by segment) -> CSV read back."""
    base = _scratch(spark, "dual-sink")
    S.write_csv_and_parquet(read_table(spark, sf_dir, "customer"), f"{base}/csv", f"{base}/parquet", ["c_mktsegment"])
    return S.read_csv(spark, f"{base}/csv", CUSTOMER_SCHEMA)


def q_parquet_roundtrip(spark, sf_dir):
    base = _scratch(spark, "dual-sink")
    S.write_csv_and_parquet(read_table(spark, sf_dir, "customer"), f"{base}/csv", f"{base}/parquet", ["c_mktsegment"])
    return spark.read.parquet(f"{base}/parquet").select(*CUSTOMER_SCHEMA.fieldNames())


def q_feature_pages(spark, sf_dir):
    """A3 + S1: orders landed as REST pages (epoch-ms dates, x/y geometry) and decoded."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    rows = o.select(
        F.col("o_orderkey").alias("OBJECTID"), F.col("o_orderkey").alias("service_request_id"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("requested_datetime"),
        key_to_lon(F.col("o_custkey")).alias("x"), key_to_lat(F.col("o_custkey")).alias("y"),
    )
    path = _scratch(spark, "feature-pages")
    S.write_feature_pages(rows, "OBJECTID", PAGE_SIZE, path)
    return S.read_feature_pages(spark, path, PAGE_ATTRIBUTES, ("requested_datetime",))


def q_census_rows(spark, sf_dir):
    """A4 + S17: per-county header-row JSON arrays decoded to a typed table."""
    rows = PG.census_rows(spark, sf_dir).select(
        F.concat(F.lit("Census Tract "), F.col("tract").cast("string")).alias("NAME"),
        "B01003_001E", "B19013_001E", "B25077_001E",
        F.col("state").cast("string").alias("state"), F.col("county").cast("string").alias("county"),
        F.col("tract").cast("string").alias("tract"),
    )
    path = _scratch(spark, "census")
    S.write_header_arrays(rows, "county", list(CENSUS_TYPES), path)
    return S.read_header_arrays(spark, path, CENSUS_TYPES)


def _layer(spark, sf_dir):
    t = PG.tracts(spark, sf_dir).select(
        F.col("geoid").alias("GEOID"), F.substring("geoid", 3, 3).alias("COUNTYFP"),
        F.concat(F.lit("Tract "), F.col("n_nationkey").cast("string")).alias("NAME"), "rings",
    )
    path = _scratch(spark, "layer")
    S.write_feature_lines(t, ["GEOID", "COUNTYFP", "NAME"], path)
    return S.read_feature_lines(spark, path, LAYER_PROPS)


def q_polygon_layer(spark, sf_dir):
    """GeoJSON layer read back, filtered to one county, with vertex counts and area."""
    from civicflow.operators.geo import polygon_area_km2

    layer = _layer(spark, sf_dir).filter(F.col("COUNTYFP") == "041")
    return layer.select(
        "GEOID", "NAME", "part", F.size(F.flatten("rings")).alias("n_vertices"),
        polygon_area_km2(F.col("rings")).alias("area_sqkm"),
    )


def q_layer_summary(spark, sf_dir):
    """Feature count and total bounds of the whole layer."""
    return S.layer_summary(_layer(spark, sf_dir)).select(
        "n_features", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    )


def q_attribute_table(spark, sf_dir):
    """The layer's attribute table (geometry dropped) through the CSV sink."""
    base = _scratch(spark, "attributes")
    S.write_csv_and_parquet(_layer(spark, sf_dir).drop("rings", "part"), f"{base}/csv", f"{base}/parquet")
    return S.read_csv(spark, f"{base}/csv", LAYER_PROPS)


ROAD_PROPS = T.StructType([T.StructField("ROAD_ID", T.StringType()), T.StructField("REGION", T.IntegerType())])


def q_road_layer(spark, sf_dir):
    """A line layer (one road per region through its tracts' centres, in nation order)
    landed as GeoJSON and read back; vertex count and great-circle length per road."""
    from civicflow.operators.geo import line_length_km

    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    cx = F.lit(PG.GRID_X0) + (F.col("n_nationkey") % PG.GRID_COLS) * PG.TRACT_SIDE + PG.TRACT_SIDE / 2
    cy = F.lit(PG.GRID_Y0) + F.floor(F.col("n_nationkey") / PG.GRID_COLS) * PG.TRACT_SIDE + PG.TRACT_SIDE / 2
    pts = n.select("n_regionkey", F.struct(F.col("n_nationkey").alias("k"), cx.alias("x"), cy.alias("y")).alias("p"))
    roads = pts.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("p")).alias("_p")).select(  # <= 25 vertices
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("ROAD_ID"),
        F.col("n_regionkey").cast("int").alias("REGION"),
        F.transform("_p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("path"),
    )
    path = _scratch(spark, "roads")
    S.write_feature_lines(roads, ["ROAD_ID", "REGION"], path, "path")
    layer = S.read_feature_lines_of_roads(spark, path, ROAD_PROPS)
    return layer.select("ROAD_ID", "REGION", "part", F.size("path").alias("n_vertices"),
                        F.round(line_length_km(F.col("path")), 4).alias("length_km"))


def q_merged_partitioned_sink(spark, sf_dir):
    """E1 + A2: the cleaned requests joined to daily weather, written as Parquet partitioned
    by request year and month (plus CSV), and read back whole. (A filter on the year or month
    prunes partitions at listing time.)"""
    base = _scratch(spark, "merged")
    m = merged(spark, sf_dir).drop("requested_datetime", "date_closed")
    S.write_csv_and_parquet(m, f"{base}/csv", f"{base}/parquet", ["requested_year", "requested_month"])
    back = spark.read.parquet(f"{base}/parquet")
    return back.select("object_id", "requested_year", "requested_month", "requested_date", "cluster",
                        "resolution_days", "tmax_avg", "prcp_avg")


def q_row_cap(spark, sf_dir):
    """The first 100 records by id (the ingest's max_records option)."""
    return S.first_rows(read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "o_orderkey", 100)


# Landed requests without coordinates, and with the placeholder closing date.
UNPLACED_EVERY, PLACEHOLDER_EVERY = 31, 37


def landed_requests(spark, sf_dir):
    """Requests as a portal lands them: some without coordinates, some closed on 1900-01-01."""
    r = raw_requests(spark, sf_dir)
    placed = F.col("OBJECTID") % UNPLACED_EVERY != 0
    placeholder = F.lit("1900-01-01").cast(r.schema["date_closed"].dataType)
    return r.withColumns({
        "lat": F.when(placed, F.col("lat")),
        "date_closed": F.when(F.col("OBJECTID") % PLACEHOLDER_EVERY == 0, placeholder).otherwise(F.col("date_closed")),
    })


def _ingest(spark, sf_dir, folder):
    missing = F.col("lat").isNull() | F.col("long").isNull()
    datasets = {
        "requests": I.Dataset(lambda: landed_requests(spark, sf_dir), "requests portal", clean.clean_requests,
                              missing, "requested_date"),
        "weather": I.Dataset(lambda: weather.daily_weather(station_day(spark, sf_dir)), "stations", date="date"),
        "unshipped": I.Dataset(lambda: read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate").isNull()),
                               "open lines"),
        "permits": I.Dataset(lambda: read_table(spark, sf_dir, "permits"), "not landed"),
    }
    return I.ingest(spark, datasets, folder)


def q_ingest_report(spark, sf_dir):
    """A10 + A13 + B3: a run over four datasets, of which one is empty and one was not landed."""
    return _ingest(spark, sf_dir, _scratch(spark, "ingest")).select(
        "dataset", "source", "status", "n_rows", "n_dropped", "n_columns", "min_date", "max_date", "error"
    )


def q_ingested_requests(spark, sf_dir):
    """S2 + B3: the requests that the run wrote: none without coordinates, no placeholder date."""
    folder = _scratch(spark, "ingest")
    _ingest(spark, sf_dir, folder)
    return spark.read.parquet(f"{folder}/requests").select(
        "object_id", "requested_date", "date_closed", "resolution_days", "lat", "long"
    )


QUERIES = {
    "ingest_report": q_ingest_report,
    "ingested_requests": q_ingested_requests,
    "csv_parquet_roundtrip": q_csv_parquet_roundtrip,
    "parquet_roundtrip": q_parquet_roundtrip,
    "feature_pages": q_feature_pages,
    "census_rows": q_census_rows,
    "polygon_layer": q_polygon_layer,
    "layer_summary": q_layer_summary,
    "attribute_table": q_attribute_table,
    "road_layer": q_road_layer,
    "row_cap": q_row_cap,
    "merged_partitioned_sink": q_merged_partitioned_sink,
}

_GEOID = ("lpad('6', 2, '0') || lpad(CASE WHEN n_regionkey = 4 THEN '13' ELSE '41' END, 3, '0') "
          "|| lpad(CAST(n_nationkey * 100 + 1 AS VARCHAR), 6, '0')")


_LANDED = f"""
SELECT * REPLACE (CASE WHEN object_id % {UNPLACED_EVERY} <> 0 THEN lat END AS lat,
                  CASE WHEN object_id % {PLACEHOLDER_EVERY} = 0 THEN TIMESTAMP '1900-01-01' ELSE date_closed END AS date_closed)
FROM ({RAW_REQUESTS_SQL}) landed"""
_INGESTED = CLEAN_REQUESTS_SQL.replace(RAW_REQUESTS_SQL, _LANDED)

ORACLE = {
    "ingest_report": f"""
SELECT 'requests' AS dataset, 'requests portal' AS source, 'success' AS status, CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FILTER (WHERE lat IS NULL OR long IS NULL) FROM ({_LANDED}) r) AS BIGINT) AS n_dropped,
       23 AS n_columns, min(requested_date) AS min_date, max(requested_date) AS max_date, CAST(NULL AS VARCHAR) AS error
FROM ({_INGESTED}) c
UNION ALL SELECT 'weather', 'stations', 'success', CAST(count(*) AS BIGINT), 0, 6, min(date), max(date), NULL
FROM ({_DAILY}) d
UNION ALL SELECT 'unshipped', 'open lines', CASE WHEN count(*) > 0 THEN 'success' ELSE 'failed' END,
       CAST(count(*) AS BIGINT), 0, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)), NULL, NULL, NULL
FROM lineitem WHERE l_shipdate IS NULL
UNION ALL SELECT 'permits', 'not landed', 'error', NULL, NULL, NULL, NULL, NULL, 'PATH_NOT_FOUND'""",
    "ingested_requests": f"""
SELECT object_id, requested_date, date_closed, resolution_days, lat, long FROM ({_INGESTED}) c""",
    "merged_partitioned_sink": f"""
SELECT object_id, requested_year, requested_month, requested_date, cluster, resolution_days, tmax_avg, prcp_avg
FROM ({_MERGED}) m""",
    "csv_parquet_roundtrip": "SELECT * FROM customer",
    "parquet_roundtrip": "SELECT * FROM customer",
    "feature_pages": f"""
SELECT o_orderkey AS OBJECTID, o_orderkey AS service_request_id, o_orderpriority AS category, o_orderstatus AS status,
       o_orderdate AS requested_datetime, {sql_lon('o_custkey')} AS long, {sql_lat('o_custkey')} AS lat FROM orders""",
    "census_rows": f"""
SELECT 'Census Tract ' || CAST(n_nationkey * 100 + 1 AS VARCHAR) AS NAME, CAST(cnt * 37 AS BIGINT) AS B01003_001E,
       CASE WHEN n_nationkey % 7 = 3 THEN -666666666 ELSE CAST(round(av * 15) AS BIGINT) END AS B19013_001E,
       CASE WHEN n_nationkey % 11 = 5 THEN -999999999 ELSE CAST(round(mx * 50) AS BIGINT) END AS B25077_001E,
       '6' AS state, CASE WHEN n_regionkey = 4 THEN '13' ELSE '41' END AS county,
       CAST(n_nationkey * 100 + 1 AS VARCHAR) AS tract
FROM (SELECT c_nationkey, count(*) AS cnt, avg(c_acctbal) AS av, max(c_acctbal) AS mx FROM customer GROUP BY 1) a
JOIN nation ON c_nationkey = n_nationkey""",
    "polygon_layer": f"""
SELECT t.geoid AS GEOID, 'Tract ' || CAST(n.n_nationkey AS VARCHAR) AS NAME, 0 AS part,
       CAST(len(flatten(t.rings)) AS INTEGER) AS n_vertices, a.land_area_sqkm AS area_sqkm
FROM ({PG._tracts_sql()}) t JOIN nation n USING (n_nationkey) JOIN {PG._AREA} a ON a.geoid = t.geoid""",
    "layer_summary": f"""
SELECT CAST(count(DISTINCT geoid) AS BIGINT) AS n_features, round(min(p.x), 6) AS min_x, round(min(p.y), 6) AS min_y,
       round(max(p.x), 6) AS max_x, round(max(p.y), 6) AS max_y
FROM (SELECT geoid, unnest(flatten(rings)) AS p FROM ({PG._tracts_sql()}) t) v""",
    "attribute_table": f"""
SELECT {_GEOID} AS GEOID, CASE WHEN n_regionkey = 4 THEN '013' ELSE '041' END AS COUNTYFP,
       'Tract ' || CAST(n_nationkey AS VARCHAR) AS NAME FROM nation""",
    "row_cap": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 100",
    "road_layer": f"""
WITH c AS (
  SELECT n_regionkey, n_nationkey,
         {PG._d(PG.GRID_X0)} + CAST(n_nationkey % {PG.GRID_COLS} AS DOUBLE) * {PG._d(PG.TRACT_SIDE)} + {PG._d(PG.TRACT_SIDE / 2)} AS x,
         {PG._d(PG.GRID_Y0)} + floor(n_nationkey / {PG.GRID_COLS}) * {PG._d(PG.TRACT_SIDE)} + {PG._d(PG.TRACT_SIDE / 2)} AS y
  FROM nation),
s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))
SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS ROAD_ID, CAST(n_regionkey AS INTEGER) AS REGION, 0 AS part,
       CAST(count(*) AS INTEGER) AS n_vertices,
       round(coalesce(sum(CASE WHEN px IS NOT NULL THEN {PG._d(2 * 6371.0088)} * asin(sqrt(pow(sin((radians(y) - radians(py)) / 2), 2)
             + cos(radians(py)) * cos(radians(y)) * pow(sin(radians(x - px) / 2), 2))) END), 0.0), 4) AS length_km
FROM s GROUP BY n_regionkey""",
}
