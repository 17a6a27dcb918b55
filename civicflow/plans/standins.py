"""Driver tables re-shaped into the domain inputs the operators expect.

The test data is a TPC-H-like star schema; these frames map it onto the
request / station / tract concepts (SURVEY 7.2). Each frame is a lazy plan
over the given tables, so its size grows with them.

Join order is written smallest-first on purpose: orders joins customer (and the
fixed 25-row nation dimension) before meeting lineitem, so the widest table is
shuffled once, on its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.sources.tables import read_table

# The stand-in coordinate grid (origin, extent, hash moduli).
LAT0, LON0, EXTENT = 37.80, -122.70, 0.35
LAT_MULT, LAT_MOD = 7919, 10007
LON_MULT, LON_MOD = 104729, 10009


def key_to_lat(key: Column) -> Column:
    return F.lit(LAT0) + F.pmod(key * F.lit(LAT_MULT), F.lit(LAT_MOD)) / F.lit(float(LAT_MOD)) * F.lit(EXTENT)


def key_to_lon(key: Column) -> Column:
    return F.lit(LON0) + F.pmod(key * F.lit(LON_MULT), F.lit(LON_MOD)) / F.lit(float(LON_MOD)) * F.lit(EXTENT)


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (custkey, lat, long, district, zone). nation is a fixed 25-row dimension."""
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey",
        "c_mktsegment",
        key_to_lat(F.col("c_custkey")).alias("lat"),
        key_to_lon(F.col("c_custkey")).alias("long"),
        F.col("n_name").alias("district"),
        (F.col("n_regionkey") + 1).alias("cluster"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-shaped request rows: one per line item, opened at the order date and
    closed at the ship date; category = "priority / segment", zone = region."""
    orders = read_table(
        spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    places = customer_places(spark, sf_dir)
    order_side = orders.join(places, orders.o_custkey == places.c_custkey)
    lineitem = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    joined = lineitem.join(order_side, lineitem.l_orderkey == order_side.o_orderkey)
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("OBJECTID"),
        F.col("l_orderkey").alias("service_request_id"),
        F.concat_ws(" / ", "o_orderpriority", "c_mktsegment").alias("category"),
        F.when(F.col("o_orderstatus") == "F", "Closed")
        .when(F.col("o_orderstatus") == "O", "Open")
        .otherwise("In Progress")
        .alias("status"),
        F.col("o_orderdate").alias("requested_datetime"),
        F.col("l_shipdate").alias("date_closed"),
        "lat",
        "long",
        F.upper("district").alias("district"),
        "cluster",
    )


# ---------------------------------------------------------------------------
# SQL twins of the stand-ins, for the DuckDB oracle (same arithmetic).
# ---------------------------------------------------------------------------

def sql_lat(key: str) -> str:
    return f"({LAT0}::DOUBLE + (({key} * {LAT_MULT}) % {LAT_MOD}) / {float(LAT_MOD)}::DOUBLE * {EXTENT}::DOUBLE)"


def sql_lon(key: str) -> str:
    return f"({LON0}::DOUBLE + (({key} * {LON_MULT}) % {LON_MOD}) / {float(LON_MOD)}::DOUBLE * {EXTENT}::DOUBLE)"


RAW_REQUESTS_SQL = f"""
SELECT l.l_orderkey * 8 + l.l_linenumber AS object_id,
       l.l_orderkey AS service_request_id,
       o.o_orderpriority || ' / ' || c.c_mktsegment AS category,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Closed' WHEN o.o_orderstatus = 'O' THEN 'Open'
            ELSE 'In Progress' END AS status,
       o.o_orderdate AS requested_datetime,
       l.l_shipdate AS date_closed,
       {sql_lat('c.c_custkey')} AS lat,
       {sql_lon('c.c_custkey')} AS long,
       upper(n.n_name) AS district,
       n.n_regionkey + 1 AS cluster
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

CLEAN_REQUESTS_SQL = f"""
SELECT object_id, service_request_id, category,
       trim(split_part(category, ' / ', 1)) AS category_short,
       status,
       CAST(coalesce(lower(status) = 'closed', false) AS INTEGER) AS status_binary,
       requested_datetime,
       CAST(requested_datetime AS DATE) AS requested_date,
       CAST(year(requested_datetime) AS INTEGER) AS requested_year,
       CAST(month(requested_datetime) AS INTEGER) AS requested_month,
       CAST(weekofyear(requested_datetime) AS INTEGER) AS requested_week,
       dayname(requested_datetime) AS requested_day_of_week,
       CAST(hour(requested_datetime) AS INTEGER) AS requested_hour,
       CASE WHEN year(date_closed) = 1900 THEN NULL ELSE date_closed END AS date_closed,
       CASE WHEN rd < 0 OR rd > 1825 THEN NULL ELSE rd END AS resolution_days,
       lat, long,
       CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS zipcode, district,
       CAST(NULL AS VARCHAR) AS description,
       0 AS has_description,
       cluster
FROM (
  SELECT *, round((epoch(CASE WHEN year(date_closed) = 1900 THEN NULL ELSE date_closed END)
                   - epoch(requested_datetime)) / 86400.0, 2) AS rd
  FROM ({RAW_REQUESTS_SQL}) raw
  WHERE lat IS NOT NULL AND long IS NOT NULL
) x
"""


def station_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide station-day readings: station = supplier, day = ship date; one row per line item.
    Precipitation is missing on 'N' lines and wind on open lines, so both null rules trigger;
    WT01 marks returned lines; the other weather-type columns are absent."""
    li = read_table(
        spark, sf_dir, "lineitem",
        "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        "l_returnflag", "l_linestatus",
    )
    return li.select(
        F.col("l_suppkey").alias("STATION"),
        F.to_date("l_shipdate").alias("DATE"),
        F.col("l_quantity").alias("TMAX"),
        (F.col("l_discount") * 100.0).alias("TMIN"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 100.0).alias("PRCP"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / 1000.0).alias("AWND"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("WT01"),
    )


# Event types standing in for weather datatypes.
EVENT_DATATYPE = {"purchase": "PRCP", "view": "TMAX", "click": "TMIN", "signup": "AWND", "error": "SNOW"}


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form readings (station, date, datatype, value) from events."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_DATATYPE.items() for x in kv])
    return ev.select(
        F.col("user_id").alias("station"),
        F.to_date("ts").alias("date"),
        mapping[F.col("event_type")].alias("datatype"),
        "value",
        F.col("event_id").alias("reading_id"),
    )


STATION_DAY_SQL = """
SELECT l_suppkey AS STATION, CAST(l_shipdate AS DATE) AS DATE, l_quantity AS TMAX, l_discount * 100.0 AS TMIN,
       CASE WHEN l_returnflag <> 'N' THEN l_tax * 100.0 END AS PRCP,
       CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 1000.0 END AS AWND,
       CASE WHEN l_returnflag = 'R' THEN 1 END AS WT01
FROM lineitem
"""

READINGS_LONG_SQL = """
SELECT user_id AS station, CAST(ts AS DATE) AS date,
       CASE event_type WHEN 'purchase' THEN 'PRCP' WHEN 'view' THEN 'TMAX' WHEN 'click' THEN 'TMIN'
                       WHEN 'signup' THEN 'AWND' WHEN 'error' THEN 'SNOW' END AS datatype,
       value, event_id AS reading_id
FROM events
"""


# The training window of the stand-in order series starts on a Monday.
SERIES_START = "1996-01-01"


def zone_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their zone (customer -> nation -> region); the weekly-series input."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    places = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    return orders.join(places, orders.o_custkey == places.c_custkey).select(
        "o_orderkey",
        F.col("o_orderdate").alias("requested_datetime"),
        (F.col("n_regionkey") + 1).alias("cluster"),
        (F.col("n_nationkey") + 1).alias("nation_zone"),
    )


ZONE_ORDERS_SQL = """
SELECT o.o_orderkey, o.o_orderdate AS requested_datetime, n.n_regionkey + 1 AS cluster,
       n.n_nationkey + 1 AS nation_zone
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""
