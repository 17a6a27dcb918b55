"""Registered geospatial queries.

Stand-ins (all derived from the given tables, so the work grows with them):
* tracts: one polygon per nation on a 5 x 5 grid over the service area; region-0
  nations are L-shaped, region-1 nations have a hole; region-4 nations sit in
  another county (so the county prefix filter drops them);
* tract attributes: per-nation customer aggregates, with negative sentinels on a
  rule of the nation key;
* points: customers at their stand-in coordinates (about half fall outside);
* raster: one pixel per part on a 64-column grid north-down from the area's top,
  value from the part's price and size, nodata where the size is 1;
* stations: suppliers that shipped at least one line item.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions import labels as L
from civicflow.operators import geo as G
from civicflow.operators import profile
from civicflow.plans.standins import key_to_lat, key_to_lon, sql_lat, sql_lon
from civicflow.sources.tables import read_table

# Stand-in geometry.
GRID_X0, GRID_Y0, TRACT_SIDE, GRID_COLS = -122.65, 37.85, 0.05, 5
COUNTY_PREFIX = "06041"
CELL = 0.05
RASTER_COLS = 64
RASTER = {"x0": -122.65, "y0": 38.10, "dx": 0.25 / 64, "dy": 0.25 / 64}
NODATA = -9999.0
PIXEL_DY_M = RASTER["dy"] * 111000.0
PIXEL_DX_M = RASTER["dx"] * 111000.0 * math.cos(math.radians(37.975))
BUFFER_M = 500.0
STATION_CELL = 0.02


def _v(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def tracts(spark, sf_dir) -> DataFrame:
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    x0 = F.lit(GRID_X0) + (F.col("n_nationkey") % GRID_COLS) * TRACT_SIDE
    y0 = F.lit(GRID_Y0) + F.floor(F.col("n_nationkey") / GRID_COLS) * TRACT_SIDE
    s, h = TRACT_SIDE, TRACT_SIDE / 2
    x1, y1, xm, ym = x0 + s, y0 + s, x0 + h, y0 + h
    square = F.array(_v(x0, y0), _v(x1, y0), _v(x1, y1), _v(x0, y1), _v(x0, y0))
    ell = F.array(_v(x0, y0), _v(x1, y0), _v(x1, ym), _v(xm, ym), _v(xm, y1), _v(x0, y1), _v(x0, y0))
    a, b = x0 + s * 0.3, x0 + s * 0.7
    c, d = y0 + s * 0.3, y0 + s * 0.7
    hole = F.array(_v(a, c), _v(a, d), _v(b, d), _v(b, c), _v(a, c))
    rings = (
        F.when(F.col("n_regionkey") == 0, F.array(ell))
        .when(F.col("n_regionkey") == 1, F.array(square, hole))
        .otherwise(F.array(square))
    )
    county = F.when(F.col("n_regionkey") == 4, F.lit(13)).otherwise(F.lit(41))
    return n.select(
        "n_nationkey",
        L.geoid(F.lit(6), county, F.col("n_nationkey") * 100 + 1).alias("geoid"),
        rings.alias("rings"),
    )


def county_tracts(spark, sf_dir) -> DataFrame:
    """Only the county's tracts (prefix filter)."""
    return tracts(spark, sf_dir).filter(F.col("geoid").startswith(COUNTY_PREFIX))


def census_rows(spark, sf_dir) -> DataFrame:
    """Tract attributes in the census layout (state, county, tract codes without zero padding)."""
    c = read_table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    agg = c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("c_acctbal").alias("_avg"), F.max("c_acctbal").alias("_max")
    )
    j = agg.join(n, agg.c_nationkey == n.n_nationkey)  # nation: 25 rows
    return j.select(
        F.lit(6).alias("state"),
        F.when(F.col("n_regionkey") == 4, F.lit(13)).otherwise(F.lit(41)).alias("county"),
        (F.col("n_nationkey") * 100 + 1).alias("tract"),
        (F.col("_n") * 37).cast("long").alias("B01003_001E"),
        F.when(F.col("n_nationkey") % 7 == 3, F.lit(-666666666)).otherwise(F.round(F.col("_avg") * 15).cast("long")).alias("B19013_001E"),
        F.when(F.col("n_nationkey") % 11 == 5, F.lit(-999999999)).otherwise(F.round(F.col("_max") * 50).cast("long")).alias("B25077_001E"),
    )


def tract_attributes(spark, sf_dir) -> DataFrame:
    """S14 + S15 + P2 + P4: geoid, population, income / home value (negatives -> null), area, density."""
    cen = census_rows(spark, sf_dir).select(
        L.geoid(F.col("state"), F.col("county"), F.col("tract")).alias("geoid"),
        F.col("B01003_001E").alias("population"),
        L.negative_to_null(F.col("B19013_001E")).alias("median_income"),
        L.negative_to_null(F.col("B25077_001E")).alias("median_home_value"),
    )
    area = county_tracts(spark, sf_dir).select("geoid", G.polygon_area_km2(F.col("rings")).alias("land_area_sqkm"))
    j = area.join(cen, "geoid", "left")
    return j.withColumn("pop_density_per_sqkm", F.round(F.col("population") / F.col("land_area_sqkm"), 1))


def points(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        "c_custkey",
        key_to_lat(F.col("c_custkey")).alias("lat"),
        key_to_lon(F.col("c_custkey")).alias("long"),
        (F.col("n_regionkey") + 1).alias("cluster"),
    )


def located(spark, sf_dir) -> DataFrame:
    return G.point_in_polygon(points(spark, sf_dir), county_tracts(spark, sf_dir), "long", "lat", "c_custkey", CELL)


def pixels(spark, sf_dir) -> DataFrame:
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    raw = p.select(
        F.floor(F.col("p_partkey") / RASTER_COLS).cast("int").alias("row"),
        (F.col("p_partkey") % RASTER_COLS).cast("int").alias("col"),
        F.when(F.col("p_size") == 1, F.lit(NODATA)).otherwise(F.col("p_retailprice") - 900.0 + F.col("p_size")).alias("value"),
    )
    return G.valid_pixels(raw, NODATA)


def q_point_in_polygon(spark, sf_dir):
    return located(spark, sf_dir).select("c_custkey", "geoid")


def q_polygon_area(spark, sf_dir):
    return tract_attributes(spark, sf_dir).select("geoid", "land_area_sqkm", "population", "pop_density_per_sqkm")


def enriched(spark, sf_dir) -> DataFrame:
    """J10 + J11 + S13: points with tract attributes, elevation and terrain class."""
    loc = located(spark, sf_dir).join(tract_attributes(spark, sf_dir).drop("land_area_sqkm"), "geoid", "left")
    elev = G.sample_raster(loc, pixels(spark, sf_dir), RASTER, "c_custkey")
    return elev.withColumn("terrain_class", L.elevation_band(F.col("elevation_m")))


def q_tract_join(spark, sf_dir):
    e = located(spark, sf_dir).join(tract_attributes(spark, sf_dir).drop("land_area_sqkm"), "geoid", "left")
    return e.select("c_custkey", "geoid", "population", "median_income", "median_home_value", "pop_density_per_sqkm")


def q_raster_sample(spark, sf_dir):
    e = G.sample_raster(points(spark, sf_dir), pixels(spark, sf_dir), RASTER, "c_custkey")
    return e.select("c_custkey", "elevation_m", L.elevation_band(F.col("elevation_m")).alias("terrain_class"))


def q_tract_weighted_means(spark, sf_dir):
    """G8 + L6: per zone, distinct tracts -> total population, mean density and
    population-weighted income / home value (pairs with a null skipped); per-1k rate."""
    e = located(spark, sf_dir).join(tract_attributes(spark, sf_dir).drop("land_area_sqkm"), "geoid", "left")
    n = e.groupBy("cluster").agg(F.count(F.lit(1)).cast("long").alias("n_incidents"))
    ut = e.filter(F.col("geoid").isNotNull()).dropDuplicates(["cluster", "geoid"])
    pop = F.col("population").cast("double")

    def wavg(c):
        ok = F.col(c).isNotNull() & F.col("population").isNotNull()
        return F.sum(F.when(ok, F.col(c) * pop)) / F.sum(F.when(ok, pop))

    t = ut.groupBy("cluster").agg(
        F.sum("population").cast("long").alias("total_population"),
        # Densities carry one decimal: average them as whole tenths so the sum is exact
        # and the result does not depend on summation order.
        F.round(F.sum(F.round(F.col("pop_density_per_sqkm") * 10.0)) / F.count("pop_density_per_sqkm") / 10.0, 1)
        .alias("mean_pop_density_sqkm"),
        F.round(wavg("median_income"), 0).alias("wtd_median_income"),
        F.round(wavg("median_home_value"), 0).alias("wtd_median_home_value"),
    )
    out = n.join(t, "cluster", "left")
    return out.withColumn(
        "incidents_per_1k_res",
        F.when(F.col("total_population") > 0, F.round(F.col("n_incidents") / F.col("total_population") * 1000.0, 2)),
    )


def q_zone_terrain_summary(spark, sf_dir):
    """Per zone elevation mean / sample std / min / max, dominant terrain, centroid."""
    e = G.sample_raster(points(spark, sf_dir), pixels(spark, sf_dir), RASTER, "c_custkey")
    e = e.withColumn("terrain_class", L.elevation_band(F.col("elevation_m")))
    s = e.groupBy("cluster").agg(
        F.count(F.lit(1)).cast("long").alias("n_incidents"),
        F.round(F.sum(F.round(F.col("elevation_m") * 10.0)) / F.count("elevation_m") / 10.0, 1).alias("elevation_mean_m"),
        F.round(F.stddev_samp("elevation_m"), 1).alias("elevation_std_m"),
        F.round(F.min("elevation_m"), 1).alias("elevation_min_m"),
        F.round(F.max("elevation_m"), 1).alias("elevation_max_m"),
        F.round(F.avg("lat"), 6).alias("lat_centroid"),
        F.round(F.avg("long"), 6).alias("lon_centroid"),
    )
    dom = profile.top_by_count(e, "cluster", "terrain_class", "dominant_terrain")
    return s.join(dom, "cluster", "left")


def q_zonal_stats(spark, sf_dir):
    return G.zonal_stats(points(spark, sf_dir), pixels(spark, sf_dir), RASTER, "c_custkey", BUFFER_M)


def q_terrain_slope(spark, sf_dir):
    return G.slope(pixels(spark, sf_dir), PIXEL_DX_M, PIXEL_DY_M)


def q_raster_info(spark, sf_dir):
    return G.raster_info(pixels(spark, sf_dir), RASTER)


def stations(spark, sf_dir) -> DataFrame:
    """Candidate stations that actually have data (shipped at least one line)."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey")
    active = read_table(spark, sf_dir, "lineitem", "l_suppkey").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    s = s.join(active, "s_suppkey", "left_semi")
    k = F.col("s_suppkey") * 31 + 17
    return s.select("s_suppkey", key_to_lat(k).alias("lat"), key_to_lon(k).alias("long"))


def q_nearest_station(spark, sf_dir):
    return G.nearest(points(spark, sf_dir), stations(spark, sf_dir), "c_custkey", "s_suppkey", STATION_CELL)


QUERIES = {
    "point_in_polygon": q_point_in_polygon,
    "polygon_area": q_polygon_area,
    "tract_join": q_tract_join,
    "raster_sample": q_raster_sample,
    "tract_weighted_means": q_tract_weighted_means,
    "zone_terrain_summary": q_zone_terrain_summary,
    "zonal_stats": q_zonal_stats,
    "terrain_slope": q_terrain_slope,
    "raster_info": q_raster_info,
    "nearest_station": q_nearest_station,
}


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB): the same geometry, brute-force point/polygon pairs.
# ---------------------------------------------------------------------------

def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _vs(x: str, y: str) -> str:
    return f"{{'x': {x}, 'y': {y}}}"


def _tracts_sql() -> str:
    s, h = TRACT_SIDE, TRACT_SIDE / 2
    x0 = f"({_d(GRID_X0)} + CAST(n_nationkey % {GRID_COLS} AS DOUBLE) * {_d(TRACT_SIDE)})"
    y0 = f"({_d(GRID_Y0)} + floor(n_nationkey / {GRID_COLS}) * {_d(TRACT_SIDE)})"
    x1, y1 = f"({x0} + {_d(s)})", f"({y0} + {_d(s)})"
    xm, ym = f"({x0} + {_d(h)})", f"({y0} + {_d(h)})"
    a, b = f"({x0} + {_d(s * 0.3)})", f"({x0} + {_d(s * 0.7)})"
    c, d = f"({y0} + {_d(s * 0.3)})", f"({y0} + {_d(s * 0.7)})"
    square = f"[{_vs(x0, y0)}, {_vs(x1, y0)}, {_vs(x1, y1)}, {_vs(x0, y1)}, {_vs(x0, y0)}]"
    ell = f"[{_vs(x0, y0)}, {_vs(x1, y0)}, {_vs(x1, ym)}, {_vs(xm, ym)}, {_vs(xm, y1)}, {_vs(x0, y1)}, {_vs(x0, y0)}]"
    hole = f"[{_vs(a, c)}, {_vs(a, d)}, {_vs(b, d)}, {_vs(b, c)}, {_vs(a, c)}]"
    return f"""
SELECT n_nationkey,
       lpad('6', 2, '0') || lpad(CASE WHEN n_regionkey = 4 THEN '13' ELSE '41' END, 3, '0')
         || lpad(CAST(n_nationkey * 100 + 1 AS VARCHAR), 6, '0') AS geoid,
       CASE WHEN n_regionkey = 0 THEN [{ell}] WHEN n_regionkey = 1 THEN [{square}, {hole}] ELSE [{square}] END AS rings
FROM nation"""


_TRACTS = f"(SELECT * FROM ({_tracts_sql()}) t WHERE starts_with(geoid, '{COUNTY_PREFIX}'))"
_CONTAINS = (
    "list_sum(list_transform(rings, lambda r: len(list_filter(range(1, len(r)), lambda i: "
    "((r[i].y > lat) != (r[i + 1].y > lat)) AND "
    "(long < (r[i + 1].x - r[i].x) * (lat - r[i].y) / (r[i + 1].y - r[i].y) + r[i].x))))) % 2 = 1"
)
_POINTS = f"""(SELECT c_custkey, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS long, n_regionkey + 1 AS cluster
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_LOCATED = f"""(SELECT p.*, t.geoid FROM {_POINTS} p LEFT JOIN {_TRACTS} t ON {_CONTAINS})"""


def _albers_sql(lon: str, lat: str) -> tuple[str, str]:
    e2, e = G._E2, G._E
    s = f"sin(radians({lat}))"
    q = f"({_d(1 - e2)} * ({s} / ({_d(1.0)} - {_d(e2)} * {s} * {s}) - ln(({_d(1.0)} - {_d(e)} * {s}) / ({_d(1.0)} + {_d(e)} * {s})) / {_d(2 * e)}))"
    rho = f"({_d(G._A)} * sqrt({_d(G.ALBERS_C)} - {_d(G.ALBERS_N)} * {q}) / {_d(G.ALBERS_N)})"
    theta = f"({_d(G.ALBERS_N)} * radians({lon} - {_d(G._LON0)}))"
    return f"({rho} * sin({theta}))", f"({_d(G.ALBERS_RHO0)} - {rho} * cos({theta}) + {_d(G._FN)})"


def _ring_area_sql(ring: str) -> str:
    px, py = _albers_sql("p.x", "p.y")
    proj = f"list_transform({ring}, lambda p: {{'x': {px}, 'y': {py}}})"
    return (f"abs(list_reduce(list_transform(range(1, len({proj})), lambda i: {proj}[i].x * {proj}[i + 1].y "
            f"- {proj}[i + 1].x * {proj}[i].y), lambda a, b: a + b, {_d(0.0)})) / {_d(2.0)}")


_AREA = f"""(SELECT geoid, round(({_ring_area_sql('rings[1]')}
   - coalesce(list_reduce(list_transform(rings[2:], lambda rr: {_ring_area_sql('rr')}), lambda a, b: a + b, {_d(0.0)}), 0.0)) / 1e6, 4) AS land_area_sqkm
FROM {_TRACTS} t)"""

_CENSUS = """(SELECT lpad('6', 2, '0') || lpad(CASE WHEN n_regionkey = 4 THEN '13' ELSE '41' END, 3, '0')
         || lpad(CAST(n_nationkey * 100 + 1 AS VARCHAR), 6, '0') AS geoid,
       CAST(cnt * 37 AS BIGINT) AS population,
       CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE CAST(round(av * 15) AS BIGINT) END AS median_income,
       CASE WHEN n_nationkey % 11 = 5 THEN NULL ELSE CAST(round(mx * 50) AS BIGINT) END AS median_home_value
FROM (SELECT c_nationkey, count(*) AS cnt, avg(c_acctbal) AS av, max(c_acctbal) AS mx FROM customer GROUP BY 1) a
JOIN nation ON c_nationkey = n_nationkey)"""
_ATTR = f"""(SELECT a.geoid, a.land_area_sqkm, c.population, c.median_income, c.median_home_value,
       round(c.population / a.land_area_sqkm, 1) AS pop_density_per_sqkm
FROM {_AREA} a LEFT JOIN {_CENSUS} c USING (geoid))"""
_JOINED = f"""(SELECT l.*, t.population, t.median_income, t.median_home_value, t.pop_density_per_sqkm
FROM {_LOCATED} l LEFT JOIN {_ATTR} t USING (geoid))"""

_PIX = f"""(SELECT CAST(floor(p_partkey / {RASTER_COLS}) AS INTEGER) AS row, CAST(p_partkey % {RASTER_COLS} AS INTEGER) AS col,
       CASE WHEN v < -10.0 OR v > 1000.0 OR isnan(v) OR v = {_d(NODATA)} THEN NULL ELSE v END AS value
FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN {_d(NODATA)} ELSE p_retailprice - 900.0 + p_size END AS v FROM part) r)"""
_ROW = f"CAST(floor(({_d(RASTER['y0'])} - lat) / {_d(RASTER['dy'])}) AS INTEGER)"
_COL = f"CAST(floor((long - {_d(RASTER['x0'])}) / {_d(RASTER['dx'])}) AS INTEGER)"
_SAMPLE = f"""(
WITH info AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM {_PIX} p),
pt AS (SELECT q.*, {_ROW} AS prow, {_COL} AS pcol FROM {_POINTS} q),
ctr AS (SELECT pt.*, (prow >= 0 AND prow < h AND pcol >= 0 AND pcol < w) AS inside, px.value AS v
        FROM pt CROSS JOIN info LEFT JOIN {_PIX} px ON px.row = pt.prow AND px.col = pt.pcol),
nb AS (SELECT c.c_custkey, avg(px.value) AS nbv FROM ctr c, range(-1, 2) a(dr), range(-1, 2) b(dc), {_PIX} px
       WHERE c.inside AND c.v IS NULL AND px.row = c.prow + dr AND px.col = c.pcol + dc GROUP BY c.c_custkey)
SELECT ctr.c_custkey, ctr.lat, ctr.long, ctr.cluster,
       round(CASE WHEN inside THEN coalesce(v, nbv) END, 1) AS elevation_m
FROM ctr LEFT JOIN nb USING (c_custkey))"""
_BAND = ("CASE WHEN elevation_m IS NULL THEN NULL WHEN elevation_m < 15.0 THEN 'Lowland' WHEN elevation_m < 60.0 "
         "THEN 'Valley' WHEN elevation_m < 150.0 THEN 'Hillside' ELSE 'Ridge' END")

_STATIONS = f"""(SELECT s_suppkey, {sql_lat('(s_suppkey * 31 + 17)')} AS lat, {sql_lon('(s_suppkey * 31 + 17)')} AS long
FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))"""
_HAV = (f"{_d(2 * G.EARTH_KM)} * asin(sqrt(pow(sin((radians(s.lat) - radians(p.lat)) / 2), 2) + "
        f"cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.long - p.long) / 2), 2)))")

_DLAT = f"({_d(BUFFER_M)} / {_d(111000.0)})"
_DLON = f"({_d(BUFFER_M)} / ({_d(111000.0)} * cos(radians(lat))))"

ORACLE = {
    "point_in_polygon": f"SELECT c_custkey, geoid FROM {_LOCATED} l",
    "polygon_area": f"SELECT geoid, land_area_sqkm, population, pop_density_per_sqkm FROM {_ATTR} a",
    "tract_join": f"""SELECT c_custkey, geoid, population, median_income, median_home_value, pop_density_per_sqkm
FROM {_JOINED} j""",
    "raster_sample": f"SELECT c_custkey, elevation_m, {_BAND} AS terrain_class FROM {_SAMPLE} s",
    "tract_weighted_means": f"""
WITH e AS (SELECT * FROM {_JOINED} j),
n AS (SELECT cluster, CAST(count(*) AS BIGINT) AS n_incidents FROM e GROUP BY cluster),
ut AS (SELECT DISTINCT ON (cluster, geoid) * FROM e WHERE geoid IS NOT NULL ORDER BY cluster, geoid),
t AS (SELECT cluster, CAST(sum(population) AS BIGINT) AS total_population,
             round(sum(round(pop_density_per_sqkm * 10.0)) / count(pop_density_per_sqkm) / 10.0, 1) AS mean_pop_density_sqkm,
             round(sum(CASE WHEN median_income IS NOT NULL AND population IS NOT NULL THEN median_income * CAST(population AS DOUBLE) END)
                   / sum(CASE WHEN median_income IS NOT NULL AND population IS NOT NULL THEN CAST(population AS DOUBLE) END), 0) AS wtd_median_income,
             round(sum(CASE WHEN median_home_value IS NOT NULL AND population IS NOT NULL THEN median_home_value * CAST(population AS DOUBLE) END)
                   / sum(CASE WHEN median_home_value IS NOT NULL AND population IS NOT NULL THEN CAST(population AS DOUBLE) END), 0) AS wtd_median_home_value
      FROM ut GROUP BY cluster)
SELECT n.cluster, n_incidents, total_population, mean_pop_density_sqkm, wtd_median_income, wtd_median_home_value,
       CASE WHEN total_population > 0 THEN round(n_incidents / total_population * 1000.0, 2) END AS incidents_per_1k_res
FROM n LEFT JOIN t USING (cluster)""",
    "zone_terrain_summary": f"""
WITH e AS (SELECT *, {_BAND} AS terrain_class FROM {_SAMPLE} s),
dom AS (SELECT cluster, terrain_class AS dominant_terrain FROM (
          SELECT cluster, terrain_class, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, terrain_class) AS rn
          FROM e WHERE terrain_class IS NOT NULL GROUP BY cluster, terrain_class) d WHERE rn = 1)
SELECT cluster, CAST(count(*) AS BIGINT) AS n_incidents,
       round(sum(round(elevation_m * 10.0)) / count(elevation_m) / 10.0, 1) AS elevation_mean_m,
       round(stddev_samp(elevation_m), 1) AS elevation_std_m, round(min(elevation_m), 1) AS elevation_min_m,
       round(max(elevation_m), 1) AS elevation_max_m, round(avg(lat), 6) AS lat_centroid, round(avg(long), 6) AS lon_centroid,
       any_value(dominant_terrain) AS dominant_terrain
FROM e LEFT JOIN dom USING (cluster) GROUP BY cluster""",
    "zonal_stats": f"""
WITH w AS (SELECT c_custkey,
             CAST(floor(({_d(RASTER['y0'])} - (lat + {_DLAT})) / {_d(RASTER['dy'])}) AS INTEGER) AS r0,
             CAST(floor(({_d(RASTER['y0'])} - (lat - {_DLAT})) / {_d(RASTER['dy'])}) AS INTEGER) AS r1,
             CAST(floor(((long - {_DLON}) - {_d(RASTER['x0'])}) / {_d(RASTER['dx'])}) AS INTEGER) AS c0,
             CAST(floor(((long + {_DLON}) - {_d(RASTER['x0'])}) / {_d(RASTER['dx'])}) AS INTEGER) AS c1
           FROM {_POINTS} p),
v AS (SELECT w.c_custkey, px.value FROM w JOIN {_PIX} px ON px.row BETWEEN w.r0 AND w.r1 AND px.col BETWEEN w.c0 AND w.c1
      WHERE px.value IS NOT NULL),
s AS (SELECT c_custkey, CAST(count(*) AS BIGINT) AS n_pixels, round(avg(value), 4) AS elev_mean,
             round(median(value), 4) AS elev_median, min(value) AS elev_min, max(value) AS elev_max,
             round(stddev_pop(value), 4) AS elev_std FROM v GROUP BY c_custkey)
SELECT p.c_custkey, n_pixels, elev_mean, elev_median, elev_min, elev_max, elev_std FROM {_POINTS} p LEFT JOIN s USING (c_custkey)""",
    "terrain_slope": f"""
SELECT row, col, round(degrees(atan(sqrt(pow(gx, 2) + pow(gy, 2)))), 4) AS slope_deg FROM (
  SELECT row, col,
    CASE WHEN lc IS NOT NULL AND rc IS NOT NULL THEN (rv - lv) / (2.0 * {_d(PIXEL_DX_M)})
         WHEN rc IS NOT NULL THEN (rv - value) / {_d(PIXEL_DX_M)} WHEN lc IS NOT NULL THEN (value - lv) / {_d(PIXEL_DX_M)}
         ELSE 0.0 END AS gx,
    CASE WHEN ur IS NOT NULL AND dr IS NOT NULL THEN (dv - uv) / (2.0 * {_d(PIXEL_DY_M)})
         WHEN dr IS NOT NULL THEN (dv - value) / {_d(PIXEL_DY_M)} WHEN ur IS NOT NULL THEN (value - uv) / {_d(PIXEL_DY_M)}
         ELSE 0.0 END AS gy
  FROM (SELECT *, lag(value) OVER wx AS lv, lead(value) OVER wx AS rv, lag(col) OVER wx AS lc, lead(col) OVER wx AS rc,
               lag(value) OVER wy AS uv, lead(value) OVER wy AS dv, lag(row) OVER wy AS ur, lead(row) OVER wy AS dr
        FROM {_PIX} p WINDOW wx AS (PARTITION BY row ORDER BY col), wy AS (PARTITION BY col ORDER BY row)) t) g""",
    "raster_info": f"""
SELECT w AS width, h AS height, {_d(RASTER['x0'])} AS min_x, {_d(RASTER['y0'])} - h * {_d(RASTER['dy'])} AS min_y,
       {_d(RASTER['x0'])} + w * {_d(RASTER['dx'])} AS max_x, {_d(RASTER['y0'])} AS max_y,
       {_d(RASTER['dx'])} AS res_x, {_d(RASTER['dy'])} AS res_y
FROM (SELECT max(col) + 1 AS w, max(row) + 1 AS h FROM {_PIX} p) i""",
    "nearest_station": f"""
SELECT c_custkey, station, distance_km FROM (
  SELECT p.c_custkey, s.s_suppkey AS station, round({_HAV}, 4) AS distance_km,
         row_number() OVER (PARTITION BY p.c_custkey ORDER BY {_HAV}, s.s_suppkey) AS rn
  FROM {_POINTS} p CROSS JOIN {_STATIONS} s) t WHERE rn = 1""",
}
