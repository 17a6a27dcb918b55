"""Geospatial operators as ordinary Spark joins.

* Point in polygon (J9): polygons are exploded onto grid cells; points fall in exactly
  one cell; the equi-join on cells finds candidates. Cells inside a polygon decide at
  once, on border cells an even-odd ray-casting test over all rings (holes included)
  does. Half-open edges put a point on a shared edge into exactly one polygon.
  Only cells with very many points, found by a count, are split over several tasks.
* Raster sample (J11): pixel (row, col) from the affine transform, joined to the
  pixel table; points whose centre pixel is invalid take the mean of the valid 3x3
  neighbours in a second, smaller join.
* Zonal statistics (J12): the raster is cut into tiles as high as the window, so a
  point meets a few tiles whatever the buffer; the window is cut out of their arrays.
* Nearest station (J13): stations and points share a grid, as fine as the stations are
  dense; a 3 x 3 block of cells settles the points near a station, the others descend a
  pyramid of cells with distance bounds, so the result is exact without an all-pairs join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions import labels as L

SALT = 8  # ways that a hot cell is split into, at most
HOT_ROWS = 1_000_000  # points of one cell or pixel from which it is split
CELL_STATIONS, HOT_STATIONS = 3, 32  # places of stations in a cell: on average, and from which it is crowded
MAX_HALVINGS = 24  # of the cell that nearest stations are looked up by
EARTH_KM = 6371.0088


# ---------------------------------------------------------------------------
# Polygons
# ---------------------------------------------------------------------------

def _ring_crossings(ring: Column, px: Column, py: Column) -> Column:
    def crosses(i):
        a, b = ring[i], ring[i + 1]
        straddles = (a["y"] > py) != (b["y"] > py)
        x_at = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return straddles & (px < x_at)

    return F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 2), crosses))


def contains(rings: Column, px: Column, py: Column) -> Column:
    """Even-odd rule over all rings of a polygon (outer ring first, holes after)."""
    total = F.aggregate(rings, F.lit(0), lambda acc, r: acc + _ring_crossings(r, px, py))
    return total % 2 == 1


def _bbox(rings: Column) -> dict[str, Column]:
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return {"minx": F.array_min(xs), "maxx": F.array_max(xs), "miny": F.array_min(ys), "maxy": F.array_max(ys)}


def polygon_cells(polys: DataFrame, cell: float) -> DataFrame:
    """(..., rings, cx, cy, interior) for every grid cell that a polygon may hold points of.

    A cell that no edge's bounding box touches lies on one side of the polygon: inside it is
    marked ``interior`` (its points need no ray test), outside it is left out."""
    b = _bbox(F.col("rings"))
    out = polys.select(
        "*",
        F.explode(F.sequence(F.floor(b["minx"] / cell), F.floor(b["maxx"] / cell))).alias("cx"),
    ).select(
        "*",
        F.explode(F.sequence(F.floor(b["miny"] / cell), F.floor(b["maxy"] / cell))).alias("cy"),
    )
    x0, y0 = F.col("cx") * F.lit(cell), F.col("cy") * F.lit(cell)
    slack = cell * 1e-9  # a border on the grid line belongs to the cells on both sides

    def touches(ring):
        def edge(i):
            a, b = ring[i], ring[i + 1]
            return ((F.least(a["x"], b["x"]) <= x0 + cell + slack) & (F.greatest(a["x"], b["x"]) >= x0 - slack)
                    & (F.least(a["y"], b["y"]) <= y0 + cell + slack) & (F.greatest(a["y"], b["y"]) >= y0 - slack))

        return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), edge)

    border = F.exists("rings", touches)
    out = out.withColumn("interior", ~border).withColumn("_inside", contains(F.col("rings"), x0 + cell / 2, y0 + cell / 2))
    return out.where("NOT interior OR _inside").drop("_inside")


def split_hot(points: DataFrame, small: DataFrame, keys: list[str], row_key: str, hot_rows: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a further key ``_way``: 0, but for key values with more than
    ``hot_rows`` points, whose points are dealt over several ways and whose rows of the small side
    are repeated for each. The values come from a count; at most (points / hot_rows) there are."""
    hot = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(
        *keys, F.least(F.ceil(F.col("_n") / hot_rows), F.lit(most)).cast("int").alias("_ways")).checkpoint()
    if hot.isEmpty():
        return points.withColumn("_way", F.lit(0)), small.withColumn("_way", F.lit(0))
    ways = F.coalesce("_ways", F.lit(1))
    dealt = points.join(F.broadcast(hot), keys, "left").withColumn("_way", F.pmod(F.xxhash64(F.col(row_key)), ways).cast("int"))
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn("_way", F.explode(F.sequence(F.lit(0), ways - 1)))
    return dealt.drop("_ways"), repeated.drop("_ways")


def point_in_polygon(
    points: DataFrame, polys: DataFrame, x: str, y: str, key: str, cell: float, salt: int = SALT,
    keep: tuple[str, ...] = ("geoid",), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left spatial join; points outside every polygon get nulls.
    Polygons are assumed not to overlap (tracts partition the plane). A cell with more than
    ``hot_rows`` points is split, at most ``salt`` times; all others meet each polygon cell once."""
    pts = points.select("*", F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    pts, cells = split_hot(pts, polygon_cells(polys.select(*keep, "rings"), cell), ["cx", "cy"], key, hot_rows, salt)
    cond = (
        (pts.cx == cells.cx) & (pts.cy == cells.cy) & (pts._way == cells._way)
        & (cells.interior | contains(cells.rings, pts[x], pts[y]))
    )
    j = pts.join(cells, cond, "left")
    return j.select(*[pts[c] for c in points.columns], *[cells[c] for c in keep])


# EPSG:3310 (California Albers) on the GRS80 ellipsoid.
_A = 6378137.0
_F = 1 / 298.257222101
_LAT1, _LAT2, _LAT0, _LON0, _FN = 34.0, 40.5, 0.0, -120.0, -4000000.0
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi: float) -> float:
    s = math.sin(phi)
    return math.cos(phi) / math.sqrt(1 - _E2 * s * s)


_P1, _P2 = math.radians(_LAT1), math.radians(_LAT2)
ALBERS_N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(_P2) - _q(_P1))
ALBERS_C = _m(_P1) ** 2 + ALBERS_N * _q(_P1)
ALBERS_RHO0 = _A * math.sqrt(ALBERS_C - ALBERS_N * _q(math.radians(_LAT0))) / ALBERS_N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Ellipsoidal Albers equal-area (Snyder's formulas) as column maths."""
    s = F.sin(F.radians(lat))
    q = F.lit(1 - _E2) * (
        s / (F.lit(1.0) - F.lit(_E2) * s * s) - F.log((F.lit(1.0) - F.lit(_E) * s) / (F.lit(1.0) + F.lit(_E) * s)) / F.lit(2 * _E)
    )
    rho = F.lit(_A) * F.sqrt(F.lit(ALBERS_C) - F.lit(ALBERS_N) * q) / F.lit(ALBERS_N)
    theta = F.lit(ALBERS_N) * F.radians(lon - F.lit(_LON0))
    return rho * F.sin(theta), F.lit(ALBERS_RHO0) - rho * F.cos(theta) + F.lit(_FN)


def _ring_area(ring: Column) -> Column:
    proj = F.transform(ring, lambda p: F.struct(albers(p["x"], p["y"])[0].alias("x"), albers(p["x"], p["y"])[1].alias("y")))
    n = F.size(proj)
    cross = F.aggregate(
        F.sequence(F.lit(0), n - 2),
        F.lit(0.0),
        lambda acc, i: acc + proj[i]["x"] * proj[i + 1]["y"] - proj[i + 1]["x"] * proj[i]["y"],
    )
    return F.abs(cross) / 2.0


def polygon_area_km2(rings: Column) -> Column:
    """Outer ring area minus hole areas, km^2, rounded to 4."""
    outer = _ring_area(rings[0])
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda a, r: a + _ring_area(r))
    return F.round((outer - holes) / 1e6, 4)


# ---------------------------------------------------------------------------
# Rasters: pixel table (row, col, value) + transform (x0, y0, dx, dy), north-up
# ---------------------------------------------------------------------------

def valid_pixels(pixels: DataFrame, nodata: float | None) -> DataFrame:
    """P5 + S16: nodata and out-of-range values become null."""
    return pixels.select("row", "col", L.valid_elevation(F.col("value"), nodata).alias("value"))


def pixel_of(lon: Column, lat: Column, t: dict) -> tuple[Column, Column]:
    return F.floor((F.lit(t["y0"]) - lat) / F.lit(t["dy"])).cast("int"), F.floor((lon - F.lit(t["x0"])) / F.lit(t["dx"])).cast("int")


def raster_info(pixels: DataFrame, t: dict) -> DataFrame:
    """Width, height, bounds and resolution of the raster."""
    size = pixels.agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
    return size.select(
        "width", "height",
        F.lit(t["x0"]).alias("min_x"), (F.lit(t["y0"]) - F.col("height") * t["dy"]).alias("min_y"),
        (F.lit(t["x0"]) + F.col("width") * t["dx"]).alias("max_x"), F.lit(t["y0"]).alias("max_y"),
        F.lit(t["dx"]).alias("res_x"), F.lit(t["dy"]).alias("res_y"),
    )


def sample_raster(points: DataFrame, pixels: DataFrame, t: dict, key: str, lon: str = "long", lat: str = "lat",
                  salt: int = SALT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Value of the pixel under each point (in-bounds only); an invalid centre takes
    the mean of the valid pixels of its 3x3 block. Adds ``elevation_m`` rounded to 1. A pixel with more
    than ``hot_rows`` points is split, at most ``salt`` times."""
    info = pixels.agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    r, c = pixel_of(F.col(lon), F.col(lat), t)
    pts = points.select("*", r.alias("_row"), c.alias("_col")).crossJoin(F.broadcast(info))  # one-row frame
    pts = pts.withColumn(
        "_in", (F.col("_row") >= 0) & (F.col("_row") < F.col("_h")) & (F.col("_col") >= 0) & (F.col("_col") < F.col("_w"))
    )
    px = pixels.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias("_v"))
    pts, px_split = split_hot(pts, px, ["_row", "_col"], key, hot_rows, salt)
    centre = pts.join(px_split, ["_row", "_col", "_way"], "left")
    # An invalid centre's block depends on the pixel alone: one mean a pixel, whatever its points.
    need = centre.filter(F.col("_in") & F.col("_v").isNull()).select("_row", "_col").distinct()
    offs = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]))
    block = need.select(F.col("_row").alias("_r0"), F.col("_col").alias("_c0"), offs.alias("o")).select(
        "_r0", "_c0", (F.col("_r0") + F.col("o.dr")).alias("_row"), (F.col("_c0") + F.col("o.dc")).alias("_col")
    )
    means = block.join(px, ["_row", "_col"]).groupBy(F.col("_r0").alias("_row"), F.col("_c0").alias("_col")).agg(F.avg("_v").alias("_nb"))
    out = centre.join(means, ["_row", "_col"], "left")
    value = F.when(F.col("_in"), F.coalesce(F.col("_v"), F.col("_nb")))
    return out.select(*points.columns, F.round(value, 1).alias("elevation_m"))


def tiles(pixels: DataFrame, side: int) -> DataFrame:
    """(ty, tx, px): the valid pixels of each square of ``side`` x ``side``, one row a square."""
    return pixels.filter(F.col("value").isNotNull()).groupBy(
        F.floor(F.col("row") / side).alias("_ty"), F.floor(F.col("col") / side).alias("_tx")).agg(
        F.collect_list(F.struct("row", "col", "value")).alias("_px"))


def zonal_stats(points: DataFrame, pixels: DataFrame, t: dict, key: str, buffer_m: float,
                lon: str = "long", lat: str = "lat") -> DataFrame:
    """Statistics of the valid pixels inside +- buffer around each point.

    The raster is cut into tiles as long as the window is high, so a window meets two rows of tiles and,
    at most, as many columns as it is wider than high (its width grows with 1 / cos(latitude)); a
    point is joined with these tiles, not with its pixels, and the window is cut out of each tile's
    array. The rows of the join do not grow with the buffer."""
    side = max(1, math.ceil(2.0 * buffer_m / 111000.0 / t["dy"]))
    dlat = F.lit(buffer_m / 111000.0)
    dlon = F.lit(buffer_m) / (F.lit(111000.0) * F.cos(F.radians(F.col(lat))))
    r_lo, c_lo = pixel_of(F.col(lon) - dlon, F.col(lat) + dlat, t)
    r_hi, c_hi = pixel_of(F.col(lon) + dlon, F.col(lat) - dlat, t)
    win = points.select(key, r_lo.alias("_r0"), r_hi.alias("_r1"), c_lo.alias("_c0"), c_hi.alias("_c1"))
    probes = win.select("*", F.explode(F.sequence(F.floor(F.col("_r0") / side), F.floor(F.col("_r1") / side))).alias("_ty")).select(
        "*", F.explode(F.sequence(F.floor(F.col("_c0") / side), F.floor(F.col("_c1") / side))).alias("_tx"))
    inside = F.filter("_px", lambda p: p["row"].between(F.col("_r0"), F.col("_r1")) & p["col"].between(F.col("_c0"), F.col("_c1")))
    cut = probes.join(tiles(pixels, side), ["_ty", "_tx"]).select(key, inside["value"].alias("_v")).where(F.size("_v") > 0)
    windows = cut.groupBy(key).agg(F.flatten(F.collect_list("_v")).alias("_v"))  # one window's pixels
    v, n = F.array_sort("_v"), F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x) / n
    variance = F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    middle = (F.element_at("_v", F.floor((n + 1) / 2).cast("int")) + F.element_at("_v", F.floor(n / 2).cast("int") + 1)) / 2.0
    stats = windows.select(key, v.alias("_v")).withColumn("_mean", mean).select(
        key, n.cast("long").alias("n_pixels"), F.round("_mean", 4).alias("elev_mean"), F.round(middle, 4).alias("elev_median"),
        F.element_at("_v", 1).alias("elev_min"), F.element_at("_v", -1).alias("elev_max"), F.round(F.sqrt(variance), 4).alias("elev_std"))
    return points.select(key).join(stats, key, "left")


def slope(pixels: DataFrame, dx_m: float, dy_m: float) -> DataFrame:
    """Gradient by central differences inside and one-sided differences at the edges,
    slope = degrees(atan(|grad|)); nodata propagates as null."""
    wx = Window.partitionBy("row").orderBy("col")
    wy = Window.partitionBy("col").orderBy("row")
    v = F.col("value")
    left, right = F.lag("value").over(wx), F.lead("value").over(wx)
    up, down = F.lag("value").over(wy), F.lead("value").over(wy)
    has_l, has_r = (F.coalesce(F.lag("col").over(wx) == F.col("col") - 1, F.lit(False)),
                    F.coalesce(F.lead("col").over(wx) == F.col("col") + 1, F.lit(False)))
    has_u, has_d = (F.coalesce(F.lag("row").over(wy) == F.col("row") - 1, F.lit(False)),
                    F.coalesce(F.lead("row").over(wy) == F.col("row") + 1, F.lit(False)))
    gx = (
        F.when(has_l & has_r, (right - left) / (2.0 * dx_m))
        .when(has_r, (right - v) / dx_m)
        .when(has_l, (v - left) / dx_m)
        .otherwise(F.lit(0.0))
    )
    gy = (
        F.when(has_u & has_d, (down - up) / (2.0 * dy_m))
        .when(has_d, (down - v) / dy_m)
        .when(has_u, (v - up) / dy_m)
        .otherwise(F.lit(0.0))
    )
    g = pixels.select("row", "col", "value", gx.alias("_gx")).select("row", "col", "value", "_gx", gy.alias("_gy"))
    return g.select("row", "col", F.round(F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2))), 4).alias("slope_deg"))


# ---------------------------------------------------------------------------
# Nearest station
# ---------------------------------------------------------------------------

def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lon2 - lon1)
    a = F.sin(dp / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def _pyramid(st: DataFrame, level: int) -> DataFrame:
    """Occupied cells of 2^level x 2^level grid cells: the box around their stations and one of them."""
    return st.groupBy(F.shiftright("_sy", level).alias("_cy"), F.shiftright("_sx", level).alias("_cx")).agg(
        F.min("_slat").alias("_la0"), F.max("_slat").alias("_la1"), F.min("_slon").alias("_lo0"), F.max("_slon").alias("_lo1"),
        F.min_by(F.struct("_slat", "_slon"), "_sid").alias("_one"))


def box_distance_km(lat: Column, lon: Column, la0: Column, la1: Column, lo0: Column, lo1: Column) -> Column:
    """A lower bound of the great-circle distance from a point to any place in a box."""
    zero = F.lit(0.0)
    dlat = F.radians(F.greatest(la0 - lat, lat - la1, zero))
    near, far = F.greatest(lo0 - lon, lon - lo1, zero), F.greatest(F.abs(lo0 - lon), F.abs(lo1 - lon))
    dlon = F.radians(F.when(far <= 180.0, near).otherwise(F.greatest(zero, F.least(near, 360.0 - far))))
    shrink = F.cos(F.radians(lat)) * F.least(F.cos(F.radians(la0)), F.cos(F.radians(la1)))
    a = F.sin(dlat / 2) ** 2 + F.greatest(shrink, zero) * F.sin(dlon / 2) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _kept_cells(cand: DataFrame, key: str) -> DataFrame:
    """Candidate cells that may hold the nearest station: no farther at best than some station is."""
    bounded = cand.withColumn("_low", box_distance_km(F.col("_plat"), F.col("_plon"), F.col("_la0"), F.col("_la1"), F.col("_lo0"), F.col("_lo1")))
    bounded = bounded.withColumn("_high", haversine_km(F.col("_plat"), F.col("_plon"), F.col("_one._slat"), F.col("_one._slon")))
    best = F.min("_high").over(Window.partitionBy(key))  # a point's few cells
    return bounded.withColumn("_best", best).where(F.col("_low") <= F.col("_best") + 1e-9).select(key, "_plat", "_plon", "_cy", "_cx")


def _descend(pts: DataFrame, st: DataFrame, key: str, extent) -> DataFrame:
    """(key, _b): the nearest station of far points, from coarse cells to fine ones.

    The top level covers all stations with at most 3 x 3 cells. On each level a point's cells are
    pruned by distance bounds, and only the quarters of those that remain are looked up."""
    top = 0
    while max((extent["_y1"] >> top) - (extent["_y0"] >> top), (extent["_x1"] >> top) - (extent["_x0"] >> top)) > 2:
        top += 1
    probes = pts.select(
        key, "_plat", "_plon",
        F.explode(F.sequence(F.lit(extent["_y0"] >> top), F.lit(extent["_y1"] >> top))).alias("_cy")).select(
        "*", F.explode(F.sequence(F.lit(extent["_x0"] >> top), F.lit(extent["_x1"] >> top))).alias("_cx"))
    quarter = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (0, 1) for x in (0, 1)))
    for level in range(top, -1, -1):
        cells = _kept_cells(probes.join(_pyramid(st, level), ["_cy", "_cx"]), key)
        probes = cells.select(key, "_plat", "_plon", "_cy", "_cx", F.explode(quarter).alias("_q")).select(
            key, "_plat", "_plon", (F.col("_cy") * 2 + F.col("_q.y")).alias("_cy"), (F.col("_cx") * 2 + F.col("_q.x")).alias("_cx"))
    found = cells.join(st, (F.col("_cy") == F.col("_sy")) & (F.col("_cx") == F.col("_sx")))
    return _closest(found, key)


def _closest(cand: DataFrame, key: str) -> DataFrame:
    scored = cand.withColumn("_d", haversine_km(F.col("_plat"), F.col("_plon"), F.col("_slat"), F.col("_slon")))
    return scored.groupBy(key).agg(F.min(F.struct("_d", "_sid")).alias("_b"))


def _station_levels(places: DataFrame, cell: float) -> tuple[int, int]:
    """(k, fine): how often to halve the cell until its occupied cells hold ``CELL_STATIONS`` places on
    average, and until none holds more than ``HOT_STATIONS``. One small aggregate a halving."""
    k, first = 0, None
    while True:
        cells = places.groupBy(F.floor(F.col("_slat") / (cell / 2 ** k)), F.floor(F.col("_slon") / (cell / 2 ** k))).agg(F.count(F.lit(1)).alias("n"))
        row = cells.agg(F.avg("n").alias("mean"), F.max("n").alias("most")).first()
        if first is None and (row["mean"] <= CELL_STATIONS or k == MAX_HALVINGS):
            first = k
        if first is not None and (row["most"] <= HOT_STATIONS or k == MAX_HALVINGS):
            return first, k
        k += 1


def nearest(points: DataFrame, stations: DataFrame, key: str, station_key: str, cell: float) -> DataFrame:
    """Exact nearest station per point (ties -> smaller station key).

    Stations at one place are one, the smallest key. ``cell`` is halved until its cells hold a few
    places, so the candidates of a point do not grow with the stations. First the 3 x 3 block of cells
    around the point's cell: a station outside it is more than a cell away in latitude or longitude, so
    a best distance below that bound is final; so is any result if the block covers every station. Points beside a
    crowded cell, and those far from any station, go from coarse cells to fine ones (``_descend``), as fine
    as the crowded cells need. The stations and the first pass are checkpointed, as several steps read them."""
    places = stations.where("lat IS NOT NULL AND long IS NOT NULL").groupBy(F.col("lat").alias("_slat"), F.col("long").alias("_slon")).agg(
        F.min(F.struct(station_key))[station_key].alias("_sid")).checkpoint()
    if places.isEmpty():  # no station at all
        return points.select(key, F.lit(None).cast(stations.schema[station_key].dataType).alias("station"), F.lit(None).cast("double").alias("distance_km"))
    level, fine = _station_levels(places, cell)
    tiny, up = cell / 2 ** fine, fine - level
    cell = cell / 2 ** level
    st = places.select("_sid", "_slat", "_slon", F.floor(F.col("_slat") / tiny).alias("_sy"), F.floor(F.col("_slon") / tiny).alias("_sx")).checkpoint()  # read on every level
    extent = st.agg(F.min("_sy").alias("_y0"), F.max("_sy").alias("_y1"), F.min("_sx").alias("_x0"), F.max("_sx").alias("_x1")).first()
    pts = points.select(key, F.col("lat").alias("_plat"), F.col("long").alias("_plon"),
                        F.floor(F.col("lat") / cell).alias("_py"), F.floor(F.col("long") / cell).alias("_px"))
    near = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)))).alias("_o")
    probe = pts.select(key, "_plat", "_plon", "_py", "_px", near)
    probe = probe.select(key, "_plat", "_plon", (F.col("_py") + F.col("_o.y")).alias("_sy"), (F.col("_px") + F.col("_o.x")).alias("_sx"))
    local = st.withColumns({"_sy": F.shiftright("_sy", up), "_sx": F.shiftright("_sx", up)})
    crowded = None
    if up:
        hot = local.groupBy("_sy", "_sx").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_STATIONS).select("_sy", "_sx").checkpoint()
        local = local.join(hot, ["_sy", "_sx"], "left_anti")
        crowded = probe.join(hot, ["_sy", "_sx"], "left_semi").select(key).distinct().withColumn("_crowded", F.lit(True))
    best = _closest(probe.join(local, ["_sy", "_sx"]), key)
    bound = F.lit(cell * 111.0) * F.cos(F.radians(F.least(F.abs(F.col("_plat")) + F.lit(cell), F.lit(89.0))))
    covers = ((F.col("_py") - 1 <= extent["_y0"] >> up) & (F.col("_py") + 1 >= extent["_y1"] >> up)
              & (F.col("_px") - 1 <= extent["_x0"] >> up) & (F.col("_px") + 1 >= extent["_x1"] >> up))
    # A point without coordinates: final at once, with a null station.
    final = F.coalesce(covers, F.lit(True)) | F.coalesce(F.col("_b._d") <= bound, F.lit(False))
    scored = pts.join(best, key, "left")
    if crowded is not None:
        scored, final = scored.join(crowded, key, "left"), final & F.col("_crowded").isNull()
    scored = scored.withColumn("_final", final).checkpoint()
    rest = scored.where("NOT _final").select(*pts.columns)
    done = scored.where("_final").select(key, "_b")
    if not rest.isEmpty():
        done = done.unionByName(_descend(rest, st, key, extent))
    return done.select(key, F.col("_b._sid").alias("station"), F.round(F.col("_b._d"), 4).alias("distance_km"))


def line_length_km(path: Column) -> Column:
    """Great-circle length of a polyline (array<struct<x=lon, y=lat>>)."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(path) - 2),
        F.lit(0.0),
        lambda acc, i: acc + haversine_km(path[i]["y"], path[i]["x"], path[i + 1]["y"], path[i + 1]["x"]),
    )
