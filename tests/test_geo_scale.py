"""Nearest station and zonal statistics against brute force, and what they cost."""

import math
import random

import numpy as np
import pytest

from civicflow.operators import geo as G
from pyspark.sql import functions as F


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * G.EARTH_KM * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(11)
    stations = [(k, 37.5 + rng.random() * 0.8, -122.9 + rng.random() * 0.8) for k in range(150)] + [(500, 37.9, -122.5), (501, 37.9, -122.5)]
    points = [(k, 37.0 + rng.random() * 2, -123.5 + rng.random() * 2) for k in range(300)]
    points += [(1000, 0.0, 0.0), (1001, -89.9, 10.0), (1002, 89.0, 179.9), (1003, 37.9, -122.5), (1004, 60.0, 170.0), (1005, 37.9, 57.4)]
    return (points, stations, spark.createDataFrame(points, "k int, lat double, long double"),
            spark.createDataFrame(stations, "sid int, lat double, long double"))


@pytest.mark.parametrize("cell", [0.05, 1.0])
def test_nearest_equals_brute_force(places, cell):
    points, stations, pts, st = places
    found = {r["k"]: (r["station"], r["distance_km"]) for r in G.nearest(pts, st, "k", "sid", cell).collect()}
    assert len(found) == len(points)
    for k, lat, lon in points:
        d, sid = min((km((lat, lon), s[1:]), s[0]) for s in stations)
        got = km((lat, lon), next(s[1:] for s in stations if s[0] == found[k][0]))
        assert got == pytest.approx(d, abs=1e-9) and found[k][1] == pytest.approx(d, abs=1e-4)
    assert found[1003][0] == 500  # of two stations at one place the smaller key


def test_candidates_do_not_grow_with_the_stations(spark, monkeypatch):
    """Some 2,000 stations in four cells of the grid that is asked for, 300 of them in a thousandth of a cell."""
    rng = random.Random(8)
    stations = [(k, 38.0 + rng.random() * 0.04, -122.5 + rng.random() * 0.04) for k in range(1700)]
    stations += [(2000 + k, 38.01 + rng.random() * 2e-5, -122.49 + rng.random() * 2e-5) for k in range(300)]
    points = [(k, 38.0 + rng.random() * 0.04, -122.5 + rng.random() * 0.04) for k in range(200)]
    points += [(500 + k, 38.01 + rng.random() * 2e-5, -122.49 + rng.random() * 2e-5) for k in range(50)]
    pts = spark.createDataFrame(points, "k int, lat double, long double")
    st = spark.createDataFrame(stations, "sid int, lat double, long double")
    tried, closest = [], G._closest

    def counted(cand, key):
        tried.append(cand.groupBy(key).count().agg(F.max("count")).first()[0])
        return closest(cand, key)

    monkeypatch.setattr(G, "_closest", counted)
    found = {r["k"]: r["station"] for r in G.nearest(pts, st, "k", "sid", 0.02).collect()}
    assert found == {k: min((km((a, b), s[1:]), s[0]) for s in stations)[1] for k, a, b in points}
    assert len(tried) == 2 and max(tried) <= 9 * G.HOT_STATIONS


def test_far_points_cost_few_cells_a_level(places, spark, monkeypatch):
    *_, pts, st = places
    seen = []
    kept = G._kept_cells

    def counted(cand, key):
        out = kept(cand, key)
        seen.append((cand.where("k = 1000").count(), out.where("k = 1000").count()))
        return out

    monkeypatch.setattr(G, "_kept_cells", counted)
    G.nearest(pts.where("k = 1000"), st, "k", "sid", 0.01).collect()
    assert len(seen) >= 5 and all(tried <= 16 and left <= 9 for tried, left in seen)  # of some 10^8 cells between


def test_box_distance_is_a_lower_bound(spark):
    rng = random.Random(3)
    rows, want = [], []
    for _ in range(400):
        la, lo = sorted(rng.uniform(-90, 90) for _ in range(2)), sorted(rng.uniform(-180, 180) for _ in range(2))
        p = rng.uniform(-90, 90), rng.uniform(-180, 180)
        rows.append((*p, *la, *lo))
        want.append(min(km(p, (rng.uniform(*la), rng.uniform(*lo))) for _ in range(60)))
    df = spark.createDataFrame(rows, "lat double, lon double, la0 double, la1 double, lo0 double, lo1 double")
    low = [r[0] for r in df.select(G.box_distance_km(*(F.col(c) for c in df.columns))).collect()]
    assert all(a <= b + 1e-9 for a, b in zip(low, want)) and max(low) > 1000


RASTER = {"x0": -123.0, "y0": 38.0, "dx": 0.001, "dy": 0.001}


@pytest.mark.parametrize("buffer_m", [50.0, 400.0, 2500.0])
def test_zonal_stats_equal_windows(spark, buffer_m):
    rng = np.random.default_rng(4)
    grid = np.round(rng.normal(50, 20, (60, 70)), 1)
    grid[rng.random(grid.shape) < 0.2] = np.nan
    pixels = spark.createDataFrame([(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)], "row int, col int, value double")
    points = [(k, 38.0 - rng.random() * 0.07, -123.0 + rng.random() * 0.08) for k in range(40)] + [(99, 37.0, -120.0), (98, 38.001, -123.001)]
    pts = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in points], "k int, lat double, long double")
    found = {r["k"]: tuple(r)[1:] for r in G.zonal_stats(pts, pixels, RASTER, "k", buffer_m).collect()}
    assert len(found) == len(points)
    for k, lat, lon in points:
        dlat, dlon = buffer_m / 111000.0, buffer_m / (111000.0 * math.cos(math.radians(lat)))
        r0, r1 = (math.floor((RASTER["y0"] - (lat + s * dlat)) / RASTER["dy"]) for s in (1, -1))
        c0, c1 = (math.floor((lon + s * dlon - RASTER["x0"]) / RASTER["dx"]) for s in (-1, 1))
        win = grid[max(r0, 0) : max(r1 + 1, 0), max(c0, 0) : max(c1 + 1, 0)]
        v = win[~np.isnan(win)]
        if not len(v):
            assert found[k] == (None,) * 6
            continue
        want = (len(v), v.mean(), np.median(v), v.min(), v.max(), v.std())
        np.testing.assert_allclose(found[k], want, atol=6e-5)


def test_zonal_rows_do_not_grow_with_the_buffer(spark):
    pts = spark.createDataFrame([(k, 37.97, -122.96) for k in range(5)], "k int, lat double, long double")
    pixels = spark.range(200 * 200).selectExpr("cast(id div 200 as int) row", "cast(id % 200 as int) col", "cast(id as double) value")
    for buffer_m in (100.0, 1000.0, 5000.0):
        G.zonal_stats(pts, pixels, RASTER, "k", buffer_m)
        plan = G.zonal_stats(pts, pixels, RASTER, "k", buffer_m)
        side = max(1, math.ceil(2.0 * buffer_m / 111000.0 / RASTER["dy"]))
        assert G.tiles(pixels, side).count() >= 1 and plan.count() == 5
        # a window of side + 1 pixels by 1.3 times that: two rows of tiles, three columns at most
        width = 2 * buffer_m / (111000.0 * math.cos(math.radians(37.97))) / RASTER["dx"]
        assert width / side < 1.35 or side == 2


def rings(*paths):
    return [[{"x": float(x), "y": float(y)} for x, y in path] for path in paths]


POLYGONS = [
    ("ell", rings([(0, 0), (6, 0), (6, 2.5), (2.5, 2.5), (2.5, 6), (0, 6), (0, 0)])),
    ("holed", rings([(7, 0), (13, 0), (13, 6), (7, 6), (7, 0)], [(8.5, 1.5), (8.5, 4.5), (11.5, 4.5), (11.5, 1.5), (8.5, 1.5)])),
    ("slanted", rings([(14, 0), (20, 3), (17, 9), (14, 0)])),
]
POLYGON_SCHEMA = "geoid string, rings array<array<struct<x:double,y:double>>>"


def inside(polygon, x, y):
    odd = False
    for ring in polygon:
        for a, b in zip(ring, ring[1:]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
    return odd


@pytest.mark.parametrize("cell,hot_rows", [(1.0, 10**6), (0.37, 10**6), (4.0, 20), (1.0, 3)])
def test_point_in_polygon_equals_ray_test(spark, cell, hot_rows):
    rng = random.Random(6)
    points = [(k, rng.uniform(-1, 21), rng.uniform(-1, 10)) for k in range(500)] + [(1000 + k, 1.2, 1.3) for k in range(60)]
    points += [(2000 + k, float(x), float(y)) for k, (x, y) in enumerate([(6, 1), (0, 0), (7, 3), (8.5, 3), (2.5, 4), (13, 6), (14, 0)])] + [(3000, None, 1.0)]
    pts, polys = spark.createDataFrame(points, "k int, x double, y double"), spark.createDataFrame(POLYGONS, POLYGON_SCHEMA)
    found = {r["k"]: r["geoid"] for r in G.point_in_polygon(pts, polys, "x", "y", "k", cell, hot_rows=hot_rows).collect()}
    assert found == {k: None if x is None else next((g for g, p in POLYGONS if inside(p, x, y)), None) for k, x, y in points}


def test_cells_are_marked_and_not_repeated(spark):
    polys = spark.createDataFrame(POLYGONS, POLYGON_SCHEMA)
    cells = G.polygon_cells(polys, 0.5)
    assert cells.count() == cells.select("geoid", "cx", "cy").distinct().count()
    marked = {(r["geoid"], r["cx"], r["cy"]): r["interior"] for r in cells.select("geoid", "cx", "cy", "interior").collect()}
    assert sum(marked.values()) > 50 and not all(marked.values())
    assert ("holed", 19, 5) not in marked  # in the hole
    pts = spark.range(1000).selectExpr("id k", "cast(id % 20 as double) x", "cast(id % 9 as double) y", "id % 20 cx", "id % 9 cy")
    dealt, repeated = G.split_hot(pts, cells, ["cx", "cy"], "k", 10**6, 8)
    assert repeated.count() == cells.count() and dealt.where("_way <> 0").isEmpty()
    dealt, repeated = G.split_hot(pts.withColumn("cx", F.lit(1).cast("long")).withColumn("cy", F.lit(1).cast("long")), cells, ["cx", "cy"], "k", 200, 8)
    assert dealt.select("_way").distinct().count() == 5 and dealt.count() == 1000
    assert repeated.count() == cells.count() + 4 * cells.where("cx = 1 AND cy = 1").count()


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_raster_sample_equals_pixels(spark, hot_rows):
    rng = np.random.default_rng(9)
    grid = np.round(rng.normal(50, 20, (12, 15)), 1)
    grid[rng.random(grid.shape) < 0.4] = np.nan
    pixels = spark.createDataFrame([(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)], "row int, col int, value double")
    points = [(k, 38.001 - rng.random() * 0.015, -123.001 + rng.random() * 0.018) for k in range(120)] + [(500 + k, 37.9955, -122.9945) for k in range(40)]
    pts = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in points], "k int, lat double, long double")
    found = {r["k"]: r["elevation_m"] for r in G.sample_raster(pts, pixels, RASTER, "k", hot_rows=hot_rows).collect()}
    for k, lat, lon in points:
        r, c = math.floor((RASTER["y0"] - lat) / RASTER["dy"]), math.floor((lon - RASTER["x0"]) / RASTER["dx"])
        want = None
        if 0 <= r < 12 and 0 <= c < 15:
            block = grid[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]
            want = grid[r, c] if not math.isnan(grid[r, c]) else None if np.isnan(block).all() else np.nanmean(block)
        assert (found[k] is None) == (want is None) and (want is None or abs(found[k] - want) < 0.0501)
