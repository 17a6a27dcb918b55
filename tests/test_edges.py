"""Hand-made edge tables (FIXTURES 4) with hand-computed answers."""

import datetime as dt

from pyspark.sql import functions as F

from civicflow.operators import clean, evaluation as EV, geo as G, profile, series as S, weather


def test_requests_edge(spark):
    rows = [
        (1, 10, "Pothole / Bache", "Closed", "2023-01-01 10:00:00", "2023-01-03 10:00:00", 37.97, -122.53, "  abcdef  "),
        (2, 11, None, "CLOSED", "2023-01-02 00:00:00", "1900-01-01 00:00:00", 37.97, -122.53, "abcde"),
        (3, 12, "Trees", None, "2023-01-05 00:00:00", "2023-01-04 00:00:00", None, -122.5, None),
        (4, 13, "A / B / C", "open", "2020-01-01 00:00:00", "2024-12-30 00:00:00", 0.0, 0.0, "x"),
        (5, 14, "Graffiti", "closed", "2020-01-01 00:00:00", "2024-12-31 00:00:00", 37.9, -122.5, None),
    ]
    raw = spark.createDataFrame(
        rows, "OBJECTID long, service_request_id long, category string, status string, requested_datetime string, "
              "date_closed string, lat double, long double, description string")
    out = {r["object_id"]: r for r in clean.clean_requests(raw).collect()}
    assert set(out) == {1, 2, 4, 5}                      # null lat dropped
    r1 = out[1]
    assert r1["category_short"] == "Pothole" and r1["status_binary"] == 1
    assert r1["requested_week"] == 52 and r1["requested_day_of_week"] == "Sunday"
    assert r1["resolution_days"] == 2.0 and r1["has_description"] == 1   # 6 chars after trim
    assert out[2]["category_short"] is None and out[2]["status_binary"] == 1
    assert out[2]["date_closed"] is None and out[2]["resolution_days"] is None and out[2]["has_description"] == 0
    assert out[4]["category_short"] == "A" and out[4]["resolution_days"] == 1825.0
    assert out[5]["resolution_days"] is None             # 1826 days -> implausible
    assert [c for c in clean.clean_requests(raw).columns][:2] == ["object_id", "service_request_id"]
    # week start of a Sunday is the previous Monday
    ws = spark.createDataFrame([("2023-01-01 12:00:00",)], "t string").select(
        S.week_start(F.col("t").cast("timestamp")).alias("w")).collect()[0]["w"]
    assert ws == dt.date(2022, 12, 26)
    # bbox: strict, (0, 0) removed
    box = clean.clean_requests(raw).filter(clean.in_bbox(F.col("lat"), F.col("long"), clean.SERVICE_AREA))
    assert {r["object_id"] for r in box.collect()} == {1, 2, 5}


def test_epoch_millis_and_sentinel(spark):
    raw = spark.createDataFrame(
        [(1, 1, "c", "closed", 1672531200000, -2208988800000, 37.9, -122.5)],
        "objectid long, service_request_id long, category string, status string, requested_datetime long, "
        "date_closed long, lat double, long double")
    r = clean.clean_requests(raw).collect()[0]
    assert r["requested_datetime"] == dt.datetime(2023, 1, 1) and r["date_closed"] is None


def test_station_edge(spark):
    sd = spark.createDataFrame(
        [("2023-01-01", None, 5.0, None, None), ("2023-01-01", None, 7.0, 1.0, 3.0)],
        "DATE string, TMAX double, TMIN double, PRCP double, WT01 double")
    r = weather.daily_weather(sd).collect()[0]
    assert r["tmax_avg"] is None and r["tmin_avg"] == 6.0
    assert r["prcp_avg"] == 0.5                 # null -> 0 before the mean
    assert r["severe_wind"] == 0                # no AWND column
    assert r["severe_weather_event"] == 1       # WT01 present, others absent -> 0


def test_zone_edge(spark):
    rows = [
        # zone 1: medians 3.0 vs city median; zone 2 has no closed requests
        (1, "a", 2.0), (1, "a", 4.0), (1, "b", 3.0), (1, "b", None),
        (2, "b", None), (2, "a", None),
        (3, "a", 9.0), (3, "a", 9.0),
    ]
    df = spark.createDataFrame(rows, "cluster int, category_short string, resolution_days double") \
        .withColumn("lat", F.lit(37.9)).withColumn("long", F.lit(-122.5))
    perf = {r["cluster"]: r for r in profile.zone_performance(df).collect()}
    # city median of closed = median(2,4,3,9,9) = 4.0
    assert perf[1]["median_days"] == 3.0 and perf[1]["response_tier"] == "AVERAGE"   # 3.0 == .75 * 4 -> not FAST
    assert perf[2]["n_closed"] == 0 and perf[2]["median_days"] is None
    assert perf[2]["response_tier"] == "AVERAGE" and perf[2]["pct_over_7d"] is None
    assert perf[3]["response_tier"] == "SLOW"
    assert perf[2]["top_category"] == "a"        # tie 1-1 -> name order
    assert perf[1]["slowest_category"] == "a"    # a: 3.0, b: 3.0 -> tie -> name


def test_series_edge(spark):
    d0 = dt.date(2023, 1, 2)
    rows = [(1, d0 + dt.timedelta(days=7 * w)) for w in (0, 0, 2, 5)]
    df = spark.createDataFrame(rows, "zone int, t date").withColumn("t", F.col("t").cast("timestamp"))
    dense = S.dense_series(S.weekly_counts(df, "t", "zone"), drop_last_week=False)
    got = {(r["series_id"], r["week_start"]): r["y"] for r in dense.collect()}
    assert got[("1", d0 + dt.timedelta(days=7))] == 0.0 and got[("1", d0)] == 2.0
    assert len([k for k in got if k[0] == "city"]) == 6
    dropped = S.dense_series(S.weekly_counts(df, "t", "zone"))
    assert dropped.filter(F.col("series_id") == "city").count() == 5
    # sparse rule: mean exactly 8 is not sparse, zero share exactly 20 % is not sparse
    ser = spark.createDataFrame(
        [("city", d0 + dt.timedelta(days=7 * i), 10.0) for i in range(5)]
        + [("1", d0 + dt.timedelta(days=7 * i), y) for i, y in enumerate([10.0, 10.0, 10.0, 10.0, 0.0])]
        + [("2", d0 + dt.timedelta(days=7 * i), 8.0) for i in range(5)],
        "series_id string, week_start date, y double")
    cls = {r["series_id"]: r["is_sparse"] for r in S.classify_sparse(ser).collect()}
    assert cls == {"1": False, "2": False}
    # lag-52 autocorrelation needs 104 weeks
    for n, expect_null in ((103, True), (104, False)):
        s = spark.createDataFrame([("x", d0 + dt.timedelta(days=7 * i), float(i % 7)) for i in range(n)],
                                  "series_id string, week_start date, y double")
        assert (S.lag_autocorr(s).collect()[0]["autocorr_lag52"] is None) == expect_null
    # MAPE policies with a zero actual
    m = spark.createDataFrame([("x", 0.0, 2.0), ("x", 4.0, 2.0)], "series_id string, y double, p double")
    r = S.error_metrics(m, "series_id", "y", "p").collect()[0]
    assert r["mape_clip"] == 125.0 and r["mape_positive"] == 50.0


def _ring(pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_polygon_edge(spark):
    ell = _ring([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)])
    holed = [_ring([(3, 0), (5, 0), (5, 2), (3, 2), (3, 0)]), _ring([(3.5, 0.5), (3.5, 1.5), (4.5, 1.5), (4.5, 0.5), (3.5, 0.5)])]
    sq_a = _ring([(6, 0), (7, 0), (7, 1), (6, 1), (6, 0)])
    sq_b = _ring([(7, 0), (8, 0), (8, 1), (7, 1), (7, 0)])
    polys = spark.createDataFrame(
        [("L", [ell]), ("H", holed), ("A", [sq_a]), ("B", [sq_b])],
        "geoid string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame(
        [(1, 0.5, 1.5), (2, 1.5, 1.5), (3, 3.2, 1.0), (4, 4.0, 1.0), (5, 7.0, 0.5), (6, 9.0, 9.0)],
        "pid long, x double, y double")
    got = {r["pid"]: r["geoid"] for r in G.point_in_polygon(pts, polys, "x", "y", "pid", cell=1.0, salt=3).collect()}
    assert got[1] == "L" and got[2] is None          # inside / in the notch of the L
    assert got[3] == "H" and got[4] is None          # ring / hole
    assert got[5] in ("A", "B")                      # shared edge: exactly one polygon
    assert got[6] is None
    area = spark.createDataFrame([([ell],)], "rings array<array<struct<x:double,y:double>>>")
    assert area.select(G._ring_area(F.col("rings")[0])).collect()[0][0] > 0


def test_pixel_edge(spark):
    t = {"x0": 0.0, "y0": 3.0, "dx": 1.0, "dy": 1.0}
    vals = {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 4.0, (1, 1): None, (1, 2): 6.0,
            (2, 0): None, (2, 1): None, (2, 2): None}
    px = spark.createDataFrame([(r, c, v) for (r, c), v in vals.items()], "row int, col int, value double")
    pts = spark.createDataFrame(
        [(1, 1.5, 1.5), (2, 0.5, 2.5), (3, 9.0, 9.0), (4, 2.5, 0.5)], "pid long, long double, lat double")
    got = {r["pid"]: r["elevation_m"] for r in G.sample_raster(pts, px, t, "pid", salt=2).collect()}
    assert got[1] == round((1 + 2 + 3 + 4 + 6) / 5, 1)   # null centre -> valid 3x3 mean
    assert got[2] == 1.0                                  # corner cell
    assert got[3] is None                                 # out of bounds
    assert got[4] == 6.0                                  # row 2 all null: neighbours (1,1) null, (1,2)=6
    plane = spark.createDataFrame([(r, c, float(c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    sl = {(r["row"], r["col"]): r["slope_deg"] for r in G.slope(plane, 1.0, 1.0).collect()}
    assert all(abs(v - 45.0) < 1e-9 for v in sl.values())


def test_labels_edge(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "true_label string, pred_label string")
    rep = {r["class"]: r for r in EV.classification_report(EV.confusion_long(pairs, ["a", "b", "c"])).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["f1_score"] == 0.0   # never predicted
    assert rep["accuracy"]["precision"] == 0.5
    assert rep["macro avg"]["support"] == 4.0


def test_tract_edge(spark):
    from civicflow.functions import labels as L

    df = spark.createDataFrame([(6, 41, 101, -666666666)], "s int, c int, t int, inc long")
    r = df.select(L.geoid(F.col("s"), F.col("c"), F.col("t")).alias("g"), L.negative_to_null(F.col("inc")).alias("i")).collect()[0]
    assert r["g"] == "06041000101" and r["i"] is None


def test_nearest_keeps_points_without_answer(spark):
    pts = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 20.0)], "k int, lat double, long double")
    st = spark.createDataFrame([(7, 10.1, 20.1)], "sid int, lat double, long double")
    got = {r["k"]: r["station"] for r in G.nearest(pts, st, "k", "sid", 0.5).collect()}
    assert got == {1: 7, 2: None}
    none = {r["k"]: r["station"] for r in G.nearest(pts, st.where("false"), "k", "sid", 0.5).collect()}
    assert none == {1: None, 2: None}


def test_slope_uses_adjacent_pixels_only(spark):
    px = spark.createDataFrame([(r, c, float(c)) for r in range(4) for c in (0, 1, 3, 4)], "row int, col int, value double")
    assert {r["slope_deg"] for r in G.slope(px, 1.0, 1.0).collect()} == {45.0}
