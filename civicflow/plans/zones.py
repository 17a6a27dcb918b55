"""Registered zone queries: k-means zones, elbow sweep, per-category k-means,
service-area box filter, size-ordered relabelling.

k-means runs on the positions of the stand-in requests inside the service area."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.functions import labels as L
from civicflow.operators import clean, profile
from civicflow.operators import zones as Z
from civicflow.plans.standins import RAW_REQUESTS_SQL, raw_requests
from civicflow.sources.tables import read_table, state

_FITS: dict = {}


def points(spark, sf_dir):
    """Requests inside the service area (the rows of ``bbox_filter``) with position and category."""
    raw = raw_requests(spark, sf_dir)
    inside = raw.filter(clean.in_bbox(F.col("lat"), F.col("long"), clean.SERVICE_AREA))
    return inside.select(F.col("OBJECTID").alias("object_id"), "lat", "long", F.col("category").alias("category_short"))


def fitted(spark, sf_dir):
    """(places by category, standardised places, model), once per session and state of the tables."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""),
           state(spark, sf_dir, "lineitem", "orders", "customer", "nation"))
    if key not in _FITS:
        by_category = Z.places(points(spark, sf_dir), "category_short").checkpoint()
        pts = by_category.groupBy("lat", "long").agg(F.sum("weight").alias("weight")).checkpoint()
        scaled = Z.gathered(Z.standardise(pts), pts.count()).checkpoint()
        _FITS[key] = (by_category, scaled, Z.fit_best(scaled, Z.K))
    return _FITS[key]


def q_kmeans_zones(spark, sf_dir):
    by_category, pts, model = fitted(spark, sf_dir)
    labelled = Z.assign(model, Z.standardise(by_category, stats=Z.statistics(pts)), pts)
    return Z.zone_summary(labelled, "category_short")


def q_request_zones(spark, sf_dir):
    """M6: the zone of every request inside the service area."""
    _, pts, model = fitted(spark, sf_dir)
    rows = Z.standardise(points(spark, sf_dir), stats=Z.statistics(pts))
    return Z.assign(model, rows, pts).select("object_id", "lat", "long", "cluster")


def q_kmeans_metrics(spark, sf_dir):
    _, pts, model = fitted(spark, sf_dir)
    sil = Z.silhouette(model, pts)
    return pts.agg(F.sum("weight").cast("long").alias("n_records")).select(
        F.lit("KMeans").alias("model"), F.lit(Z.K).alias("k"), F.lit(round(sil, 4)).alias("silhouette_score"),
        "n_records", F.lit("fixed k with elbow and silhouette sweep").alias("k_selection"),
        F.lit(round(model.summary.trainingCost, 2)).alias("inertia"),
    )


def q_kmeans_elbow(spark, sf_dir):
    return Z.elbow(fitted(spark, sf_dir)[1])


def q_category_kmeans(spark, sf_dir):
    return Z.category_clusters(points(spark, sf_dir), "category_short")


def q_bbox_filter(spark, sf_dir):
    """B4 + S26: requests inside the service-area box, with a 1 km box around each."""
    raw = raw_requests(spark, sf_dir)
    inside = raw.filter(clean.in_bbox(F.col("lat"), F.col("long"), clean.SERVICE_AREA))
    box = L.bbox_around(F.col("lat"), F.col("long"), 1.0)
    return inside.select(
        F.col("OBJECTID").alias("object_id"), "lat", "long",
        *[F.round(v, 6).alias(k) for k, v in box.items()],
    )


def q_zone_relabel_by_size(spark, sf_dir):
    """Nations relabelled 1..25 by customer count (biggest first, ties by key)."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "raw_cluster")
    lab = profile.relabel_by_size(c, "raw_cluster", "cluster")
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).cast("long").alias("n"))


QUERIES = {
    "kmeans_zones": q_kmeans_zones,
    "request_zones": q_request_zones,
    "kmeans_metrics": q_kmeans_metrics,
    "kmeans_elbow": q_kmeans_elbow,
    "category_kmeans": q_category_kmeans,
    "bbox_filter": q_bbox_filter,
    "zone_relabel_by_size": q_zone_relabel_by_size,
}

ORACLE = {
    "bbox_filter": f"""
SELECT object_id, lat, long,
       round(lat - 1.0 / 111.0, 6) AS min_lat, round(lat + 1.0 / 111.0, 6) AS max_lat,
       round(long - 1.0 / (111.0 * cos(radians(lat))), 6) AS min_lon,
       round(long + 1.0 / (111.0 * cos(radians(lat))), 6) AS max_lon
FROM ({RAW_REQUESTS_SQL}) r
WHERE lat > 37.85 AND lat < 38.10 AND long > -122.65 AND long < -122.40""",
    "zone_relabel_by_size": """
SELECT CAST(row_number() OVER (ORDER BY n DESC, c_nationkey) AS INTEGER) AS cluster, CAST(n AS BIGINT) AS n
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) t""",
}
