"""k-means over weighted places against the requests themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.operators import zones as Z
from civicflow.plans import zones as PZ
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def requests(spark):
    rng = np.random.default_rng(8)
    centres = [(37.9, -122.5, 300), (38.0, -122.6, 200), (37.95, -122.42, 100), (38.05, -122.55, 60)]
    rows = []
    for lat, lon, n in centres:
        spots = np.round(rng.normal((lat, lon), 0.004, (15, 2)), 3)
        rows += [(float(a), float(b), f"c{rng.integers(3)}") for a, b in spots[rng.integers(15, size=n)]]
    rows += [(None, -122.5, "c0"), (37.9, None, "c1")]
    return spark.createDataFrame(rows, "lat double, long double, category string").checkpoint()


def test_weighted_places_equal_rows(spark, requests):
    pts = Z.standardise(Z.places(requests)).checkpoint()
    whole = requests.where("lat is not null and long is not null")
    assert pts.agg(F.sum("weight")).first()[0] == whole.count() == 660 and pts.count() <= 60
    stats = Z.statistics(pts).first()
    want = whole.agg(F.avg("lat"), F.stddev_pop("lat"), F.avg("long"), F.stddev_pop("long")).first()
    np.testing.assert_allclose([stats["lat_mean"], stats["lat_std"], stats["long_mean"], stats["long_std"]], want, rtol=1e-9)
    model = Z.fit_best(pts, 4)
    labelled = Z.assign(model, Z.standardise(whole, stats=Z.statistics(pts)), pts)  # request rows
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    assert sizes == {1: 300, 2: 200, 3: 100, 4: 60}
    cost = 0.0
    for rows in labelled.groupBy("cluster").agg(F.collect_list(F.array("lat_z", "long_z")).alias("p")).collect():
        p = np.array(rows["p"])
        cost += ((p - p.mean(axis=0)) ** 2).sum()
    assert model.summary.trainingCost == pytest.approx(cost, rel=1e-9)
    assert Z.silhouette(model, pts) > 0.8


def test_elbow_falls(spark, requests):
    rows = Z.elbow(Z.standardise(Z.places(requests)).checkpoint(), range(2, 5), 3).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4] and rows[0]["inertia"] > rows[1]["inertia"] > rows[2]["inertia"]


def test_category_clusters(spark, requests):
    rows = Z.category_clusters(requests.withColumn("long", F.coalesce("long", F.lit(-122.5))), "category", top_n=2, min_size=150, k=3).collect()
    sizes = {}
    for r in rows:
        sizes[r["category"]] = sizes.get(r["category"], 0) + r["cluster_size"]
    counts = {r["category"]: r["count"] for r in requests.where("lat is not null").groupBy("category").count().collect()}
    assert len(sizes) == 2 and sizes == {c: counts[c] for c in sizes} and len(rows) == 6
    assert Z.category_clusters(requests, "category", min_size=10_000).count() == 0


def test_a_column_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3), (1.0, 4.0, 5)], "lat double, long double, weight long")
    assert [r["lat_z"] for r in Z.standardise(df).collect()] == [0.0, 0.0]


def test_queries_cover_the_requests_of_the_box(spark):
    inside = PZ.q_bbox_filter(spark, SF_SMALL).count()
    assert PZ.q_kmeans_zones(spark, SF_SMALL).agg(F.sum("count")).first()[0] == inside
    zones = PZ.q_request_zones(spark, SF_SMALL)
    assert zones.count() == inside
    sizes = [r["count"] for r in zones.groupBy("cluster").count().orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == Z.K


def test_places_are_fitted_in_few_partitions(spark, monkeypatch):
    """the results sent to the driver grow with the tasks of a fit, one or two a partition and iteration."""
    rows = spark.range(0, 1000, 1, 8)
    assert Z.gathered(rows, 1000).rdd.getNumPartitions() == 1
    assert Z.gathered(rows, 0).rdd.getNumPartitions() == 1
    monkeypatch.setattr(Z, "PLACES_PER_TASK", 300)
    found = Z.gathered(rows, 1000)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(r[0] for r in found.collect()) == list(range(1000))
