"""Geographic zones with k-means (M1-M6, M19 for zones).

Requests are first reduced to their distinct places, with the number of requests as
weight: one shuffle, whatever the number of fits, and every fit, score and size is then a
weighted one over the places. Request rows are labelled by a narrow pass.

Coordinates are standardised with the population standard deviation (the
reference's scaler; Spark ML's StandardScaler would use the sample std), then
``pyspark.ml.clustering.KMeans`` is fitted once per seed and the lowest-cost
model is kept (Spark's KMeans has no n_init). The seeds are independent fits,
so they run as concurrent Spark jobs; each fit is itself distributed. The
silhouette is Spark's ``ClusteringEvaluator`` (squared Euclidean), which is
linear in the data; an exact Euclidean silhouette is quadratic and is not built.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.operators.profile import top_by_count

# Reference k-means settings.
K = 4
K_RANGE = range(2, 12)
SEED = 42
N_INIT = 10
MAX_ITER = 300
CATEGORY_K = 3
TOP_N_CATEGORIES = 5
MIN_CATEGORY_SIZE = 200
PARALLEL_FITS = 8
# Places that one task of a fit works through before there are more tasks.
PLACES_PER_TASK = 1 << 20


def places(requests: DataFrame, category: str | None = None, cols=("lat", "long")) -> DataFrame:
    """Distinct coordinates (and categories) with ``weight``, their number of requests; requests without
    coordinates have no place."""
    by = [*cols, *([category] if category else [])]
    return requests.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).groupBy(*by).agg(F.count(F.lit(1)).alias("weight"))


def statistics(weighted: DataFrame, cols=("lat", "long"), group: str | None = None) -> DataFrame:
    """Weighted mean and population std of each column, one row (per group when given)."""
    w = F.col("weight")
    weighted = weighted.select(*cols, "weight", *([group] if group else []))
    means = weighted.groupBy(*([group] if group else [])).agg(*((F.sum(F.col(c) * w) / F.sum(w)).alias(f"{c}_mean") for c in cols))
    spread = weighted.join(F.broadcast(means), group) if group else weighted.crossJoin(F.broadcast(means))  # a row (a group)
    return spread.groupBy(*([group] if group else [])).agg(
        *(F.first(f"{c}_mean").alias(f"{c}_mean") for c in cols),
        *(F.sqrt(F.sum((F.col(c) - F.col(f"{c}_mean")) ** 2 * w) / F.sum(w)).alias(f"{c}_std") for c in cols))


def standardise(df: DataFrame, cols=("lat", "long"), group: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """M1: (x - mean) / population std per column (per group when given) of rows with a ``weight``, or by
    given statistics; these are kept as columns so centroids can be un-scaled later. A column without
    spread becomes 0."""
    stats = statistics(df, cols, group) if stats is None else stats
    out = df.join(F.broadcast(stats), group) if group else df.crossJoin(F.broadcast(stats))  # one row (per group)
    for c in cols:
        z = (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")
        out = out.withColumn(f"{c}_z", F.when(F.col(f"{c}_std") > 0, z).otherwise(F.lit(0.0)))
    return VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features").transform(out)


def gathered(points: DataFrame, n: int) -> DataFrame:
    """``points`` (``n`` rows) in no more partitions than their number asks for. Every iteration of every
    fit sends the result of two tasks a partition to the driver, and the fits run side by side as it is, so
    small partitions cost results and gain nothing."""
    return points.coalesce(max(1, -(-n // PLACES_PER_TASK)))


def _kmeans(k: int, seed: int) -> KMeans:
    return KMeans(k=k, seed=seed, maxIter=MAX_ITER, featuresCol="features", predictionCol="raw_cluster", weightCol="weight")


def fit_best(points: DataFrame, k: int, n_init: int = N_INIT, seed: int = SEED) -> KMeansModel:
    """M2: the lowest within-cluster sum of squares over ``n_init`` seeded fits of weighted places."""
    def one(s):
        return _kmeans(k, s).fit(points)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        models = list(pool.map(one, [seed + i for i in range(n_init)]))
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(model: KMeansModel, points: DataFrame) -> float:
    pred = model.transform(points)
    return ClusteringEvaluator(featuresCol="features", predictionCol="raw_cluster", weightCol="weight").evaluate(pred)


def elbow(points: DataFrame, k_range=K_RANGE, n_init: int = N_INIT) -> DataFrame:
    """M3: inertia and silhouette for each k (one row per k). All (k, seed) fits are
    independent, so they share one pool of concurrent jobs (no barrier per k)."""
    spark = points.sparkSession
    jobs = [(k, SEED + i) for k in k_range for i in range(n_init)]  # a parameter grid, not data

    def one(job):
        k, s = job
        return k, _kmeans(k, s).fit(points)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fits = list(pool.map(one, jobs))
    best: dict[int, KMeansModel] = {}
    for k, m in fits:
        if k not in best or m.summary.trainingCost < best[k].summary.trainingCost:
            best[k] = m
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        sils = dict(zip(best, pool.map(lambda m: silhouette(m, points), best.values())))
    rows = [(k, round(best[k].summary.trainingCost, 2), round(sils[k], 4)) for k in sorted(best)]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def size_labels(model: KMeansModel, weighted: DataFrame) -> DataFrame:
    """W1 over places: (raw_cluster, cluster), 1 = most requests (ties by old label). k rows."""
    sizes = model.transform(weighted).groupBy("raw_cluster").agg(F.sum("weight").alias("_size"))
    return sizes.select("raw_cluster", F.row_number().over(Window.orderBy(F.desc("_size"), "raw_cluster")).alias("cluster"))


def assign(model: KMeansModel, rows: DataFrame, weighted: DataFrame) -> DataFrame:
    """M6: cluster labels 1..k with 1 = biggest by the weighted places; ``rows`` are standardised places,
    or requests standardised by the places' statistics (a narrow pass)."""
    return model.transform(rows).join(F.broadcast(size_labels(model, weighted)), "raw_cluster").drop("raw_cluster")


def zone_summary(labelled: DataFrame, category: str) -> DataFrame:
    """G3 + S28 from labelled places of a category each: requests, centroid, share, top category."""
    w = F.col("weight")
    agg = labelled.groupBy("cluster").agg(
        F.sum(w).alias("count"), F.round(F.sum(F.col("lat") * w) / F.sum(w), 6).alias("lat_centroid"),
        F.round(F.sum(F.col("long") * w) / F.sum(w), 6).alias("lon_centroid"))
    total = F.sum("count").over(Window.partitionBy())  # one row per zone
    agg = agg.withColumn("pct_of_total", F.round(F.col("count") / total * 100.0, 1))
    return agg.join(top_by_count(labelled, "cluster", category, "top_category", "weight"), "cluster", "left")


def category_clusters(df: DataFrame, category: str, top_n: int = TOP_N_CATEGORIES,
                      min_size: int = MIN_CATEGORY_SIZE, k: int = CATEGORY_K) -> DataFrame:
    """M5: k-means per leading category (>= min_size requests), centroids un-scaled to lat/long."""
    spark = df.sparkSession
    df = places(df.filter(F.col(category).isNotNull()), category).checkpoint()  # all categories' fits read it
    counts = df.groupBy(category).agg(F.sum("weight").alias("n"))
    top = counts.orderBy(F.desc("n"), category).limit(top_n).filter(F.col("n") >= min_size)
    cats = [r[0] for r in top.collect()]  # at most top_n names
    scaled = standardise(df.where(F.col(category).isin(cats)), group=category) if cats else df
    parts = []
    for cat in cats:
        sub = scaled.filter(F.col(category) == cat)
        m = fit_best(sub, k)
        # The scaling statistics are constant within the category: one aggregate row.
        stats = sub.agg(*[F.max(c).alias(c) for c in ("lat_mean", "lat_std", "long_mean", "long_std")])
        centres = spark.createDataFrame(
            [(i + 1, float(c[0]), float(c[1])) for i, c in enumerate(m.clusterCenters())],
            "cat_cluster int, lat_z double, long_z double",
        )
        sizes = m.transform(sub).groupBy((F.col("raw_cluster") + 1).alias("cat_cluster")).agg(
            F.sum("weight").cast("long").alias("cluster_size")
        )
        part = centres.crossJoin(stats).join(sizes, "cat_cluster", "left").select(
            F.lit(cat).alias("category"),
            "cat_cluster",
            F.round(F.col("lat_z") * F.col("lat_std") + F.col("lat_mean"), 6).alias("lat_centroid"),
            F.round(F.col("long_z") * F.col("long_std") + F.col("long_mean"), 6).alias("lon_centroid"),
            F.coalesce("cluster_size", F.lit(0).cast("long")).alias("cluster_size"),
        )
        parts.append(part)
    if not parts:
        return spark.createDataFrame(
            [], "category string, cat_cluster int, lat_centroid double, lon_centroid double, cluster_size long"
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
