"""Zone and category response profiles.

Shape of every plan here: one partial+final aggregation over the request fact
(map-side combine, so the shuffle carries one row per partition x group), then
joins among *aggregated* frames whose size is bounded by the number of zones x
categories. The exact medians are bounded-memory too: resolution days are
quantised to 0.01 in [0, 1825], so each group's value->count buffer holds at
most 182,501 entries no matter how many rows the group has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions import labels

ZONE = "cluster"
CATEGORY = "category_short"
RES = "resolution_days"
# How many leading categories the gap table studies.
TOP_N_CATEGORIES = 5


def _pct(part, whole, digits=1):
    return F.round(part / F.nullif(whole, F.lit(0)) * 100.0, digits)


def histogram(requests: DataFrame) -> DataFrame:
    """One pass over the request fact: counts and coordinate sums per
    (zone, category, resolution days). Resolution days are quantised (0.01 in
    [0, 1825]), so this table is bounded by zones x categories x 182,502 values no
    matter how many requests there are, and every profile below is derived from it
    (exact medians through ``percentile(value, p, frequency)``).

    It is checkpointed (reliably, into the shared checkpoint folder): the profiles read
    it several times with different filters, which would otherwise defeat exchange
    reuse and re-scan the fact once per branch."""
    if RES not in requests.columns:  # e.g. zones of plain points: counts and centroids only
        requests = requests.withColumn(RES, F.lit(None).cast("double"))
    return requests.filter(F.col(ZONE).isNotNull()).groupBy(ZONE, CATEGORY, RES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("lat").alias("sum_lat"), F.sum("long").alias("sum_long")
    ).checkpoint()


def _wmedian(value: str = RES):
    return F.percentile(F.col(value), F.lit(0.5), F.col("n"))


def top_by_count(df: DataFrame, group: str, key: str, out: str, weight: str | None = None) -> DataFrame:
    """Most frequent ``key`` per ``group``; null keys skipped, ties -> name order.
    ``weight`` names a count column when ``df`` is already aggregated."""
    cnt = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(key).isNotNull()).groupBy(group, key).agg(cnt.alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_n"), F.asc(key))
    return counts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(group, F.col(key).alias(out))


def city_median(hist: DataFrame) -> DataFrame:
    """One-row frame with the city-wide median of closed requests."""
    return hist.filter(F.col(RES).isNotNull()).agg(_wmedian().alias("city_median"))


def zone_summary(requests: DataFrame) -> DataFrame:
    """G3 + S28: per zone count, centroid means, share of all rows, top category."""
    h = histogram(requests)
    agg = h.groupBy(ZONE).agg(
        F.sum("n").alias("count"),
        F.round(F.sum("sum_lat") / F.sum("n"), 6).alias("lat_centroid"),
        F.round(F.sum("sum_long") / F.sum("n"), 6).alias("lon_centroid"),
    )
    total = F.sum("count").over(Window.partitionBy())  # one row per zone
    agg = agg.withColumn("pct_of_total", F.round(F.col("count") / total * 100.0, 1))
    return agg.join(top_by_count(h, ZONE, CATEGORY, "top_category", "n"), ZONE, "left")


def zone_performance(requests: DataFrame) -> DataFrame:
    """G4 + G5 + S19 + W2 + J3: one row per zone with the response profile and tier,
    all from one histogram (one scan of the fact, one shuffle)."""
    h = histogram(requests)
    res, n = F.col(RES), F.col("n")
    closed_n = F.sum(F.when(res.isNotNull(), n).otherwise(F.lit(0)))
    perf = h.groupBy(ZONE).agg(
        F.sum("n").alias("n_total"),
        closed_n.alias("n_closed"),
        F.percentile(F.when(res.isNotNull(), res), F.lit(0.5), n).alias("_median"),
        (F.sum(res * n) / F.sum(F.when(res.isNotNull(), n))).alias("_mean"),
        F.sum(F.when(res > 7, n)).alias("_o7"),
        F.sum(F.when(res > 30, n)).alias("_o30"),
        F.sum(F.when(res > 90, n)).alias("_o90"),
        (F.sum("sum_lat") / F.sum("n")).alias("_lat"),
        (F.sum("sum_long") / F.sum("n")).alias("_lon"),
    )
    # One-row benchmark; a crossJoin with a single row is a broadcast of 8 bytes.
    perf = perf.crossJoin(F.broadcast(city_median(h)))
    perf = perf.select(
        ZONE,
        F.col("n_total").cast("long").alias("n_total"),
        F.col("n_closed").cast("long").alias("n_closed"),
        _pct(F.col("n_closed"), F.col("n_total")).alias("pct_closed"),
        F.round("_median", 2).alias("median_days"),
        F.round("_mean", 2).alias("mean_days"),
        _pct(F.coalesce("_o7", F.lit(0)), F.col("n_closed")).alias("pct_over_7d"),
        _pct(F.coalesce("_o30", F.lit(0)), F.col("n_closed")).alias("pct_over_30d"),
        _pct(F.coalesce("_o90", F.lit(0)), F.col("n_closed")).alias("pct_over_90d"),
        F.round("_lat", 6).alias("lat_centroid"),
        F.round("_lon", 6).alias("lon_centroid"),
        labels.response_tier(F.round("_median", 2), F.col("city_median")).alias("response_tier"),
    )
    top = top_by_count(h, ZONE, CATEGORY, "top_category", "n")
    slow = (
        h.filter(res.isNotNull() & F.col(CATEGORY).isNotNull())
        .groupBy(ZONE, CATEGORY)
        .agg(_wmedian().alias("_m"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(ZONE).orderBy(F.desc("_m"), F.asc(CATEGORY))))
        .filter("_rn = 1")
        .select(ZONE, F.col(CATEGORY).alias("slowest_category"), F.round("_m", 4).alias("slowest_cat_median_days"))
    )
    # Left joins keep a zone that has no closed request (tier AVERAGE, nulls).
    return perf.join(top, ZONE, "left").join(slow, ZONE, "left")


def top_categories(requests: DataFrame, n: int = TOP_N_CATEGORIES, hist: DataFrame | None = None) -> DataFrame:
    """Category counts, top ``n`` by count then name (a top-k report). The cut is a
    distributed take-ordered (per-partition top n, then a merge); only the n survivors
    are numbered."""
    h = hist if hist is not None else histogram(requests)
    counts = h.filter(F.col(CATEGORY).isNotNull()).groupBy(CATEGORY).agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc(CATEGORY)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(CATEGORY))))


def category_gap(requests: DataFrame, n: int = TOP_N_CATEGORIES) -> DataFrame:
    """G6 + J5 + J6 + S20: zone x top-category closed-time profile vs the city median
    of that category; gap = rounded zone median - unrounded city median."""
    h = histogram(requests)
    top = top_categories(requests, n, h).select(CATEGORY)
    closed = h.filter(F.col(RES).isNotNull()).join(F.broadcast(top), CATEGORY, "left_semi")  # n rows (parameter)
    res, cnt = F.col(RES), F.col("n")
    per_zone = closed.groupBy(ZONE, CATEGORY).agg(
        F.sum("n").cast("long").alias("n_closed"),
        _wmedian().alias("_median"),
        (F.sum(res * cnt) / F.sum("n")).alias("_mean"),
        (F.coalesce(F.sum(F.when(res > 30, cnt)), F.lit(0)) / F.sum("n") * 100.0).alias("_o30"),
    )
    city = closed.groupBy(CATEGORY).agg(_wmedian().alias("city_median_days"))
    out = per_zone.join(city, CATEGORY)
    median_days = F.round("_median", 2)
    return out.select(
        ZONE,
        CATEGORY,
        "n_closed",
        median_days.alias("median_days"),
        F.round("_mean", 2).alias("mean_days"),
        F.round("_o30", 2).alias("pct_over_30d"),
        F.round("city_median_days", 4).alias("city_median_days"),
        F.round(median_days - F.col("city_median_days"), 2).alias("days_vs_city_median"),
        labels.gap_flag(median_days, F.col("city_median_days")).alias("gap_flag"),
    )


def gap_table(gaps: DataFrame) -> DataFrame:
    """L2: flagged rows only, largest gap first."""
    return gaps.filter(F.col("gap_flag") != "").orderBy(F.desc("days_vs_city_median"), ZONE, CATEGORY)


def gap_pivot(gaps: DataFrame, zones: list[int] | None = None) -> DataFrame:
    """Category x zone matrix of mean gap days (rounded to 1), a column for each zone in the
    data unless zones are given."""
    if zones is None:
        gaps = gaps.checkpoint()  # a row per zone and category, read twice
        zones = [r[0] for r in gaps.select(ZONE).where(F.col(ZONE).isNotNull()).distinct().orderBy(ZONE).collect()]
    piv = gaps.groupBy(CATEGORY).pivot(ZONE, zones).agg(F.avg("days_vs_city_median"))
    return piv.select(CATEGORY, *[F.round(F.col(str(z)), 1).alias(f"z{z}") for z in zones])


def zone_distribution(requests: DataFrame) -> DataFrame:
    """Rows per zone and percent of all rows."""
    counts = requests.filter(F.col(ZONE).isNotNull()).groupBy(ZONE).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per zone
    return counts.select(ZONE, F.col("n").cast("long").alias("n"), F.round(F.col("n") / total * 100.0, 2).alias("pct"))


def relabel_by_size(df: DataFrame, label: str = "raw_cluster", out: str = ZONE) -> DataFrame:
    """Relabel groups 1..k by size, biggest first (ties by old label)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    order = Window.orderBy(F.desc("_size"), F.asc(label))
    # One row per label: the labels are a small set (k clusters, the nations, ...).
    mapping = sizes.select(label, F.row_number().over(order).alias(out))
    return df.join(F.broadcast(mapping), label).drop(label)
