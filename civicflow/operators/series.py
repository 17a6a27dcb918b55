"""Weekly series: counts, dense calendar, split, statistics, error metrics
(G2, J8, W3-W7, B7, G20-G22, F7, F8 share).

A series table is long: (series_id string, week_start date, y double); the city
series is one more ``series_id`` ('city'), so every per-series computation is
one grouped job instead of a Python loop over zones.

Scale notes: the request fact is scanned once and reduced to (zone, week) counts
by a partial+final aggregation; everything after that works on rows bounded by
zones x weeks. The calendar is a one-row bounds frame exploded with
``sequence``; it is joined to the (few) series keys, never to the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions.datetime import week_start

CITY = "city"
# Sparse-series rule and hold-out length.
SPARSE_MEAN = 8.0
SPARSE_ZERO_SHARE = 0.20
TEST_WEEKS = 13
SEASON = 52


def weekly_counts(df: DataFrame, ts_col: str, zone_col: str, start: str | None = None) -> DataFrame:
    """G2 + B7: (zone, week_start, n) from one scan; the window filter is on the
    week start so a partial leading week never enters (decision Q1)."""
    ev = df.select(F.col(zone_col).alias("zone"), week_start(F.col(ts_col)).alias("week_start"))
    if start is not None:
        ev = ev.filter(F.col("week_start") >= F.lit(start).cast("date"))
    return ev.groupBy("zone", "week_start").agg(F.count(F.lit(1)).alias("n"))


def dense_series(counts: DataFrame, drop_last_week: bool = True) -> DataFrame:
    """J8 + W3: every series x every week between the first and last week (missing -> 0);
    the final, partial week is dropped once (decision Q2). City = sum over all zones."""
    zone_counts = counts.filter(F.col("zone").isNotNull()).select(
        F.col("zone").cast("string").alias("series_id"), "week_start", "n"
    )
    city_counts = counts.groupBy("week_start").agg(F.sum("n").alias("n")).select(
        F.lit(CITY).alias("series_id"), "week_start", "n"
    )
    all_counts = zone_counts.unionByName(city_counts)
    bounds = counts.agg(F.min("week_start").alias("lo"), F.max("week_start").alias("hi"))
    hi = F.date_sub(F.col("hi"), 7) if drop_last_week else F.col("hi")
    calendar = bounds.select(F.explode(F.sequence(F.col("lo"), hi, F.expr("INTERVAL 7 DAYS"))).alias("week_start"))
    keys = all_counts.select("series_id").distinct()
    # keys: one row per series; calendar: one row per week. Both are small by construction.
    grid = keys.crossJoin(F.broadcast(calendar))
    return grid.join(all_counts, ["series_id", "week_start"], "left").select(
        "series_id", "week_start", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("y")
    )


def split_train_test(series: DataFrame, test_weeks: int = TEST_WEEKS) -> DataFrame:
    """W4 + L5: the last ``test_weeks`` weeks of each series are 'test'."""
    w = Window.partitionBy("series_id").orderBy(F.desc("week_start"))
    return series.withColumn(
        "split", F.when(F.row_number().over(w) <= test_weeks, "test").otherwise("train")
    )


def series_stats(series: DataFrame) -> DataFrame:
    """N, range, mean, sample std, min, max, coefficient of variation."""
    return series.groupBy("series_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_weeks"),
        F.min("week_start").alias("first_week"),
        F.max("week_start").alias("last_week"),
        F.round(F.avg("y"), 4).alias("mean"),
        F.round(F.stddev_samp("y"), 4).alias("std"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.round(F.stddev_samp("y") / F.nullif(F.avg("y"), F.lit(0.0)), 4).alias("cv"),
    )


def lag_autocorr(series: DataFrame, lag: int = SEASON) -> DataFrame:
    """G21 + W7: corr(y, y lagged ``lag`` weeks); null unless the series has >= 2*lag weeks."""
    w = Window.partitionBy("series_id").orderBy("week_start")
    lagged = series.withColumn("_lag", F.lag("y", lag).over(w))
    return lagged.groupBy("series_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_weeks"),
        F.when(F.count(F.lit(1)) >= 2 * lag, F.round(F.corr("y", "_lag"), 4)).alias(f"autocorr_lag{lag}"),
    )


def classify_sparse(series: DataFrame) -> DataFrame:
    """F7 + F8 share: per zone mean/week, zero-week share, sparse flag and share of the city total."""
    zones = series.filter(F.col("series_id") != CITY)
    city_total = series.filter(F.col("series_id") == CITY).agg(F.sum("y").alias("city_total"))
    stats = zones.groupBy("series_id").agg(
        F.avg("y").alias("_mean"),
        F.avg((F.col("y") == 0).cast("double")).alias("_zero"),
        F.sum("y").alias("_sum"),
    )
    stats = stats.crossJoin(F.broadcast(city_total))  # one-row frame
    return stats.select(
        "series_id",
        F.round("_mean", 2).alias("mean_vol"),
        F.round("_zero", 4).alias("zero_pct"),
        ((F.col("_mean") < SPARSE_MEAN) | (F.col("_zero") > SPARSE_ZERO_SHARE)).alias("is_sparse"),
        F.round(
            F.when(F.col("city_total") > 0, F.col("_sum") / F.col("city_total")).otherwise(F.lit(0.0)), 4
        ).alias("prop_share"),
    )


def error_metrics(df: DataFrame, group: str, actual: str, pred: str) -> DataFrame:
    """MAE, RMSE and both MAPE policies (Q8): denominator clipped at 1 ('clip'),
    and positive-actual weeks only ('positive', null when there are none)."""
    e = F.col(actual) - F.col(pred)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("n_test"),
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(F.avg(F.abs(e) / F.greatest(F.col(actual), F.lit(1.0))) * 100.0, 4).alias("mape_clip"),
        F.round(
            F.avg(F.when(F.col(actual) > 0, F.abs(e) / F.col(actual))) * 100.0, 4
        ).alias("mape_positive"),
    )


def seasonal_naive(season: int = SEASON) -> Column:
    """Forecast = value one season earlier (a transparent benchmark model)."""
    return F.lag("y", season).over(Window.partitionBy("series_id").orderBy("week_start"))
