"""Registered weekly-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.operators import series as S
from civicflow.plans.standins import SERIES_START, ZONE_ORDERS_SQL, zone_orders
from civicflow.sources.tables import state


_SERIES: dict = {}


def dense(spark, sf_dir, zone: str = "cluster"):
    """Dense weekly order series per zone (region by default, or nation) plus the city.

    This is the stage boundary between request data and the forecasting stage (the
    reference writes it to a file): it is checkpointed once per session and state of
    the tables into the shared checkpoint dir, and every forecasting query reads it."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""),
           state(spark, sf_dir, "orders", "customer", "nation"), zone)
    if key not in _SERIES:
        counts = S.weekly_counts(zone_orders(spark, sf_dir), "requested_datetime", zone, SERIES_START)
        _SERIES[key] = S.dense_series(counts).checkpoint()
    return _SERIES[key]


def q_weekly_series_dense(spark, sf_dir):
    return dense(spark, sf_dir)


def q_train_test_split(spark, sf_dir):
    return S.split_train_test(dense(spark, sf_dir))


def q_series_stats(spark, sf_dir):
    return S.series_stats(dense(spark, sf_dir))


def q_autocorr_lag52(spark, sf_dir):
    return S.lag_autocorr(dense(spark, sf_dir))


def q_sparse_classification(spark, sf_dir):
    return S.classify_sparse(dense(spark, sf_dir, "nation_zone"))


def q_error_metrics(spark, sf_dir):
    """Hold-out errors of the seasonal-naive benchmark, both MAPE policies."""
    split = S.split_train_test(dense(spark, sf_dir)).withColumn("pred", S.seasonal_naive())
    return S.error_metrics(split.filter(F.col("split") == "test"), "series_id", "y", "pred")


QUERIES = {
    "weekly_series_dense": q_weekly_series_dense,
    "train_test_split": q_train_test_split,
    "series_stats": q_series_stats,
    "autocorr_lag52": q_autocorr_lag52,
    "sparse_classification": q_sparse_classification,
    "error_metrics": q_error_metrics,
}

def dense_sql(zone: str = "cluster") -> str:
    return f"""
WITH ev AS (SELECT {zone} AS zone, CAST(date_trunc('week', requested_datetime) AS DATE) AS week_start
            FROM ({ZONE_ORDERS_SQL}) z),
agg AS (SELECT zone, week_start, count(*) AS n FROM ev WHERE week_start >= DATE '{SERIES_START}' GROUP BY ALL),
b AS (SELECT min(week_start) AS lo, max(week_start) AS hi FROM agg),
cal AS (SELECT CAST(unnest(generate_series(lo, hi - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS DATE) AS week_start FROM b),
cnt AS (SELECT CAST(zone AS VARCHAR) AS series_id, week_start, n FROM agg WHERE zone IS NOT NULL
        UNION ALL SELECT 'city', week_start, sum(n) FROM agg GROUP BY week_start),
keys AS (SELECT DISTINCT series_id FROM cnt)
SELECT k.series_id, c.week_start, CAST(coalesce(cnt.n, 0) AS DOUBLE) AS y
FROM keys k CROSS JOIN cal c LEFT JOIN cnt ON cnt.series_id = k.series_id AND cnt.week_start = c.week_start
"""


DENSE_SQL = dense_sql()
NATION_DENSE_SQL = dense_sql("nation_zone")

SPLIT_SQL = f"""
SELECT series_id, week_start, y,
       CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) <= 13 THEN 'test'
            ELSE 'train' END AS split
FROM ({DENSE_SQL}) d
"""

ORACLE = {
    "weekly_series_dense": DENSE_SQL,
    "train_test_split": SPLIT_SQL,
    "series_stats": f"""
SELECT series_id, CAST(count(*) AS BIGINT) AS n_weeks, min(week_start) AS first_week, max(week_start) AS last_week,
       round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, min(y) AS min, max(y) AS max,
       round(stddev_samp(y) / nullif(avg(y), 0), 4) AS cv
FROM ({DENSE_SQL}) d GROUP BY series_id""",
    "autocorr_lag52": f"""
SELECT series_id, CAST(count(*) AS BIGINT) AS n_weeks,
       CASE WHEN count(*) >= 104 THEN round(corr(y, lg), 4) END AS autocorr_lag52
FROM (SELECT *, lag(y, 52) OVER (PARTITION BY series_id ORDER BY week_start) AS lg FROM ({DENSE_SQL}) d) t
GROUP BY series_id""",
    "sparse_classification": f"""
WITH d AS ({NATION_DENSE_SQL}),
ct AS (SELECT sum(y) AS city_total FROM d WHERE series_id = 'city'),
z AS (SELECT series_id, avg(y) AS m, avg(CAST(y = 0 AS DOUBLE)) AS zp, sum(y) AS s FROM d
      WHERE series_id <> 'city' GROUP BY series_id)
SELECT series_id, round(m, 2) AS mean_vol, round(zp, 4) AS zero_pct, (m < 8 OR zp > 0.2) AS is_sparse,
       round(CASE WHEN city_total > 0 THEN s / city_total ELSE 0.0 END, 4) AS prop_share
FROM z CROSS JOIN ct""",
    "error_metrics": f"""
SELECT series_id, CAST(count(*) AS BIGINT) AS n_test,
       round(avg(abs(y - pred)), 4) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse,
       round(avg(abs(y - pred) / greatest(y, 1.0)) * 100.0, 4) AS mape_clip,
       round(avg(CASE WHEN y > 0 THEN abs(y - pred) / y END) * 100.0, 4) AS mape_positive
FROM (SELECT *, lag(y, 52) OVER (PARTITION BY series_id ORDER BY week_start) AS pred FROM ({SPLIT_SQL}) s) t
WHERE split = 'test' GROUP BY series_id""",
}
