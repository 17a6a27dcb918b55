"""Registered request-table queries: cleaning and zone / category profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import datetime as dt
from civicflow.operators import clean, profile
from civicflow.plans.standins import CLEAN_REQUESTS_SQL, RAW_REQUESTS_SQL, raw_requests
from civicflow.sources.tables import read_table


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_requests(raw_requests(spark, sf_dir))


def q_clean_requests(spark, sf_dir):
    return cleaned(spark, sf_dir)


def q_calendar_features(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    ts = F.col("o_orderdate")
    return orders.select(
        "o_orderkey",
        *[c.alias(n) for n, c in dt.calendar_features(ts).items()],
        dt.week_start(ts).alias("week_start"),
    )


def q_zone_performance(spark, sf_dir):
    return profile.zone_performance(cleaned(spark, sf_dir))


def q_zone_summary(spark, sf_dir):
    return profile.zone_summary(cleaned(spark, sf_dir))


def q_category_gap(spark, sf_dir):
    return profile.category_gap(cleaned(spark, sf_dir))


def q_gap_table(spark, sf_dir):
    return profile.gap_table(profile.category_gap(cleaned(spark, sf_dir)))


def q_gap_pivot(spark, sf_dir):
    return profile.gap_pivot(profile.category_gap(cleaned(spark, sf_dir)))


def q_category_topn(spark, sf_dir):
    return profile.top_categories(cleaned(spark, sf_dir), 3).select(
        "category_short", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank")
    )


def q_zone_distribution(spark, sf_dir):
    return profile.zone_distribution(cleaned(spark, sf_dir))


def q_dropped_coordinates(spark, sf_dir):
    return clean.dropped_missing_coordinates(raw_requests(spark, sf_dir))


QUERIES = {
    "clean_requests": q_clean_requests,
    "calendar_features": q_calendar_features,
    "zone_performance": q_zone_performance,
    "zone_summary": q_zone_summary,
    "category_gap": q_category_gap,
    "gap_table": q_gap_table,
    "gap_pivot": q_gap_pivot,
    "category_topn": q_category_topn,
    "zone_distribution": q_zone_distribution,
    "dropped_coordinates": q_dropped_coordinates,
}

_CLEAN = f"({CLEAN_REQUESTS_SQL})"

_ZONE_PERF = f"""
WITH r AS (SELECT * FROM {_CLEAN} c WHERE cluster IS NOT NULL),
closed AS (SELECT * FROM r WHERE resolution_days IS NOT NULL),
cm AS (SELECT median(resolution_days) AS city_median FROM closed),
perf AS (
  SELECT cluster, count(*) AS n_total, count(resolution_days) AS n_closed,
         median(resolution_days) AS m, avg(resolution_days) AS a,
         count(*) FILTER (WHERE resolution_days > 7) AS o7,
         count(*) FILTER (WHERE resolution_days > 30) AS o30,
         count(*) FILTER (WHERE resolution_days > 90) AS o90,
         avg(lat) AS la, avg(long) AS lo
  FROM r GROUP BY cluster),
top AS (
  SELECT cluster, category_short AS top_category FROM (
    SELECT cluster, category_short, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category_short) AS rn
    FROM r WHERE category_short IS NOT NULL GROUP BY cluster, category_short) t WHERE rn = 1),
slow AS (
  SELECT cluster, category_short AS slowest_category, round(m, 4) AS slowest_cat_median_days FROM (
    SELECT cluster, category_short, median(resolution_days) AS m,
           row_number() OVER (PARTITION BY cluster ORDER BY median(resolution_days) DESC, category_short) AS rn
    FROM closed WHERE category_short IS NOT NULL GROUP BY cluster, category_short) t WHERE rn = 1)
SELECT p.cluster, CAST(n_total AS BIGINT) AS n_total, CAST(n_closed AS BIGINT) AS n_closed,
       round(n_closed / nullif(n_total, 0) * 100.0, 1) AS pct_closed,
       round(m, 2) AS median_days, round(a, 2) AS mean_days,
       round(o7 / nullif(n_closed, 0) * 100.0, 1) AS pct_over_7d,
       round(o30 / nullif(n_closed, 0) * 100.0, 1) AS pct_over_30d,
       round(o90 / nullif(n_closed, 0) * 100.0, 1) AS pct_over_90d,
       round(la, 6) AS lat_centroid, round(lo, 6) AS lon_centroid,
       CASE WHEN round(m, 2) < city_median * 0.75 THEN 'FAST'
            WHEN round(m, 2) > city_median * 1.5 THEN 'SLOW' ELSE 'AVERAGE' END AS response_tier,
       top_category, slowest_category, slowest_cat_median_days
FROM perf p CROSS JOIN cm LEFT JOIN top USING (cluster) LEFT JOIN slow USING (cluster)
"""

_CATEGORY_GAP = f"""
WITH r AS (SELECT * FROM {_CLEAN} c),
topn AS (SELECT category_short FROM (
    SELECT category_short, row_number() OVER (ORDER BY count(*) DESC, category_short) AS rk
    FROM r WHERE category_short IS NOT NULL GROUP BY category_short) t WHERE rk <= 5),
closed AS (SELECT * FROM r WHERE resolution_days IS NOT NULL AND cluster IS NOT NULL
           AND category_short IN (SELECT category_short FROM topn)),
city AS (SELECT category_short, median(resolution_days) AS cmed FROM closed GROUP BY category_short),
z AS (SELECT cluster, category_short, count(resolution_days) AS n_closed, median(resolution_days) AS m,
             avg(resolution_days) AS a,
             count(*) FILTER (WHERE resolution_days > 30) / count(resolution_days) * 100.0 AS o30
      FROM closed GROUP BY cluster, category_short)
SELECT cluster, category_short, CAST(n_closed AS BIGINT) AS n_closed, round(m, 2) AS median_days,
       round(a, 2) AS mean_days, round(o30, 2) AS pct_over_30d, round(cmed, 4) AS city_median_days,
       round(round(m, 2) - cmed, 2) AS days_vs_city_median,
       CASE WHEN round(m, 2) > cmed * 1.5 THEN 'SLOW' WHEN round(m, 2) < cmed * 0.75 THEN 'FAST' ELSE '' END AS gap_flag
FROM z JOIN city USING (category_short)
"""

ORACLE = {
    "clean_requests": f"SELECT * FROM {_CLEAN} c",
    "calendar_features": """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS requested_date,
       CAST(year(o_orderdate) AS INTEGER) AS requested_year, CAST(month(o_orderdate) AS INTEGER) AS requested_month,
       CAST(weekofyear(o_orderdate) AS INTEGER) AS requested_week, dayname(o_orderdate) AS requested_day_of_week,
       CAST(hour(o_orderdate) AS INTEGER) AS requested_hour,
       CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start
FROM orders""",
    "zone_performance": _ZONE_PERF,
    "zone_summary": f"""
WITH r AS (SELECT * FROM {_CLEAN} c WHERE cluster IS NOT NULL),
a AS (SELECT cluster, count(*) AS cnt, round(avg(lat), 6) AS lat_centroid, round(avg(long), 6) AS lon_centroid
      FROM r GROUP BY cluster),
top AS (
  SELECT cluster, category_short AS top_category FROM (
    SELECT cluster, category_short, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category_short) AS rn
    FROM r WHERE category_short IS NOT NULL GROUP BY cluster, category_short) t WHERE rn = 1)
SELECT cluster, CAST(cnt AS BIGINT) AS "count", lat_centroid, lon_centroid,
       round(cnt / sum(cnt) OVER () * 100.0, 1) AS pct_of_total, top_category
FROM a LEFT JOIN top USING (cluster)""",
    "category_gap": _CATEGORY_GAP,
    "gap_table": f"SELECT * FROM ({_CATEGORY_GAP}) g WHERE gap_flag <> ''",
    "gap_pivot": f"""
SELECT category_short,
       round(avg(days_vs_city_median) FILTER (WHERE cluster = 1), 1) AS z1,
       round(avg(days_vs_city_median) FILTER (WHERE cluster = 2), 1) AS z2,
       round(avg(days_vs_city_median) FILTER (WHERE cluster = 3), 1) AS z3,
       round(avg(days_vs_city_median) FILTER (WHERE cluster = 4), 1) AS z4,
       round(avg(days_vs_city_median) FILTER (WHERE cluster = 5), 1) AS z5
FROM ({_CATEGORY_GAP}) g GROUP BY category_short""",
    "category_topn": f"""
SELECT category_short, n, rank FROM (
  SELECT category_short, CAST(count(*) AS BIGINT) AS n,
         CAST(row_number() OVER (ORDER BY count(*) DESC, category_short) AS BIGINT) AS rank
  FROM {_CLEAN} c WHERE category_short IS NOT NULL GROUP BY category_short) t WHERE rank <= 3""",
    "zone_distribution": f"""
SELECT cluster, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER () * 100.0, 2) AS pct
FROM {_CLEAN} c WHERE cluster IS NOT NULL GROUP BY cluster""",
    "dropped_coordinates": f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE lat IS NULL OR long IS NULL) AS BIGINT) AS n_dropped
FROM ({RAW_REQUESTS_SQL}) raw""",
}
