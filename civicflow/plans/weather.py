"""Registered weather and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.operators import quality, weather
from civicflow.plans.requests import _CLEAN, cleaned
from civicflow.plans.standins import READINGS_LONG_SQL, STATION_DAY_SQL, readings_long, station_day


def q_daily_station_agg(spark, sf_dir):
    return weather.daily_weather(station_day(spark, sf_dir))


def q_station_pivot(spark, sf_dir):
    return weather.pivot_readings(readings_long(spark, sf_dir))


def merged(spark, sf_dir):
    return weather.join_weather(cleaned(spark, sf_dir), weather.daily_weather(station_day(spark, sf_dir)))


def q_weather_left_join(spark, sf_dir):
    return merged(spark, sf_dir).select(
        "object_id", "requested_date", "cluster", "tmax_avg", "tmin_avg", "prcp_avg", "severe_wind",
        "severe_weather_event",
    )


def q_join_coverage(spark, sf_dir):
    return weather.weather_coverage(merged(spark, sf_dir))


def q_null_profile(spark, sf_dir):
    return quality.null_profile(merged(spark, sf_dir))


def q_dataset_profile(spark, sf_dir):
    return quality.request_profile(cleaned(spark, sf_dir))


def q_run_report(spark, sf_dir):
    daily = weather.daily_weather(station_day(spark, sf_dir))
    return quality.run_report(
        {"requests": cleaned(spark, sf_dir), "weather": daily, "merged": merged(spark, sf_dir)}
    )


def q_metadata_sidecar(spark, sf_dir):
    return quality.metadata_sidecar(cleaned(spark, sf_dir), "requested_date", "requests")


QUERIES = {
    "daily_station_agg": q_daily_station_agg,
    "station_pivot": q_station_pivot,
    "weather_left_join": q_weather_left_join,
    "join_coverage": q_join_coverage,
    "null_profile": q_null_profile,
    "dataset_profile": q_dataset_profile,
    "run_report": q_run_report,
    "metadata_sidecar": q_metadata_sidecar,
}

_DAILY = f"""
SELECT DATE, avg(TMAX) AS tmax_avg, avg(TMIN) AS tmin_avg, avg(coalesce(PRCP, 0.0)) AS prcp_avg,
       max(CAST(AWND IS NOT NULL AS INTEGER)) AS severe_wind,
       max(greatest(CAST(WT01 IS NOT NULL AS INTEGER), 0, 0, 0)) AS severe_weather_event
FROM ({STATION_DAY_SQL}) s WHERE DATE IS NOT NULL GROUP BY DATE
"""

_MERGED = f"""
SELECT c.*, d.tmax_avg, d.tmin_avg, d.prcp_avg, d.severe_wind, d.severe_weather_event
FROM {_CLEAN} c LEFT JOIN ({_DAILY}) d ON c.requested_date = d.DATE
"""

_MERGED_COLUMNS = [
    "object_id", "service_request_id", "category", "category_short", "status", "status_binary",
    "requested_datetime", "requested_date", "requested_year", "requested_month", "requested_week",
    "requested_day_of_week", "requested_hour", "date_closed", "resolution_days", "lat", "long", "address",
    "zipcode", "district", "description", "has_description", "cluster", "tmax_avg", "tmin_avg", "prcp_avg",
    "severe_wind", "severe_weather_event",
]

_NULL_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE \"{c}\" IS NULL) AS BIGINT) AS n_null, "
    f"round(count(*) FILTER (WHERE \"{c}\" IS NULL) / nullif(count(*), 0) * 100.0, 4) AS pct_null FROM m"
    for c in _MERGED_COLUMNS
)

ORACLE = {
    "daily_station_agg": _DAILY,
    "station_pivot": f"""
SELECT date,
       arg_min(value, reading_id) FILTER (WHERE datatype = 'PRCP') AS PRCP,
       arg_min(value, reading_id) FILTER (WHERE datatype = 'TMAX') AS TMAX,
       arg_min(value, reading_id) FILTER (WHERE datatype = 'TMIN') AS TMIN,
       arg_min(value, reading_id) FILTER (WHERE datatype = 'AWND') AS AWND,
       arg_min(value, reading_id) FILTER (WHERE datatype = 'SNOW') AS SNOW
FROM ({READINGS_LONG_SQL}) r WHERE datatype IN ('PRCP', 'TMAX', 'TMIN', 'AWND', 'SNOW') GROUP BY date""",
    "weather_left_join": f"""
SELECT object_id, requested_date, cluster, tmax_avg, tmin_avg, prcp_avg, severe_wind, severe_weather_event
FROM ({_MERGED}) m""",
    "join_coverage": f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       round(avg(CAST(tmax_avg IS NOT NULL AS DOUBLE)) * 100.0, 4) AS pct_with_weather FROM ({_MERGED}) m""",
    "null_profile": f"WITH m AS ({_MERGED}) {_NULL_PROFILE}",
    "dataset_profile": f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, min(requested_date) AS min_date, max(requested_date) AS max_date,
       CAST(count(DISTINCT category_short) AS BIGINT) AS n_categories,
       CAST(sum(has_description) AS BIGINT) AS n_with_description,
       round(avg(has_description) * 100.0, 4) AS pct_with_description,
       CAST(sum(status_binary) AS BIGINT) AS n_closed, round(avg(status_binary) * 100.0, 4) AS pct_closed
FROM {_CLEAN} c""",
    "run_report": f"""
SELECT 'requests' AS dataset, 'ok' AS status, CAST(count(*) AS BIGINT) AS n_rows, 23 AS n_columns FROM {_CLEAN} c
UNION ALL SELECT 'weather', 'ok', CAST(count(*) AS BIGINT), 6 FROM ({_DAILY}) d
UNION ALL SELECT 'merged', 'ok', CAST(count(*) AS BIGINT), 28 FROM ({_MERGED}) m""",
    "metadata_sidecar": f"""
SELECT 'requests' AS source, CAST(count(*) AS BIGINT) AS records, 23 AS n_columns,
       '{",".join(_MERGED_COLUMNS[:23])}' AS columns,
       min(requested_date) AS min_date, max(requested_date) AS max_date FROM {_CLEAN} c""",
}
