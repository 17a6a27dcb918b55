"""Weather: station-day flags, daily aggregate, long->wide pivot, date join.

The daily table is keyed by date, so its size is bounded by the calendar
(~365 rows a year) regardless of how many stations report; that is what makes
it a safe broadcast side for the request join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions import labels

# Weather-type flag columns and the datatypes of the long form.
WT_COLUMNS = ("WT01", "WT02", "WT03", "WT08")
DATATYPES = ("PRCP", "TMAX", "TMIN", "AWND", "SNOW")


def station_day_flags(df: DataFrame) -> DataFrame:
    """Wind presence flag, precipitation null -> 0, weather-type flags collapsed
    to one severe flag (absent WT columns count as 0 -- decided from the schema)."""
    wt = [labels.presence_flag(F.col(c)) if c in df.columns else F.lit(0) for c in WT_COLUMNS]
    return df.select(
        F.to_date("DATE").alias("DATE"),
        F.col("TMAX").cast("double").alias("TMAX"),
        F.col("TMIN").cast("double").alias("TMIN"),
        F.coalesce(F.col("PRCP").cast("double"), F.lit(0.0)).alias("PRCP"),
        (labels.presence_flag(F.col("AWND")) if "AWND" in df.columns else F.lit(0)).alias("AWND_bool"),
        F.greatest(*wt).alias("severe_weather_event") if len(wt) > 1 else wt[0].alias("severe_weather_event"),
    )


def daily_weather(station_day: DataFrame) -> DataFrame:
    """G1: one row per date: mean TMAX/TMIN/PRCP, any-station wind and severe flags."""
    flagged = station_day_flags(station_day).filter(F.col("DATE").isNotNull())
    return flagged.groupBy("DATE").agg(
        F.avg("TMAX").alias("tmax_avg"),
        F.avg("TMIN").alias("tmin_avg"),
        F.avg("PRCP").alias("prcp_avg"),
        F.max("AWND_bool").alias("severe_wind"),
        F.max("severe_weather_event").alias("severe_weather_event"),
    )


def pivot_readings(long: DataFrame, datatypes=DATATYPES, order_col: str = "reading_id") -> DataFrame:
    """A5: (date, datatype, value) -> one row per date, one column per datatype.
    The value kept is the earliest reading of the day (deterministic 'first')."""
    return (
        long.filter(F.col("datatype").isin(*datatypes))
        .groupBy("date")
        .pivot("datatype", list(datatypes))
        .agg(F.min_by("value", order_col))
    )


def join_weather(requests: DataFrame, daily: DataFrame) -> DataFrame:
    """Every request kept; weather columns null for dates without a reading.
    ``daily`` is one row per calendar date (bounded), so it is broadcast."""
    dim = daily.withColumnRenamed("DATE", "requested_date")
    return requests.join(F.broadcast(dim), "requested_date", "left")


def weather_coverage(merged: DataFrame) -> DataFrame:
    """Rows and the percent that matched a weather date."""
    return merged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.col("tmax_avg").isNotNull().cast("double")) * 100.0, 4).alias("pct_with_weather"),
    )
