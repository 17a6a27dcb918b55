"""Registered streaming queries (availableNow runs over the landed tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.operators import classify as CL
from civicflow.plans import classify as PC
from civicflow.plans.weather import ORACLE as WEATHER_ORACLE
from civicflow.sources.tables import table_path
from civicflow.streaming import jobs

ORDERS_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")
LINEITEM_SCHEMA = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                   "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                   "l_linestatus string, l_shipdate timestamp_ntz")
CONV_SCHEMA = "conv_id long, turn long, role string, text string"


def _station_day(li):
    return li.select(
        F.col("l_suppkey").alias("STATION"), F.to_date("l_shipdate").alias("DATE"),
        F.col("l_quantity").alias("TMAX"), (F.col("l_discount") * 100.0).alias("TMIN"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 100.0).alias("PRCP"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") / 1000.0).alias("AWND"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("WT01"),
    )


def q_stream_weekly_counts(spark, sf_dir):
    """Orders per priority per Monday week."""
    return jobs.weekly_counts_stream(spark, table_path(sf_dir, "orders"), ORDERS_SCHEMA, "o_orderdate", "o_orderpriority")


def q_stream_station_daily(spark, sf_dir):
    return jobs.daily_station_stream(spark, table_path(sf_dir, "lineitem"), LINEITEM_SCHEMA, _station_day)


def q_stream_dedupe(spark, sf_dir):
    """Line items re-send their order; keep one record per order (its items ship within months)."""
    return jobs.dedupe_stream(spark, table_path(sf_dir, "lineitem"), LINEITEM_SCHEMA, "l_orderkey", "l_shipdate", "130 days")


def q_stream_scoring(spark, sf_dir):
    """T4: conversation turns arriving as a stream, scored by the fitted classifier (top class)."""
    _, model = PC.trained(spark, sf_dir)

    def score(batch):
        msgs = batch.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
        return CL.predict(model, CL.prepare(msgs, "text"), "msg_id").select("msg_id", "predicted", "confidence")

    path = table_path(sf_dir, "conversations")
    job = jobs.open_job(spark, "scoring", path, CONV_SCHEMA, model.lr.uid)
    return jobs.scoring_stream(spark, path, CONV_SCHEMA, score, "msg_id long, predicted string, confidence double", job)


QUERIES = {
    "stream_weekly_counts": q_stream_weekly_counts,
    "stream_station_daily": q_stream_station_daily,
    "stream_dedupe": q_stream_dedupe,
    "stream_scoring": q_stream_scoring,
}

ORACLE = {
    "stream_weekly_counts": """
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, o_orderpriority AS key, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY ALL""",
    "stream_station_daily": WEATHER_ORACLE["daily_station_agg"],
    "stream_dedupe": "SELECT DISTINCT l_orderkey FROM lineitem",
}
