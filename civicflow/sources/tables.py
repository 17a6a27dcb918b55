"""Parquet table access.

Reads go through ``spark.read.parquet`` so Catalyst prunes columns and pushes
filters into the scan; callers should select only what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    A table landed as a single Parquet row group is read by one task, which would
    serialise every narrow stage after it (tokenising, exploding, partial
    aggregation). Only then is the scan repartitioned; a production layout with
    many files / row groups already has more partitions than cores and is left
    untouched (no extra shuffle)."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file under a path, in order."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf).listFiles(target, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """The files that are stored under the tables' paths. A result kept for a session is kept
    under this key, so rewritten input gives a new one."""
    return tuple(f for name in names for f in files_of(spark, table_path(sf_dir, name)))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
