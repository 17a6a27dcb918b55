"""Shared helpers of the training-data operators: shipping, staging, links to components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.session import scratch_path
from civicflow.sources.tables import table_path

_shipped: set[str] = set()
#: Set where the session leaves them unset: a batch of long texts is bounded by its bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application); bound Arrow batches."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="civicflow-ship-"), "civicflow_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "civicflow")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def staging_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the driver ends."""
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def clean() -> None:
        if spark.sparkContext._jsc is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)

    atexit.register(clean)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: what is read
    twice is computed once, and a lost executor costs a re-read, not a re-run."""
    path = staging_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batched(run):
    """``run`` for mapInArrow; at the end of a task the Arrow pool and the C heap give their
    free pages back, so that an idle worker does not keep the task's peak."""
    def with_release(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return with_release


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def without_clash(df: DataFrame, work) -> DataFrame:
    """``work(df)``, which returns rows of ``df`` with its columns; those that start with
    ``__``, as the names of helpers do, have other names meanwhile."""
    prefix = "kept"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    inner = [f"{prefix}{i}" if c.startswith("__") else c for i, c in enumerate(df.columns)]
    done = work(df.toDF(*inner))
    own = len(inner)
    return done.toDF(*df.columns, *done.columns[own:])


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (staged, narrow rows) with a broadcast hint if it has at most ``rows`` rows;
    beyond that the join is left to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` (longs) -> ``(node, component)`` for every node with an edge,
    ``component`` the smallest node reachable.

    Alternating large-star and small-star steps: each is one grouped minimum and one
    join on the node, so a hub of any degree is combined map-side (the minimum) and
    its join side is split by AQE. Each round is written to the shared folder. It stops when
    a round changes nothing; the driver sees only one checksum per round."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else (
            e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.join(low, "a")
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    current = staged(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"),
                                                  F.least("a", "b").cast("long").alias("b")).distinct(), name)
    mark = None
    while True:
        current = staged(star(star(current, True), False), name)
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
