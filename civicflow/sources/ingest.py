"""Ingest run: each dataset is written once, its figures observed on the writing pass.

``DataFrame.observe`` counts the rows, the rows that cleaning drops and the date range while
the data is written, so no dataset is scanned a second time for its report. A dataset whose
reading or writing fails becomes a row of the report with its error; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = (
    "dataset string, source string, status string, n_rows long, n_dropped long, n_columns int, "
    "min_date date, max_date date, error string, message string, ingested_at timestamp, path string"
)


@dataclass(frozen=True)
class Dataset:
    """``read`` gives the rows as landed; ``clean`` (if any) the rows to write; rows of the
    former for which ``drops`` holds are counted as dropped; ``date`` names the written column
    of the date range."""

    read: Callable[[], DataFrame]
    source: str
    clean: Callable[[DataFrame], DataFrame] | None = None
    drops: Column | None = None
    date: str | None = None


def _write(name: str, dataset: Dataset, path: str) -> dict:
    landed, rows = Observation(f"{name} landed"), Observation(f"{name} written")
    df = dataset.read()
    if dataset.drops is not None:
        df = df.observe(landed, F.count_if(dataset.drops).alias("n_dropped"))
    if dataset.clean is not None:
        df = dataset.clean(df)
    day = F.col(dataset.date).cast("date") if dataset.date else F.lit(None).cast("date")
    df = df.observe(
        rows, F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("min_date"), F.max(day).alias("max_date")
    )
    df.write.mode("overwrite").parquet(path)
    figures = dict(rows.get)
    figures["n_dropped"] = landed.get["n_dropped"] if dataset.drops is not None else 0
    figures["columns"] = df.columns
    return figures


def ingest(spark: SparkSession, datasets: dict[str, Dataset], folder: str) -> DataFrame:
    """Write every dataset as Parquet under ``folder``/name, its sidecar as JSON under
    ``folder``/name_metadata, and return the report: one row per dataset.

    Status: ``success``; ``failed`` for a dataset without rows (it is written all the same);
    ``error`` with the error's class and first line where reading or writing raised a Spark error.
    Other exceptions (a programming fault in ``clean``) are not caught."""
    report = []
    for name, dataset in datasets.items():
        path, at = f"{folder}/{name}", datetime.now(timezone.utc)
        try:
            f = _write(name, dataset, path)
        except PySparkException as exc:
            cause = exc.getCondition() or type(exc).__name__
            report.append((name, dataset.source, "error", None, None, None, None, None, cause,
                           str(exc).splitlines()[0], at, None))
            continue
        empty = f["n_rows"] == 0
        report.append((name, dataset.source, "failed" if empty else "success", f["n_rows"], f["n_dropped"],
                       len(f["columns"]), f["min_date"], f["max_date"], None,
                       "returned no data" if empty else None, at, path))
        _write_sidecar(spark, dataset.source, f, at, f"{path}_metadata")
    return spark.createDataFrame(report, REPORT_SCHEMA)  # one row a dataset


def _write_sidecar(spark: SparkSession, source: str, f: dict, at: datetime, path: str) -> None:
    def text(d: date | None) -> str | None:
        return d.isoformat() if d else None

    row = (source, f["n_rows"], f["columns"], (text(f["min_date"]), text(f["max_date"])), at.isoformat())
    schema = ("source string, records long, columns array<string>, date_range struct<start: string, end: string>, "
              "ingestion_timestamp string")
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)
