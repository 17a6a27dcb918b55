"""Dataset profiles: null counts, flag rates, run report.

Each profile is a single aggregate pass over the table (one partial + final
aggregation), then a tiny unpivot of the one-row result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column with its null count and null percent (one scan)."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n__{i}") for i, c in enumerate(columns)],
    )
    stack = ", ".join(f"'{c}', n__{i}" for i, c in enumerate(columns))
    long = counts.selectExpr("__n", f"stack({len(columns)}, {stack}) AS (column_name, n_null)")
    return long.select(
        "column_name",
        F.col("n_null").cast("long").alias("n_null"),
        F.round(F.col("n_null") / F.nullif(F.col("__n"), F.lit(0)) * 100.0, 4).alias("pct_null"),
    )


def request_profile(requests: DataFrame) -> DataFrame:
    """G11 + G13: rows, date range, distinct categories, description and closed rates."""
    return requests.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("requested_date").alias("min_date"),
        F.max("requested_date").alias("max_date"),
        F.count_distinct("category_short").alias("n_categories"),
        F.sum("has_description").cast("long").alias("n_with_description"),
        F.round(F.avg("has_description") * 100.0, 4).alias("pct_with_description"),
        F.sum("status_binary").cast("long").alias("n_closed"),
        F.round(F.avg("status_binary") * 100.0, 4).alias("pct_closed"),
    )


def run_report(datasets: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset (name, rows, columns) as a union of one-row aggregates."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("dataset"),
            F.lit("ok").alias("status"),
            "n_rows",
            F.lit(len(df.columns)).cast("int").alias("n_columns"),
        )
        for name, df in datasets.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def metadata_sidecar(df: DataFrame, date_col: str, source: str) -> DataFrame:
    """A10: records, column count, date range and the source id as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.min(date_col).alias("min_date"),
        F.max(date_col).alias("max_date"),
    ).select(
        F.lit(source).alias("source"),
        "records",
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
        "min_date",
        "max_date",
    )
