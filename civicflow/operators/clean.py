"""Request cleaning and enrichment.

``clean_requests`` is one narrow projection + filter: no shuffle, fully
code-generated, and the null-coordinate filter reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.functions import datetime as dt
from civicflow.functions import labels, text

# The contract column order of a cleaned request table.
ORDERED_COLUMNS = [
    "object_id", "service_request_id",
    "category", "category_short",
    "status", "status_binary",
    "requested_datetime", "requested_date",
    "requested_year", "requested_month", "requested_week",
    "requested_day_of_week", "requested_hour",
    "date_closed", "resolution_days",
    "lat", "long", "address", "zipcode", "district",
    "description", "has_description",
]
RENAMES = {"objectid": "object_id"}
OPTIONAL_STRING_COLUMNS = ("address", "zipcode", "district", "description")


def normalise_columns(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """B1: lower-case + strip names, then apply the rename map."""
    renames = RENAMES if renames is None else renames
    out = df.toDF(*[c.lower().strip() for c in df.columns])
    present = {k: v for k, v in renames.items() if k in out.columns}
    return out.withColumnsRenamed(present) if present else out


def _datetime(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    return dt.parse_datetime(F.col(name), df.schema[name].dataType)


def clean_requests(raw: DataFrame) -> DataFrame:
    """Raw request rows -> cleaned, enriched request rows (one pass, no shuffle)."""
    df = normalise_columns(raw)
    requested = _datetime(df, "requested_datetime")
    closed = dt.null_sentinel_date(_datetime(df, "date_closed"))

    cols: dict[str, Column] = {
        "requested_datetime": requested,
        "date_closed": closed,
    }
    if "updated_datetime" in df.columns:
        cols["updated_datetime"] = _datetime(df, "updated_datetime")
    for name in OPTIONAL_STRING_COLUMNS:
        if name not in df.columns:  # B10: availability-guarded projection
            cols[name] = F.lit(None).cast("string")
    df = df.withColumns(cols)

    enriched = {
        **dt.calendar_features(F.col("requested_datetime")),
        "resolution_days": dt.resolution_days(F.col("requested_datetime"), F.col("date_closed")),
        "category_short": text.shorten_category(F.col("category")),
        "status_binary": labels.status_binary(F.col("status")),
        "has_description": labels.has_description(F.col("description")),
    }
    df = df.withColumns(enriched)
    # Rows without coordinates are unusable for spatial work.
    df = df.filter(F.col("lat").isNotNull() & F.col("long").isNotNull())
    # B2: contract columns first, extras kept at the end.
    extras = [c for c in df.columns if c not in ORDERED_COLUMNS]
    return df.select(*ORDERED_COLUMNS, *extras)


def dropped_missing_coordinates(raw: DataFrame) -> DataFrame:
    """B3 report: rows before, rows dropped for missing lat/long (one aggregate pass)."""
    df = normalise_columns(raw)
    missing = F.col("lat").isNull() | F.col("long").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(missing).alias("n_dropped"),
    )


def in_bbox(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Strict inequalities, so (0, 0) sentinels and edge points fall out."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    return (lat > lat_lo) & (lat < lat_hi) & (lon > lon_lo) & (lon < lon_hi)


# The service-area box (lat_lo, lat_hi, lon_lo, lon_hi).
SERVICE_AREA = (37.85, 38.10, -122.65, -122.40)
