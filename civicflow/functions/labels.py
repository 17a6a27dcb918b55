"""Flags, tiers and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response-tier thresholds relative to a benchmark median.
FAST_RATIO = 0.75
SLOW_RATIO = 1.5
# Elevation bands, left-closed bins in metres.
ELEVATION_BANDS = ((15.0, "Lowland"), (60.0, "Valley"), (150.0, "Hillside"))
ELEVATION_TOP_BAND = "Ridge"
# Valid elevation range (metres); outside -> null.
ELEVATION_MIN, ELEVATION_MAX = -10.0, 1000.0
# Confidence bands for a predicted class.
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.7, 0.4
# Minimum trimmed length of a usable description.
MIN_DESCRIPTION_CHARS = 5
KM_PER_DEGREE = 111.0


def status_binary(status: Column) -> Column:
    """1 when the status reads "closed" in any case, else 0 (null -> 0)."""
    return F.coalesce(F.lower(status) == F.lit("closed"), F.lit(False)).cast("int")


def usable_text(c: Column, min_chars: int = MIN_DESCRIPTION_CHARS) -> Column:
    """B5/S7 predicate: not null and trimmed length above ``min_chars``."""
    return F.coalesce(F.length(F.trim(c)) > min_chars, F.lit(False))


def has_description(c: Column) -> Column:
    """Usable-text predicate as 0/1."""
    return usable_text(c).cast("int")


def presence_flag(c: Column) -> Column:
    """1 when a value is present."""
    return c.isNotNull().cast("int")


def response_tier(median: Column, benchmark: Column) -> Column:
    """FAST / SLOW / AVERAGE; a null median falls through to AVERAGE."""
    return (
        F.when(median < benchmark * FAST_RATIO, "FAST")
        .when(median > benchmark * SLOW_RATIO, "SLOW")
        .otherwise("AVERAGE")
    )


def gap_flag(median: Column, benchmark: Column) -> Column:
    """SLOW / FAST / '' (slow is tested first)."""
    return (
        F.when(median > benchmark * SLOW_RATIO, "SLOW")
        .when(median < benchmark * FAST_RATIO, "FAST")
        .otherwise("")
    )


def confidence_band(p: Column) -> Column:
    """S21."""
    return F.when(p >= CONFIDENCE_HIGH, "High").when(p >= CONFIDENCE_MEDIUM, "Medium").otherwise("Low")


def elevation_band(elev: Column) -> Column:
    """Left-closed bins; null stays null."""
    expr = None
    for upper, name in ELEVATION_BANDS:
        expr = F.when(elev < upper, name) if expr is None else expr.when(elev < upper, name)
    return F.when(elev.isNull(), F.lit(None)).otherwise(expr.otherwise(ELEVATION_TOP_BAND))


def valid_elevation(v: Column, nodata: Column | float | None = None) -> Column:
    """Nodata and out-of-range values -> null."""
    bad = (v < ELEVATION_MIN) | (v > ELEVATION_MAX) | F.isnan(v)
    if nodata is not None:
        bad = bad | (v == (nodata if isinstance(nodata, Column) else F.lit(nodata)))
    return F.when(bad, F.lit(None).cast("double")).otherwise(v.cast("double"))


def negative_to_null(c: Column) -> Column:
    """Negative census sentinels (e.g. -666666666) -> null."""
    return F.when(c < 0, F.lit(None)).otherwise(c)


def geoid(state: Column, county: Column, tract: Column) -> Column:
    """Zero-padded state(2) + county(3) + tract(6)."""
    return F.concat(
        F.lpad(state.cast("string"), 2, "0"),
        F.lpad(county.cast("string"), 3, "0"),
        F.lpad(tract.cast("string"), 6, "0"),
    )


def bbox_around(lat: Column, lon: Column, buffer_km: float) -> dict[str, Column]:
    """Degree box of +-buffer_km around a point (111 km/deg, cos(lat) for longitude)."""
    dlat = F.lit(buffer_km / KM_PER_DEGREE)
    dlon = F.lit(buffer_km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return {
        "min_lat": lat - dlat,
        "max_lat": lat + dlat,
        "min_lon": lon - dlon,
        "max_lon": lon + dlon,
    }


def min_max_scale(c: Column, lo: Column, hi: Column, out_lo: float = 12.0, out_hi: float = 48.0) -> Column:
    """Min-max normalise with a 1e-9 guard onto [out_lo, out_hi]."""
    return F.lit(out_lo) + (c - lo) / (hi - lo + F.lit(1e-9)) * F.lit(out_hi - out_lo)
