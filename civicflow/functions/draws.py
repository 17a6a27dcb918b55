"""Counter-based pseudo-random draws that any engine can repeat.

A draw is a function of its keys (row, path, step, ...) and a seed, not of a generator's state: it does
not depend on partitions, order or engine, and a repeated task draws the same. It is the first 60
bits of an MD5 digest, which Spark and SQL engines share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15  # hexadecimal: 60 bits, a non-negative long
SPAN = 1 << (4 * DIGITS)


def draw(seed: int, *keys: Column) -> Column:
    """A long in [0, 2^60) for the keys."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def draw_sql(seed: int, *keys: str) -> str:
    """The same draw in SQL."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {text}, '{seed}')), 1, {DIGITS})) AS BIGINT)"
