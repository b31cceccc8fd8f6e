"""Random draws from hashed keys: independent of partitioning, order and retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_RANGE = 1 << 32


def _part(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def draw_key(*parts) -> Column:
    """Integer in [0, 2^32) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *[_part(p) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def draw_unit(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return draw_key(*parts) / F.lit(float(KEY_RANGE))


def draw_int(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(draw_unit(*parts) * n).cast("long")
