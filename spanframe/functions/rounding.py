"""Rounding as the SQL twins round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_double(c: Column | str, digits: int) -> Column:
    """Round half away from zero on the double itself: scaled up, to a whole number, scaled down.

    ``F.round`` rounds the shortest decimal that spells the double instead, so 41/5120, a hair under
    0.0080078125, goes up there and down here and in SQL.
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * scale) / scale
