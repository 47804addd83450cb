"""Keyed-hash randomness: every draw is a function of (seed, key), so it does not
depend on partitioning, task order or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_hex(seed: str | int, *keys) -> Column:
    """64 hex digits of sha256(``seed|key|...``)."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]), 256)


def hex_number(hex_col: Column, digits: int) -> Column:
    """Unsigned value of the first ``digits`` (at most 15) hex digits."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def unit_draw(seed: str | int, *keys) -> Column:
    """Uniform draw in [0, 1) with 52 bits."""
    return hex_number(hash_hex(seed, *keys), 13).cast("double") / F.lit(float(2**52))


def index_draw(n, seed: str | int, *keys) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hex_number(hash_hex(seed, *keys), 13), _c(n).cast("bigint"))


# 8-digit hex thresholds of the Poisson(1) distribution function,
# floor(cdf(k) * 2^32) for k = 0..9.
POISSON_ONE = (
    "5e2d58d8", "bc5ab1b1", "eb715e1d", "fb239796", "ff1025f5",
    "ffd90f3b", "fffa8b72", "ffff541e", "ffffed34", "fffffe1c",
)


def poisson_weight(hex_digits: Column) -> Column:
    """Poisson(1) weight from 8 hex digits: the number of thresholds not above them.

    Lower-case hex of equal length compares like the number it spells, so no
    conversion is needed.
    """
    weight = F.lit(len(POISSON_ONE))
    for count, threshold in reversed(list(enumerate(POISSON_ONE))):
        weight = F.when(hex_digits < F.lit(threshold), F.lit(count)).otherwise(weight)
    return weight


def positive_weight(hex_digits: Column) -> Column:
    """Is the Poisson(1) weight above zero?"""
    return hex_digits >= F.lit(POISSON_ONE[0])
