"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.session import scratch_path

SLOT_BITS = 22
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage like a checkpoint, compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def bounded_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes for the jobs started inside, so that long texts do
    not wait in memory by the thousand."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slot(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - SLOT_BITS)


def slot_marks(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Adds ``_marked``: does the key hash to a slot that some wanted key sets?

    Never false for a wanted key; may be true for others. What is broadcast is a bitmap of
    2^22 bits, at most 65,536 rows, whatever the size of the tables.
    """
    bits = wanted.select(slot(F.col(wanted_key)).alias("_s")).groupBy((F.shiftright("_s", 6)).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_bits")
    )
    near = rows.withColumn("_s", slot(F.col(key))).withColumn("_word", F.shiftright("_s", 6)).join(F.broadcast(bits), "_word", "left")
    on = F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_s & 63 as int)) & 1L) = 1L"), F.lit(False))
    return near.withColumn("_marked", on).drop("_word", "_s", "_bits")


def may_match(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows that ``slot_marks`` marks: a prefilter in front of an exact join, so that only
    likely rows are shuffled."""
    return slot_marks(rows, key, wanted, wanted_key).filter("_marked").drop("_marked")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
