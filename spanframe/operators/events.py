"""Run collapsing and sequence identity on event streams.

Rows of one process are split by a time bucket, so a process of any length spreads
over tasks; only one summary row per (process, bucket) is ordered per process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.hashing import hex_number


def collapse_runs(df: DataFrame, process: list[str], bucket: Column, order: list[str], value: str) -> DataFrame:
    """Drop rows that repeat the value before them; adds ``pos``, the 0-based place in the collapsed sequence.

    ``bucket`` must grow with the order. Rows of ignored kinds are filtered before, so a
    repeat is judged against the last kept row.
    """
    rows = df.withColumn("_bk", bucket)
    inside = Window.partitionBy(*process, "_bk").orderBy(*order)
    marked = rows.withColumn("_prev", F.lag(value).over(inside)).withColumn("_rn", F.row_number().over(inside))
    ends = rows.groupBy(*process, "_bk").agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_e"))
    across = Window.partitionBy(*process).orderBy("_bk")
    ends = ends.select(*process, "_bk", F.lag("_e._v").over(across).alias("_before"))
    joined = marked.join(ends, [*process, "_bk"])
    prev = F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_prev"))
    kept = joined.filter(~prev.eqNullSafe(F.col(value)))
    counts = kept.groupBy(*process, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(*process, "_bk", F.coalesce(F.sum("_c").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    placed = kept.join(counts, [*process, "_bk"]).withColumn("pos", F.row_number().over(inside) - 1 + F.col("_off"))
    return placed.drop("_bk", "_prev", "_rn", "_before", "_off")


def sequence_digest(collapsed: DataFrame, process: list[str], value: str) -> DataFrame:
    """Order-sensitive digest per process from position-tagged element hashes.

    Summing the lanes combines on the map side; no sequence is collected.
    """
    h = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), F.col(value).cast("string")), 256)
    lanes = [F.sum(hex_number(F.substring("_h", 1 + 15 * i, 15), 15).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(3)]
    agg = collapsed.withColumn("_h", h).groupBy(*process).agg(F.count(F.lit(1)).alias("length"), *lanes)
    return agg.select(*process, "length", F.sha2(F.concat_ws("|", "length", *[F.col(f"_s{i}").cast("string") for i in range(3)]), 256).alias("digest"))


def dedup_sequences(digests: DataFrame, scope: list[str], process: list[str]) -> DataFrame:
    """First process of every distinct sequence inside a scope."""
    return digests.groupBy(*scope, "digest").agg(
        F.min(F.struct(*process)).alias("_f"), F.count(F.lit(1)).alias("copies"), F.max("length").alias("length")
    ).select(*[F.col(f"_f.{p}").alias(p) for p in process], "length", "copies", "digest")


def sequence_profile(df: DataFrame, category: str, name: str, width: int = 16_384) -> DataFrame:
    """Characters per category, and how many a fixed-width canvas would cut or repeat."""
    n = F.col("n_chars")
    agg = df.groupBy(category).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.length(name)).alias("n_chars"))
    return agg.withColumn("truncated", F.greatest(n - width, F.lit(0))).withColumn("repeated", F.when(n > 0, F.greatest(width - n, F.lit(0))).otherwise(0))


def character_codes(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Code ``min(255, 256*ascii/128)`` per character, on demand."""
    return df.select(*key, F.posexplode(F.split(name, "")).alias("at", "ch")).withColumn(
        "code", F.least(F.lit(255), F.floor(F.ascii("ch") * 256 / 128)).cast("int")
    ).drop("ch")
