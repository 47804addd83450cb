"""Resumable corpus ingestion: the stream checkpoint is the resume state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "sample_id bigint, content_hash string, n_units bigint, status string, duplicate_of bigint, batch bigint"


def judge_batch(batch: DataFrame, seen: DataFrame | None, wanted: DataFrame | None, min_units: int, batch_id: int) -> DataFrame:
    """Status per row: accepted, duplicate (with the row it repeats) or too_short.

    The first row of a content is found by a combinable minimum; content accepted in an
    earlier batch wins over it.
    """
    rows = batch if wanted is None else batch.join(wanted.select("sample_id"), "sample_id", "left_semi")
    rows = rows.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.sha2("content", 256).alias("content_hash"), F.length("content").cast("bigint").alias("n_units"))
    long = rows.filter(F.col("n_units") >= min_units)
    first = long.groupBy("content_hash").agg(F.min("sample_id").alias("_first"))
    if seen is not None:
        earlier = seen.filter("status = 'accepted'").select("content_hash", F.col("sample_id").alias("_old"))
        first = first.join(earlier, "content_hash", "left").select("content_hash", F.coalesce("_old", "_first").alias("_first"))
    judged = rows.join(first, "content_hash", "left")
    short = F.col("n_units") < min_units
    status = F.when(short, "too_short").when(F.col("sample_id") == F.col("_first"), "accepted").otherwise("duplicate")
    return judged.select(
        "sample_id", "content_hash", "n_units", status.alias("status"), F.when(status == "duplicate", F.col("_first")).alias("duplicate_of"), F.lit(batch_id).cast("bigint").alias("batch")
    )


def ingest_increment(stream: DataFrame, table_path: str, checkpoint: str, wanted: DataFrame | None = None, min_units: int = 1):
    """Start a query that judges each micro-batch against everything accepted before.

    A batch writes to its own folder in overwrite mode, so a replay after a failure
    replaces its own rows and nothing else.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id > 0:
            # earlier batches only: a replay does not see its own rows
            seen = spark.read.schema(f"{TABLE}, part bigint").parquet(table_path).filter(F.col("part") < batch_id)
        judge_batch(batch, seen, wanted, min_units, batch_id).write.mode("overwrite").parquet(f"{table_path}/part={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(table_path)
