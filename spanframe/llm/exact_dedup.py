"""Exact deduplication as a stateful stream.

Every row of the source passes one structured stream. Its state lives in RocksDB on
disk, is keyed by the digest of the normalised text, has no expiry, and holds the
largest identifier with the locator of its content (file and row) and a count. Hits
are then held against full bytes: of digests seen more than once the smallest and the
largest text must agree, which combines map-side, so no group of copies meets in one
task. Should two texts ever share a digest, its rows are grouped by whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import lower_ascii, may_match
from spanframe.llm.registry import query
from spanframe.session import durable, scratch_path

#: State on disk, without files sized in advance: there is a store for every shuffle partition.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prepared(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, text normalised, locator, key) of each row; a null text counts as empty."""
    rows = df.select(
        F.col(id_col).alias("id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )
    return rows.withColumn("key", digest(F.col("norm")))


def keyed_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest, files_per_batch: int | None, folder: str) -> DataFrame:
    """Run the stream over all files and return the last state of each key: (key, best, n)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern, the path of a single file is accepted like that of a folder
    stream = prepared(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest).groupBy("key").agg(
        F.max(F.struct("id", "at")).alias("best"), F.count(F.lit(1)).alias("n")
    )

    def keep(changed: DataFrame, batch_id: int) -> None:
        # replayed batches overwrite their own folder
        changed.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        run = (
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    updates = spark.read.schema("key string, best struct<id: bigint, at: struct<file: string, row: bigint>>, n bigint, batch_id bigint").parquet(f"{folder}/state")
    return updates.groupBy("key").agg(F.max_by(F.struct("best", "n"), "batch_id").alias("s")).select("key", "s.best", "s.n")


def stream_dedup(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_text, files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of the parquet table at ``path``: id, keep_id, group_size, kept, text_sha256.

    Equal texts (A-Z lower-cased, null as empty) form a group. The row of the largest id
    stays; of rows that repeat the same id and text the last by (file, row) stays, so
    exactly one row of a group is kept. A null id is smaller than any other; a group of
    null ids only keeps one of them with a null keep_id. Identifiers are whole numbers.
    An empty table gives no rows. Other columns are not read. ``files_per_batch`` bounds
    a micro-batch; a killed run goes on from its checkpoint.
    """
    folder = scratch_path(spark, "exact-dedup")
    source = spark.read.parquet(path)
    if not source.inputFiles() or source.limit(1).isEmpty():
        return spark.createDataFrame([], f"{id_col} bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string")
    state = keyed_state(spark, path, id_col, text_col, digest, files_per_batch, folder)
    rows = prepared(source, id_col, text_col, digest)
    hits = state.filter("n > 1").select("key")
    # inner joins with unique keys: a semi join would be moved below the prefilter
    seen = may_match(rows.select("key", "norm"), "key", hits, "key").join(hits, "key")
    clash = seen.groupBy("key").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("key")
    clash = durable(clash)  # no rows unless two texts share a digest
    same = rows.select("id", "at", "key", sha256_text(F.col("norm")).alias("sha")).join(clash, "key", "left_anti").join(state, "key")
    odd = may_match(rows, "key", clash, "key").join(clash, "key")
    w = Window.partitionBy("norm")
    odd = odd.select(
        "id", "at", "key", sha256_text(F.col("norm")).alias("sha"),
        F.max(F.struct("id", "at")).over(w).alias("best"), F.count(F.lit(1)).over(w).alias("n"),
    )
    cols = ["id", "at", "sha", "best", "n"]
    return same.select(*cols).unionByName(odd.select(*cols)).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.at") == F.col("at"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


@query("op3_exact_dedup", """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
window w as (partition by t)
""")
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return stream_dedup(spark, f"{sf}/documents.parquet")
