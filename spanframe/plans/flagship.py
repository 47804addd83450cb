"""Budgeted evidence recovery on documents, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.rounding import round_double
from spanframe.operators import budget, intervals, sequence, spans
from spanframe.plans.views import table
from spanframe.session import read_tasks

TILE = 64
RULES = ["the ", " and ", "License", "@"]
SEED = "tiles-v1"


def scored_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Document tiles with entropy, boundary score and evidence."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tiles = sequence.tile_entropy(docs, "doc_id", "text", TILE).select(
        "sample_id", "tile", F.col("n_units").alias("tile_len"), round_double("entropy", 9).alias("entropy")
    )
    found = intervals.merge_bounded(spans.literal_spans(docs, "doc_id", "text", RULES), ["sample_id"])
    out = budget.evidence_tiles(tiles, found, TILE, 8 * read_tasks(docs))
    out = sequence.boundary_score(out).withColumn("boundary", round_double("boundary", 9))
    return out.withColumn("stratum", F.when(F.col("n_units") > 4096, "long").otherwise("short"))


def evaluation(spark: SparkSession, sf: str, budgets=budget.BUDGETS) -> DataFrame:
    """Metrics per (sample, stratum, selector, budget)."""
    ranked = budget.rank_selectors(scored_tiles(spark, sf), SEED)
    return budget.grid_metrics(ranked, ["stratum"], budgets)


def evidence_by_selector(spark: SparkSession, sf: str) -> DataFrame:
    """Mean coverage per stratum, selector and budget."""
    return evaluation(spark, sf).groupBy("stratum", "selector", "budget").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("has_evidence").cast("bigint")).alias("n_with_evidence"),
        round_double(F.avg("coverage"), 9).alias("mean_coverage"), round_double(F.avg("byte_iou"), 9).alias("mean_byte_iou"),
        round_double(F.avg("interval_recall_50"), 9).alias("mean_interval_recall"),
    )
