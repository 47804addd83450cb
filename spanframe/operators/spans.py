"""Evidence spans found in content, and their union over sources."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import kernels
from spanframe.operators.intervals import normalize


def literal_spans(df: DataFrame, id_col: str, text_col: str, literals: list[str]) -> DataFrame:
    """``(sample_id, rule, lo, hi)`` of every literal occurrence, left to right without overlap.

    Positions come from the task that reads the row; neither text nor gaps are shuffled.
    """
    return regex_spans(df, id_col, text_col, {lit: re.escape(lit) for lit in literals})


def regex_spans(df: DataFrame, id_col: str, text_col: str, rules: dict[str, str]) -> DataFrame:
    """Every non-empty match of each pattern."""
    return df.select(F.col(id_col).cast("bigint").alias("sample_id"), F.col(text_col).alias("t")).mapInArrow(
        kernels.regex_span_batches(rules), "sample_id bigint, rule string, lo bigint, hi bigint"
    )


def span_summary(spans: DataFrame) -> DataFrame:
    """Rules hit and occurrence count per sample."""
    return spans.groupBy("sample_id").agg(
        F.count_distinct("rule").alias("n_rules"), F.count(F.lit(1)).alias("n_strings")
    )


def union_sources(sources: dict[str, DataFrame], failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged evidence per sample, and per-source counts and bytes.

    A source that failed for a sample is listed with its status; the other
    sources still count.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [d.select("sample_id", "lo", "hi").withColumn("source", F.lit(n)) for n, d in sources.items()],
    )
    ok = normalize(tagged, ["sample_id", "source"]).groupBy("sample_id", "source").agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum(F.col("hi") - F.col("lo")).alias("n_bytes")
    ).withColumn("status", F.lit("ok"))
    if failures is not None:
        bad = failures.select(
            "sample_id", "source", F.lit(0).cast("bigint").alias("n_regions"), F.lit(0).cast("bigint").alias("n_bytes"), "status"
        )
        ok = ok.unionByName(bad)
    return normalize(tagged, ["sample_id"]), ok
