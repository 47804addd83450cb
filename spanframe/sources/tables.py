"""Typed readers and writers of manifests, labels, scores and run records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a cohort manifest: type, and must the file have it?
MANIFEST = {
    "sample_id": ("string", True), "split": ("string", True), "first_seen": ("double", True), "tags": ("string", True), "detection_count": ("bigint", True),
    "seed": ("string", True), "role": ("string", True), "tag_counts": ("string", False), "replaces": ("string", False), "stored_sha256": ("string", False),
    "content_sha256": ("string", False), "etag": ("string", False), "content_length": ("bigint", False), "download_status": ("string", False),
    "inflate_status": ("string", False), "layout_status": ("string", False), "parser_status": ("string", False), "evidence_status": ("string", False),
    "exclusion_reason": ("string", False),
}


def parse_ok(c: Column) -> Column:
    """``1``, ``True`` and ``true`` mean yes."""
    return F.coalesce(c.isin("1", "True", "true"), F.lit(False))


def number_or_zero(c: Column, kind: str = "bigint") -> Column:
    return F.coalesce(F.when(F.trim(c) != "", c).try_cast(kind), F.lit(0).cast(kind))


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def read_manifest(spark: SparkSession, path: str, names: dict[str, str] | None = None, fields: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """All manifest fields, found by header name in any order.

    ``names`` maps header names of the file to field names. A missing required column is
    an error, a missing other one is empty; further columns follow as text. Text is
    trimmed of nothing; an absent number is 0.
    """
    fields = fields or MANIFEST
    raw = spark.read.option("header", True).option("emptyValue", "").csv(path)
    for old, new in (names or {}).items():
        raw = raw.withColumnRenamed(old, new)
    lost = [f for f, (_, needed) in fields.items() if needed and f not in raw.columns]
    if lost:
        raise ValueError(f"manifest lacks columns: {', '.join(lost)}")

    def field(name: str, kind: str) -> Column:
        c = F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")
        return (c if kind == "string" else number_or_zero(c, kind)).alias(name)

    more = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns if c not in fields]
    return raw.select(*[field(n, k) for n, (k, _) in fields.items()], *more)


def write_outcomes(df: DataFrame, path: str) -> None:
    df.select("sample_id", "ok", "content_length", "etag", "error").write.mode("overwrite").option("header", True).csv(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("sample_id string, ok string, content_length string, etag string, error string").option("header", True).csv(path).na.fill("")
    return raw.withColumn("ok", parse_ok(F.col("ok"))).withColumn("content_length", number_or_zero(F.col("content_length")))


def read_labels(spark: SparkSession, path: str, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """(labels with zero-based class, violations): quotes are trimmed, the range is checked."""
    raw = spark.read.schema("id string, label string").option("header", True).option("quote", "\u0000").csv(path)
    clean = raw.select(F.regexp_replace("id", '^"|"$', "").alias("sample_id"), F.regexp_replace("label", '^"|"$', "").try_cast("int").alias("label"))
    good = F.coalesce(F.col("label").between(lo, hi), F.lit(False))
    return clean.filter(good).withColumn("label", F.col("label") - lo), clean.filter(~good)


def parse_scores(df: DataFrame, content: str) -> DataFrame:
    """Nested ``{sample: {selector: [score per tile]}}`` texts as long rows."""
    m = F.from_json(content, "map<string,map<string,array<double>>>")
    one = df.select(F.explode(m).alias("sample_id", "_s")).select("sample_id", F.explode("_s").alias("selector", "_v"))
    return one.select("sample_id", "selector", F.size("_v").cast("bigint").alias("n_scores"), F.posexplode("_v").alias("tile", "score")).withColumn("tile", F.col("tile").cast("bigint"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_scores(spark.read.text(path, wholetext=True), "value")


def check_scores(scores: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable scores, error rows): a vector whose length is not the tile count is reported, the rest goes on."""
    j = scores.join(tiles.select("sample_id", "n_tiles"), "sample_id")
    bad = j.filter("n_scores <> n_tiles").groupBy("sample_id", "selector").agg(
        F.max("n_scores").alias("n_scores"), F.max("n_tiles").alias("n_tiles")
    ).withColumn("error", F.format_string("scores have %d entries for %d tiles", F.col("n_scores"), F.col("n_tiles")))
    return j.filter("n_scores = n_tiles").drop("n_scores", "n_tiles"), bad


def append_run_record(path: str, kind: str, params: dict[str, str], counts: DataFrame, inputs: str = "", commit: str = "") -> None:
    """One provenance row: kind, UTC time, code commit, parameters, input identity and counts.

    ``counts`` has one row (name, n) per counted thing and is counted by the write itself.
    """
    given = F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]) if params else F.create_map().cast("map<string,string>")
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("n").cast("bigint")))).alias("counts"))
    row.select(
        F.lit(kind).alias("kind"), F.lit(dt.datetime.now(dt.timezone.utc).isoformat()).alias("at"), F.lit(commit).alias("commit"), given.alias("params"),
        F.lit(inputs).alias("inputs"), "counts",
    ).write.mode("append").parquet(path)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
