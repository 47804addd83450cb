"""Behaviour reports: one JSON document per row, read into the event table of C16 and C17.

A report is parsed and judged inside its row, so refused reports need no join and the
document is read once; only category and name of a call are ever taken from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators import events

#: Categories that are kept, and the longest name of a call. Fixed values of the format.
CATEGORIES = ("process", "registry", "network", "filesystem")
LONGEST_API = 512
_SPACE = r"[\s\x1c-\x1f]+"


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _member(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _judged(process: Column, call: Column, v: Column) -> Column:
    category = F.when(_is_string(_member(v, "category", "variant")), _member(v, "category", "string"))
    kept = F.coalesce(category.isin(*CATEGORIES), F.lit(False))
    api = F.when(_is_string(_member(v, "api", "variant")), F.regexp_replace(_member(v, "api", "string"), f"(?U)^{_SPACE}|{_SPACE}$", ""))
    fault = (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "call is no object")
        .when(~kept, F.lit(None).cast("string"))
        .when(F.coalesce(api, F.lit("")) == "", "api is no text")
        .when(F.char_length(api) > LONGEST_API, "api is too long")
        .when(F.octet_length(api) != F.char_length(api), "api is not ASCII")
    )
    return F.struct(process.alias("process"), call.alias("call"), F.when(kept, category).alias("category"), F.when(kept, api).alias("api"), fault.alias("fault"))


def read_behavior_reports(reports: DataFrame, id_col: str, json_col: str, max_bytes: int | None = None) -> DataFrame:
    """(report, fault, ignored, calls) of each row; ``calls`` holds (process, call, category, api) in order.

    ``fault`` names the first thing wrong, else null: a report over ``max_bytes``; no JSON or
    a key twice in one object, null too; no list ``behavior.processes``; a process without a
    list ``calls``; a call that is no object; a call of a kept category whose ``api``, trimmed,
    is no text, longer than 512 characters or not ASCII. A report with a fault has no
    calls. Calls of other categories are counted in ``ignored``. Rows may repeat an id.
    """
    text = F.col(f"`{json_col}`").cast("string")
    fits = F.lit(True) if max_bytes is None else F.coalesce(F.octet_length(text) <= max_bytes, F.lit(True))
    parsed = reports.select(F.col(f"`{id_col}`").alias("report"), fits.alias("fits"), F.when(fits, F.try_parse_json(text)).alias("doc"))
    listed = parsed.select("report", "fits", F.col("doc").isNotNull().alias("valid"), F.try_variant_get("doc", "$.behavior.processes", "array<variant>").alias("processes"))
    no_list = lambda i: F.array(_judged(i, F.lit(-1), F.lit(None).cast("variant")).withField("fault", F.lit("calls is no list")))
    inner = lambda v, i: F.coalesce(F.transform(_member(v, "calls", "array<variant>"), lambda c, k: _judged(i, k, c)), no_list(i))
    items = listed.select("report", "fits", "valid", F.flatten(F.transform("processes", inner)).alias("items"))
    fault = (
        F.when(~F.col("fits"), "report is too large").when(~F.col("valid"), "no JSON object or a key twice")
        .when(F.col("items").isNull(), "processes is no list")
        .otherwise(F.get(F.filter("items", lambda x: x["fault"].isNotNull()), F.lit(0))["fault"])
    )
    found = items.select("report", fault.alias("fault"), "items")
    kept = F.filter("items", lambda x: x["category"].isNotNull())
    calls = F.transform(kept, lambda x: F.struct(x["process"].alias("process"), x["call"].alias("call"), x["category"].alias("category"), x["api"].alias("api")))
    nothing = F.array().cast("array<struct<process:int,call:int,category:string,api:string>>")
    sound = F.col("fault").isNull()
    ignored = F.when(sound, F.size("items") - F.size(kept)).otherwise(0)
    return found.select("report", "fault", ignored.cast("bigint").alias("ignored"), F.when(sound, calls).otherwise(nothing).alias("calls"))


def behavior_sequences(read: DataFrame, bucket: int = 4096) -> DataFrame:
    """(report, process, pos, category, api): calls without repeats of the call before them, and
    without processes whose sequence an earlier process of the report has. Ids must be unique."""
    calls = read.select("report", F.explode("calls").alias("c")).select("report", "c.process", "c.call", F.concat_ws("\t", "c.category", "c.api").alias("what"))
    collapsed = events.collapse_runs(calls, ["report", "process"], F.floor(F.col("call") / bucket), ["call"], "what")
    digests = events.sequence_digest(collapsed, ["report", "process"], "what")
    firsts = events.dedup_sequences(digests, ["report"], ["report", "process"]).select("report", "process")
    parts = F.split("what", "\t", 2)
    return collapsed.join(firsts, ["report", "process"]).select("report", "process", "pos", parts[0].alias("category"), parts[1].alias("api"))
