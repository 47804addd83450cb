"""A2-A12, C16 (streaming), D14, E14, H5, H6: sources, sinks, streams and the text model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanframe.functions.rounding import round_double
from spanframe.operators import regions, sequence, textmodel
from spanframe.plans.cohort_queries import _manifest
from spanframe.plans.region_queries import _layouts
from spanframe.plans.registry import query
from spanframe.plans.views import table, view
from spanframe.session import scratch_path
from spanframe.sources import annotations as ann
from spanframe.sources import dumps, tables
from spanframe.streaming import ingest, runs


@query(
    "a2_manifest_round_trip",
    """select sample_id::varchar as sample_id, split, sample_id * 3.5::double as first_seen, '' as tags, pos::bigint as detection_count, 'seed' as seed, role, case when role = 'primary' then '1=' || pos else '' end as tag_counts,
    '' as replaces, '' as stored_sha256, '' as content_sha256, 'e' || sample_id as etag, case when ok then pos * 2 else 0 end::bigint as content_length, case when ok then 'ok' else 'missing' end as download_status,
    '' as inflate_status, '' as layout_status, '' as parser_status, '' as evidence_status, case when role = 'primary' and sample_id % 23 = 0 then 'selection:withdrawn' else '' end as exclusion_reason, size::varchar as size from v_manifest""",
    ("v_manifest",),
)
def a2(spark, sf):
    """The file has other header names, another order, lacks optional columns and has one more."""
    m = _manifest(spark, sf)
    text = m.select(
        F.col("size").cast("string").alias("size"), F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"), F.when(F.col("ok"), "ok").otherwise("missing").alias("download_status"),
        F.when(F.col("ok"), (F.col("pos") * 2).cast("string")).alias("bytes"), F.concat(F.lit("e"), "sample_id").alias("etag"),
        F.when(F.col("role") == "primary", F.concat(F.lit("1="), "pos")).otherwise("").alias("tag_counts"), F.col("role").alias("selection"), F.lit("seed").alias("seed"), F.lit("").alias("tags"),
        F.col("pos").cast("string").alias("detection_count"), (F.col("sample_id") * 3.5).cast("string").alias("seen"), "split", F.col("sample_id").cast("string").alias("digest"))
    path = scratch_path(spark, "manifest")
    tables.write_manifest(text, path)
    return tables.read_manifest(spark, path, {"digest": "sample_id", "selection": "role", "seen": "first_seen", "bytes": "content_length"})


@query("a2_outcomes_round_trip", "select sample_id::varchar as sample_id, ok, case when ok then sample_id * 10 else 0 end as content_length, case when ok then '' else 'gone' end as error from v_manifest", ("v_manifest",))
def a2o(spark, sf):
    m = view(spark, sf, "v_manifest")
    o = m.select(F.col("sample_id").cast("string"), F.when(F.col("ok"), "1").otherwise("false").alias("ok"), F.when(F.col("ok"), (F.col("sample_id") * 10).cast("string")).alias("content_length"),
                 F.lit("e").alias("etag"), F.when(~F.col("ok"), "gone").alias("error"))
    path = scratch_path(spark, "outcomes")
    tables.write_outcomes(o, path)
    return tables.read_outcomes(spark, path).drop("etag")


def _manifest_docs(spark, sf):
    """One manifest per nation with a sample per supplier; odd suppliers break one rule each."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    bad = lambda n: k % 40 == n
    box = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))
    ranged = (k % 2 == 0) | bad(13)
    a = F.struct(
        F.when(bad(5), 9).when(F.col("s_acctbal") > 0, 1).otherwise(2).alias("category_id"), F.when(bad(7), "guess").when(bad(9) | bad(11), "bayesian_gradcam").otherwise("human_verified").alias("annotation_source"),
        F.when(bad(3), False).alias("verified"), F.when(ranged, k).alias("start"), F.when(ranged, k + 5).alias("end"), F.when(~ranged | bad(13), box).alias("bbox_xywh"),
        F.when(bad(11), "v1").alias("annotation_version"), F.when(bad(15), 1.5).otherwise(0.5).alias("source_score"), F.when(bad(17), "x").alias("note"))
    sample = F.struct(
        F.when(bad(19), "NUL.x").when(bad(21), "a b").otherwise(F.concat(F.lit("s"), k)).alias("sample_id"), F.lit("src").alias("source"), F.when(bad(23), "dev").otherwise("train").alias("split"),
        F.lit("raw-rgb").alias("encoding"), F.when(bad(25), 0).when(bad(27), 512).alias("width"), F.array(a).alias("annotations"), F.when(bad(29), "xyz").alias("sha256"), F.when(bad(31), "x").alias("extra"))
    g = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    n = F.col("s_nationkey")
    doc = F.to_json(F.struct(F.when(n == 7, 2).otherwise(1).alias("version"), F.concat(F.lit("n"), n).alias("name"),
                             F.array(F.struct(F.lit(1).alias("id"), F.lit("plus").alias("name")), F.struct(F.when(n == 9, 3).otherwise(2).alias("id"), F.when(n == 11, "PLUS").otherwise("minus").alias("name"))).alias("categories"), "samples",
                             F.when(n == 3, "y").alias("comment")))
    return g.select("s_nationkey", doc.alias("text"))


SPECS = """sp as (select s_nationkey as doc, s_suppkey as k, s_suppkey % 40 as m, case when s_suppkey % 40 = 19 then 'NUL.x' when s_suppkey % 40 = 21 then 'a b' else 's' || s_suppkey end as sample_id,
 case when s_suppkey % 40 = 5 then 9 when s_acctbal > 0 then 1 else 2 end as category_id, s_suppkey % 2 = 0 or s_suppkey % 40 = 13 as ranged from supplier)"""


@query(
    "a3_annotation_rows",
    f"""with {SPECS} select doc, sample_id, 0 as ann_pos, category_id, case when m = 7 then 'guess' when m in (9, 11) then 'bayesian_gradcam' else 'human_verified' end as annotation_source, m not in (3, 7, 9, 11) as verified,
    case when ranged then k end as start, case when ranged then k + 5 end as "end", case when not ranged or m = 13 then 4.0::double end as box_h, case when m = 11 then 'v1' end as annotation_version, case when m = 15 then 1.5::double else 0.5 end as source_score from sp""",
)
def a3(spark, sf):
    a = ann.parse_annotation_manifests(_manifest_docs(spark, sf), "text", "s_nationkey")["annotations"]
    return a.withColumn("box_h", F.get("bbox", F.lit(3))).drop("bbox", "teacher_model")


@query(
    "a3_manifest_violations",
    f"""with {SPECS} select 7 as doc, null::varchar as sample, null::int as ann_pos, 'wrong version' as rule where 7 in (select doc from sp)
    union all select 3, null, null, 'unknown root key comment' where 3 in (select doc from sp) union all select 9, null, null, 'category ids do not count from 1' where 9 in (select doc from sp)
    union all select 11, null, null, 'category names repeat' where 11 in (select doc from sp)
    union all select doc, null, null, 'sample_id repeats' from sp group by doc having count(*) > count(distinct lower(sample_id))
    union all select doc, sample_id, null, case m when 19 then 'sample_id is no portable name' when 21 then 'bad sample_id' when 23 then 'unknown split' when 25 then 'width out of range' when 29 then 'bad sha256' else 'unknown sample key extra' end from sp where m in (19, 21, 23, 25, 29, 31)
    union all select doc, sample_id, 0, case m when 3 then 'human_verified but not verified' when 7 then 'unknown annotation_source' when 9 then 'annotation_version is required' when 13 then 'needs either a range or a box'
      when 15 then 'source_score out of range' else 'unknown annotation key note' end from sp where m in (3, 7, 9, 13, 15, 17)
    union all select doc, sample_id, 0, 'unknown category' from sp where category_id = 9 or (doc = 9 and category_id = 2)""",
)
def a3v(spark, sf):
    return ann.parse_annotation_manifests(_manifest_docs(spark, sf), "text", "s_nationkey")["violations"]


@query("a4_read_labels", "select doc_id::varchar as sample_id, quality as label from labels where quality + toxic + 1 <= 2 and toxic = 0")
def a4(spark, sf):
    lab = table(spark, sf, "labels").select(F.concat(F.lit('"'), "doc_id", F.lit('"')).alias("id"), F.when(F.col("toxic") == 1, F.lit("9")).otherwise(F.concat(F.lit('"'), F.col("quality") + 1, F.lit('"'))).alias("label"))
    path = scratch_path(spark, "labels")
    lab.write.option("header", True).option("quote", "\u0000").csv(path)
    return tables.read_labels(spark, path, 1, 2)[0]


@query("a4_label_violations", "select doc_id::varchar as sample_id, 9 as label from labels where toxic = 1")
def a4v(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, F.lit("9")).otherwise((F.col("quality") + 1).cast("string")).alias("label"))
    path = scratch_path(spark, "labels")
    lab.write.option("header", True).csv(path)
    return tables.read_labels(spark, path, 1, 2)[1]


def _box_docs(spark, sf, scored):
    """One document per image, in both spellings of every key; box 7 has a bad score, box 6 no size."""
    v = view(spark, sf, "v_box").withColumn("score", F.when(F.col("box_id") == 7, 1.5).otherwise(F.col("score")))
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1")], F.when(F.col("box_id") == 6, 0.0).otherwise(F.col("w").cast("double")), F.col("h").cast("double"))
    odd = F.col("image_id") % 2 == 1
    cid = F.when(F.col("label") == "A", 1).when(F.col("label") == "N", 2).otherwise(3)
    named = F.col("box_id") % 3 == 0
    item = F.struct(
        "box_id", F.when(odd, box).alias("bbox"), F.when(~odd, box).alias("bbox_xywh"), F.when(odd, cid).alias("category_id"), F.when(~odd, cid).alias("class_id"),
        F.when(odd & named, F.concat(F.lit(" "), "label")).alias("category_name"), F.when(~odd & named, F.col("label")).alias("class_name"),
        *([F.when(odd, F.col("score")).alias("score"), F.when(~odd, F.col("score")).alias("confidence")] if scored else [(F.col("box_id") % 2).alias("image_id")]))
    return v.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("a"))


LABEL = "case label when 'A' then 1 when 'N' then 2 else 3 end"


@query(
    "a5_read_roi_annotations",
    f"""select image_id, box_id - 1 as pos, {LABEL}::bigint as category_id, case when box_id % 3 = 0 then label else 'id:' || {LABEL} end as label, x1::double as x, y1::double as y, case when box_id = 6 then 0.0 else w end::double as w, h::double as h,
    score, case when box_id = 6 then 'bbox needs a positive size' when score not between 0 and 1 then 'score out of range' end as violation
    from (select * replace (case when box_id = 7 then 1.5 else score end as score) from v_box)""",
    ("v_box",),
)
def a5(spark, sf):
    docs = _box_docs(spark, sf, True).select("image_id", F.to_json("a").alias("t"))
    return ann.parse_predictions(docs, "t", "image_id").withColumnRenamed("doc", "image_id").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "a5_truth_annotations",
    f"""select image_id, box_id - 1 as pos, {LABEL}::bigint as category_id, case when box_id % 3 = 0 or label = 'A' then label when label = 'N' then 'named' else 'id:3' end as label, x1::double as x, y1::double as y,
    case when box_id = 6 then 0.0 else w end::double as w, h::double as h, case when box_id = 6 then 'bbox needs a positive size' end as violation from v_box where image_id % 5 <> 0 and (image_id % 5 <> 1 or box_id % 2 = 1)
    union all select distinct image_id, null, null, null, null, null, null, null, 'no unique image' from v_box where image_id % 5 = 0""",
    ("v_box",),
)
def a5t(spark, sf):
    """Images with ``images`` (one fits, none fits) and documents of a single image."""
    k = F.col("image_id") % 5
    file = F.struct(F.lit(1).alias("id"), F.concat(F.lit("set/IM"), "image_id", F.lit(".PNG")).alias("file_name"))
    other = F.struct(F.lit(0).alias("id"), F.lit("x.png").alias("file_name"))
    cats = F.array(F.struct(F.lit(1).alias("id"), F.lit("A").alias("name")), F.struct(F.lit(2).alias("id"), F.lit("named").alias("name")))
    doc = F.to_json(F.struct(F.col("a").alias("annotations"), cats.alias("categories"), F.when(k == 0, F.array(other)).when(k == 1, F.array(other, file)).alias("images")))
    docs = _box_docs(spark, sf, False).select("image_id", doc.alias("t"), F.concat(F.lit("D:\\a/im"), "image_id", F.lit(".png")).alias("name"))
    out = ann.parse_truth(docs, "t", "image_id", "name").drop("score")
    return out.withColumnRenamed("doc", "image_id").withColumn("pos", F.col("pos").cast("bigint"))


HEX = """ht as (select doc_id as sample_id, unnest(range(length(text))) as cp, unnest(string_split(text, '')) as c from documents),
hc as (select sample_id, cp, hex(encode(c)) as h from ht),
hb as (select sample_id, cp, h, unnest(range(length(h) // 2)) as k from hc),
bt as (select sample_id, row_number() over (partition by sample_id order by cp, k) - 1 as off, substr(h, 2 * k + 1, 2) as b from hb),
nb as (select sample_id, count(*) as n from bt group by 1)"""


def _dump_text(spark, sf):
    """Documents as dumps of 16 bytes per line, with unknown bytes, a dropped line and a late rewrite."""
    h = F.hex(F.encode("text", "utf-8"))
    # cut in one pass: a substring per line would read a long text once for every line
    bodies = F.regexp_extract_all(F.regexp_replace(h, "(..)", "$1 "), F.lit(".{1,48}"), F.lit(0))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), bodies.alias("bodies"))
    # addresses of 6, 8 and 16 digits
    width = F.when(F.col("sample_id") % 3 == 0, 8).when(F.col("sample_id") % 3 == 1, 16).otherwise(6)
    def line(x, i):
        body = F.when(i % 5 == 2, F.concat(F.lit("??"), F.substring(F.rtrim(x), 3, 48))).otherwise(F.rtrim(x))
        return F.when(i % 7 == 6, F.lit("; comment")).otherwise(F.concat(F.lpad(F.hex(F.lit(0x401000) + i * 16), width, "0"), F.lit(" "), body))
    lines = F.transform("bodies", line)
    return d.select("sample_id", F.concat_ws("\n", F.concat(lines, F.array(F.lit("00401001 AA ??"), F.lit("00400000 11 22")))).alias("text"))


@query(
    "a6_read_hex_dumps",
    f"""with {HEX}, l as (select sample_id, n, unnest(range((n + 15) // 16)) as i from nb)
    select sample_id, i::int as line_no, 4198400 + i * 16 as addr, 4198400::bigint as base, least(16, n - i * 16)::int as n_tokens from l where i % 7 <> 6
    union all select sample_id, ((n + 15) // 16)::int, 4198401, 4198400, 2 from nb""",
)
def a6(spark, sf):
    d = dumps.parse_hex_dumps(_dump_text(spark, sf), "text").drop("payload", "offset")
    return d.withColumn("addr", F.col("addr").cast("bigint")).withColumn("base", F.col("base").cast("bigint"))


def _wide_text(spark, sf):
    """Lines from the top of the address space, one below the first, one with 18 digits and one with zeros in front."""
    at = lambda c: F.concat(F.lit("FFFFF8"), F.lpad(F.hex(c), 10, "0"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("k"))
    text = F.concat_ws("\n", *[F.concat(a, F.lit(" 55 8B EC")) for a in (
        at(F.col("k") + 4096), at(F.col("k") + 4112), at(F.col("k") + 4095), F.concat(F.lit("12"), at(F.col("k"))), F.concat(F.lit("00"), at(F.col("k") + 5000)))])
    return o.select("sample_id", text.alias("text"))


@query(
    "a6_wide_addresses",
    """select o_orderkey as sample_id, i::int as line_no, (18446735277616529408::hugeint + o_custkey + d)::varchar as addr, (d - 4096)::bigint as "offset", null as reason
      from orders, (values (0, 4096), (1, 4112), (4, 5000)) as v(i, d)
    union all select o_orderkey, 2, (18446735277616529408::hugeint + o_custkey + 4095)::varchar, null, 'below_base' from orders
    union all select o_orderkey, 3, null, null, 'address_too_long' from orders""",
)
def a6w(spark, sf):
    d = _wide_text(spark, sf)
    ok = dumps.parse_hex_dumps(d, "text").select("sample_id", "line_no", F.col("addr").cast("string").alias("addr"), "offset", F.lit(None).cast("string").alias("reason"))
    value = F.when(F.col("reason") == "below_base", dumps._address(F.col("address")).cast("string"))
    return ok.unionByName(dumps.refused_lines(d, "text").select("sample_id", "line_no", value.alias("addr"), F.lit(None).cast("bigint").alias("offset"), "reason"))


ASM = HEX + """, cl as (select sample_id, off, case when off = 1 then 'AA' when off = 2 then '??' when off % 16 = 0 and off // 16 % 5 = 2 then '??' else b end as t from bt where off // 16 % 7 <> 6
 union select sample_id, 1, 'AA' from nb union select sample_id, 2, '??' from nb), cv as (select distinct sample_id, off, t from cl)"""


@query("e14_assemble_dump", f"with {ASM} select sample_id, off // 512 as row, count(*) as n, cast(sum(('0x' || t)::integer) as bigint) as total, min(off) as first_off, max(off) as last_off from cv where t <> '??' group by 1, 2")
def e14(spark, sf):
    b = dumps.assemble_dump(dumps.parse_hex_dumps(_dump_text(spark, sf), "text"))[0]
    return b.groupBy("sample_id", F.floor(F.col("off") / 512).alias("row")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("byte").alias("total"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


@query("e14_dump_facts", f"with {ASM} select sample_id, max(off) + 1 as size, count(*) filter (t <> '??') as n_valid, round(count(*) filter (t <> '??') / (max(off) + 1)::double, 9) as valid_fraction from cv group by 1")
def e14f(spark, sf):
    f = dumps.assemble_dump(dumps.parse_hex_dumps(_dump_text(spark, sf), "text"))[1]
    return f.withColumn("valid_fraction", round_double("valid_fraction", 9))


def _masked(spark, sf):
    lines = dumps.parse_hex_dumps(_dump_text(spark, sf), "text")
    # a fifth of the samples has no valid byte at all
    unknown = F.regexp_replace("payload", "[0-9A-F]{2}", "??")
    return dumps.dump_content(lines.withColumn("payload", F.when(F.col("sample_id") % 5 == 0, unknown).otherwise(F.col("payload"))))


KNOWN = ASM + """, vb as (select sample_id, off, ('0x' || t)::integer as b from cv where t <> '??' and sample_id % 5 <> 0), sm as (select distinct sample_id from cv)"""


@query("e14_valid_runs", f"with {KNOWN}, g as (select *, off - row_number() over (partition by sample_id order by off) as isl from vb) select sample_id, min(off) as lo, max(off) + 1 as hi from g group by sample_id, isl")
def e14r(spark, sf):
    return _masked(spark, sf).select("sample_id", F.explode("runs").alias("r")).select("sample_id", "r.lo", "r.hi")


@query("e1_masked_histogram", f"with {KNOWN} select sample_id, off // 64 as tile, b::bigint as code, count(*) as cnt from vb group by all")
def e1m(spark, sf):
    return sequence.symbol_histogram(_masked(spark, sf), "sample_id", "content", 64, "runs")


@query(
    "e1_masked_probabilities",
    f"""with {KNOWN} select sample_id, b::bigint as code, round(count(*) / sum(count(*)) over (partition by sample_id), 9) as p from vb group by sample_id, b
    union all select sample_id, unnest(range(256)), round(1 / 256.0, 9) from sm where sample_id % 5 = 0""",
)
def e1mp(spark, sf):
    p = sequence.symbol_probabilities(sequence.symbol_histogram(_masked(spark, sf), "sample_id", "content", None, "runs", keep_empty=True))
    return p.withColumn("p", round_double("p", 9))


@query(
    "e3_masked_rows",
    f"""with {KNOWN}, h as (select sample_id, off // 512 as row, b, count(*) as c from vb group by all)
    select sample_id, row, sum(c)::bigint as n_valid, round(sum(b * c) / sum(c) / 255.0, 9) as mean, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 8.0, 9) as entropy, round(count(*) / 256.0, 9) as "distinct" from h group by all""",
)
def e3m(spark, sf):
    r = sequence.valid_row_statistics(_masked(spark, sf), "sample_id", "content", "runs")
    return r.select("sample_id", "row", "n_valid", *[round_double(c, 9).alias(c) for c in ("mean", "entropy", "distinct")])


@query(
    "e4_masked_bigrams",
    f"""with {KNOWN}, pr as (select sample_id, b, lead(b) over (partition by sample_id order by off) as nx from vb),
    f as (select sample_id, b::bigint as index, 0 as kind from vb union all select sample_id, 256 + (b * 256 + nx) % 1024, 1 from pr where nx is not null),
    c as (select sample_id, kind, index, count(*) as n from f group by all)
    select sample_id, index, round(n / sum(n) over (partition by sample_id, kind), 9) as value from c
    union all select sample_id, unnest(range(256)), round(1 / 256.0, 9) from sm where sample_id % 5 = 0""",
)
def e4m(spark, sf):
    return sequence.hashed_bigram_features(_masked(spark, sf), "sample_id", "content", valid="runs").withColumn("value", round_double("value", 9))


@query("a7_read_segment_listing", "select user_id as sample_id, '.' || event_type as name, min(4096 + event_id) as lo, max(4096 + event_id) as hi from events group by 1, 2")
def a7(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat(F.lit("."), "event_type", F.lit(":"), F.lpad(F.hex(F.col("event_id") + 4096), F.when(F.col("event_id") % 3 == 0, 8).when(F.col("event_id") % 3 == 1, 16).otherwise(6), "0"), F.lit("  mov"))
    t = e.groupBy(F.col("user_id").alias("sample_id")).agg(F.concat_ws("\n", F.collect_list(line), F.array(F.lit("; end"))).alias("text"))
    return dumps.parse_segment_listing(t, "text").select("sample_id", "name", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


@query("a7_wide_addresses", "select c_custkey as sample_id, '.text' as name, (18446735277616529408::hugeint + c_custkey)::varchar as lo, (18446735277616529408::hugeint + c_custkey + 255)::varchar as hi from customer")
def a7w(spark, sf):
    line = lambda d: F.concat(F.lit(".text:FFFFF8"), F.lpad(F.hex(F.col("c_custkey") + d), 10, "0"), F.lit("  mov"))
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.concat_ws("\n", line(9), line(0), line(255)).alias("text"))
    s = dumps.parse_segment_listing(t, "text")
    return s.select("sample_id", "name", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


def _packed(spark, sf):
    def pack(batches):
        import zlib

        for pdf in batches:
            yield pd.DataFrame({"sample_id": pdf["doc_id"].astype(str), "content": [t.encode() if n < 40 else zlib.compress(t.encode()) for t, n in zip(pdf["text"], pdf["n_chars"])]})

    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return d.mapInPandas(pack, "sample_id string, content binary")


@query(
    "a8_inflate_samples",
    """select d.doc_id::varchar as sample_id, case when n_chars >= 40 then strlen(text) end as length, case when n_chars < 40 then 'decompress_error' end as exclusion_reason from documents d
    union all select 'x' || item_id, null, 'missing:x' || item_id from benchmark""",
)
def a8(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id")).unionByName(table(spark, sf, "benchmark").select(F.concat(F.lit("x"), "item_id").alias("sample_id")))
    out = dumps.inflated_lengths(dumps.inflate_samples(ids, _packed(spark, sf), 4096))
    return out.select("sample_id", "length", F.regexp_replace("exclusion_reason", "^decompress_error:.*", "decompress_error").alias("exclusion_reason"))


@query(
    "a9_read_scores",
    "select vec_id::varchar as sample_id, 'attention' as selector, unnest(range(len(embedding))) as tile, unnest(embedding)::double as score from embeddings where label <> 3",
)
def a9(spark, sf):
    return tables.check_scores(*_scores(spark, sf))[0].withColumn("score", F.col("score").cast("float").cast("double"))


def _scores(spark, sf):
    e = table(spark, sf, "embeddings")
    doc = F.to_json(F.create_map(F.col("vec_id").cast("string"), F.create_map(F.lit("attention"), "embedding")))
    tiles = e.select(F.col("vec_id").cast("string").alias("sample_id"), F.when(F.col("label") == 3, 7).otherwise(F.size("embedding")).cast("bigint").alias("n_tiles"))
    return tables.parse_scores(e.select(doc.alias("t")), "t"), tiles


@query("a9_score_errors", "select vec_id::varchar as sample_id, 'attention' as selector, len(embedding) as n_scores, 7::bigint as n_tiles, 'scores have ' || len(embedding) || ' entries for 7 tiles' as error from embeddings where label = 3")
def a9e(spark, sf):
    return tables.check_scores(*_scores(spark, sf))[1]


def _detections(spark, sf):
    o = table(spark, sf, "orders")
    im = o.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", "val").otherwise("train").alias("split"), F.col("o_orderkey").alias("pos"), F.lit(640).alias("width"), F.lit(640).alias("height"))
    cls = F.when(F.col("label") == "A", 1).when(F.col("label") == "N", 2).otherwise(3)
    a = view(spark, sf, "v_box").select(F.col("image_id").alias("sample_id"), F.col("box_id").alias("ann_pos"), cls.alias("class_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h")
    return im, a


@query(
    "a10_detection_tables",
    """with im as (select o_orderkey as sample_id, case when o_orderstatus = 'F' then 'val' else 'train' end as split from orders), id as (select *, row_number() over (partition by split order by sample_id) as image_id from im),
    j as (select v.image_id as sample_id, id.split, id.image_id, v.box_id as ann_pos, case label when 'A' then 1 when 'N' then 2 else 3 end as class_id, x1, y1, w, h from v_box v join id on id.sample_id = v.image_id)
    select sample_id, split, image_id, ann_pos, class_id, row_number() over (partition by split order by image_id, ann_pos) as annotation_id, printf('%d %.8f %.8f %.8f %.8f', class_id - 1, (x1 + w / 2.0::double) / 640, (y1 + h / 2.0::double) / 640, w / 640.0::double, h / 640.0::double) as line from j""",
    ("v_box",),
)
def a10(spark, sf):
    return ann.detection_tables(*_detections(spark, sf))[1].select("sample_id", "split", "image_id", "ann_pos", "class_id", "annotation_id", "line")


@query(
    "a10_coco_documents",
    """with im as (select o_orderkey as sample_id, case when o_orderstatus = 'F' then 'val' else 'train' end as split from orders), id as (select *, row_number() over (partition by split order by sample_id) as image_id from im),
    j as (select id.split, id.image_id, v.box_id as ann_pos, case label when 'A' then 1 when 'N' then 2 else 3 end as class_id, x1, y1, w, h from v_box v join id on id.sample_id = v.image_id)
    select split, 'image' as kind, image_id as id, sample_id::varchar as file_name, null::bigint as image_id, null::bigint as category_id, null::double as x, null::double as y, null::double as w, null::double as h, null::double as area from id
    union all select split, 'annotation', row_number() over (partition by split order by image_id, ann_pos), null, image_id, class_id, x1::double, y1::double, w::double, h::double, w::double * h from j""",
    ("v_box",),
)
def a10d(spark, sf):
    """Records of the documents as the sink wrote them."""
    out = scratch_path(spark, "detections")
    ann.write_detection_dataset(*_detections(spark, sf), out, ["A", "N", "R"])
    shape = "id bigint, file_name string, image_id bigint, category_id bigint, bbox array<double>, area double"
    lines = spark.read.schema("value string, split string").text(f"{out}/documents").filter(F.col("value").rlike(r"^,?\{\"id\""))
    r = lines.select("split", F.from_json(F.regexp_replace("value", "^,", ""), shape).alias("r"))
    kind = F.when(F.col("r.bbox").isNull(), "image").otherwise("annotation")
    box = [F.col("r.bbox")[k].alias(c) for k, c in enumerate(("x", "y", "w", "h"))]
    return r.select("split", kind.alias("kind"), "r.id", "r.file_name", "r.image_id", "r.category_id", *box, "r.area")


@query("a11_run_records", "select 'evaluate' as kind, 'sf' as param, (select count(*) from documents) as n_documents, (select count(*) from events) as n_events")
def a11(spark, sf):
    path = scratch_path(spark, "records")
    sizes = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("documents", "events")]
    tables.append_run_record(path, "evaluate", {"sf": sf}, sizes[0].unionByName(sizes[1]))
    r = tables.read_run_records(spark, path)
    return r.select("kind", F.map_keys("params")[0].alias("param"), F.col("counts")["documents"].alias("n_documents"), F.col("counts")["events"].alias("n_events"))


@query(
    "a12_ingest_increment",
    """with h as (select doc_id, sha256(text) as content_hash, length(text) as n_units from documents), w as (select *, min(doc_id) filter (n_units >= 100) over (partition by content_hash) as f from h)
    select doc_id as sample_id, content_hash, n_units, case when n_units < 100 then 'too_short' when doc_id = f then 'accepted' else 'duplicate' end as status, case when n_units >= 100 and doc_id <> f then f end as duplicate_of from w""",
)
def a12(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("content"))
    top = d.agg((F.max("sample_id") + 1).alias("top"))  # one row
    src, out, state = (scratch_path(spark, n) for n in ("arrivals", "corpus", "state"))
    for i in range(3):  # three arrivals in id order, each of any number of files
        part = d.join(F.broadcast(top), (F.col("sample_id") >= F.expr(f"{i} * top div 3")) & (F.col("sample_id") < F.expr(f"{i + 1} * top div 3"))).drop("top")
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(d.schema).parquet(src)
        ingest.ingest_increment(stream, out, state, min_units=100).awaitTermination()
    return ingest.read_ingested(spark, out).drop("batch", "part")


STREAMED = """kv as (select user_id::varchar as process, ts, event_id, event_type as value, lag(event_type) over (partition by user_id order by ts, event_id) as pv from events where event_type <> 'error')"""


@query("c16_collapse_stream", f"with {STREAMED} select process, event_id, value, row_number() over (partition by process order by ts, event_id) - 1 as pos from kv where pv is distinct from value")
def c16s(spark, sf):
    e = table(spark, sf, "events").filter("event_type <> 'error'").select(F.col("user_id").cast("string").alias("process"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("value"))
    src, out, state = (scratch_path(spark, n) for n in ("arrivals", "runs", "state"))
    e.withColumn("half", F.dayofmonth("ts") > 15).filter("not half").drop("half").coalesce(1).write.mode("append").parquet(src)
    e.withColumn("half", F.dayofmonth("ts") > 15).filter("half").drop("half").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = runs.collapse_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _headers(spark, sf):
    """Layouts written as executable headers, little end first; every 11th one is damaged."""
    lay = _layouts(spark, sf)
    def le(c, width):
        h = F.lpad(F.hex(c.cast("bigint")), 2 * width, "0")
        return F.concat(*[F.substring(h, 2 * (width - 1 - j) + 1, 2) for j in range(width)])
    zero = lambda n: F.lit("00" * n)
    n = F.size("regions")
    k = F.lit(64)
    sec = F.transform("regions", lambda r: F.concat(F.rpad(F.hex(F.concat(F.lit("s"), r["idx"].cast("string"))), 16, "0"), le(r["vsize"], 4), le(r["rva"], 4), le(r["raw_size"], 4), le(r["raw_lo"], 4), zero(16)))
    opt = F.concat(F.lit("0B01"), zero(26), le(F.col("sample_id") + 4096, 4), le(F.lit(4096), 4), le(F.lit(512), 4), zero(20), le(F.col("header_len"), 4), zero(28), le(F.lit(5), 4), zero(32),
                   le(F.coalesce("cert_lo", F.lit(0)), 4), le(F.coalesce(F.col("cert_hi") - F.col("cert_lo"), F.lit(0)), 4))
    magic = F.when(F.col("sample_id") % 11 == 5, "4D5B").otherwise("4D5A")
    text = F.concat(magic, zero(58), le(k, 4), F.lit("50450000"), zero(2), le(n, 2), zero(12), le(F.lit(136), 2), zero(2), opt, F.concat_ws("", sec), zero(600))
    return regions._once(lay, content=F.unhex(text)).select("sample_id", "content")


HEAD = "rg as (select sample_id, row_number() over (partition by sample_id order by idx) - 1 as k, idx, src_lo, src_hi - src_lo as rs, dst_lo, dst_hi - dst_lo as vs from v_region)"


@query(
    "d14_parse_regions",
    f"with {HEAD} select sample_id, k as idx, 's' || idx as name, src_lo as raw_lo, rs as raw_size, dst_lo as rva, vs as vsize from rg where sample_id % 11 <> 5",
    ("v_region", "v_size"),
)
def d14(spark, sf):
    p = regions.parse_layouts(_headers(spark, sf))
    return p.select("sample_id", F.explode("regions").alias("r")).select("sample_id", "r.idx", "r.name", "r.raw_lo", "r.raw_size", "r.rva", "r.vsize")


@query(
    "d14_parse_layouts",
    f"""with {HEAD}, n as (select sample_id, count(*) as c, max(src_lo + rs) as e from rg group by 1), z as (select v.sample_id, coalesce(c, 0) as c, e, 224 + 40 * coalesce(c, 0) + 600 as fs from v_size v left join n using (sample_id))
    select sample_id, fs as file_size, case when ok then (sample_id + 4096)::varchar end as image_base, case when ok then 4::bigint end as header_len, case when ok then c end as n_sections, case when ok then greatest(4, least(coalesce(e, 4), fs)) end as overlay_offset,
    case when ok and sample_id % 2 = 0 then ov + 2 end as cert_lo, case when ok and sample_id % 2 = 0 then ov + 6 end as cert_hi, case when not ok then 'missing first signature' end as error
    from (select z.*, s.overlay_offset as ov, z.sample_id % 11 <> 5 as ok from z join v_size s using (sample_id))""",
    ("v_region", "v_size"),
)
def d14h(spark, sf):
    p = regions.parse_layouts(_headers(spark, sf))
    return p.select("sample_id", "file_size", F.col("image_base").cast("string").alias("image_base"), "header_len", "n_sections", "overlay_offset", "cert_lo", "cert_hi", "error")


def _labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("sample_id"), F.encode("text", "utf-8").alias("content"), "quality")


@query("h6_text_model")
def h6(spark, sf):
    df = _labelled(spark, sf)
    return textmodel.score_text_model(textmodel.fit_text_model(df, "content", "quality"), df, "content", "quality").withColumn("nll", F.round("nll", 4))


@query("h5_block_necessity")
def h5(spark, sf):
    df = _labelled(spark, sf)
    out = textmodel.block_necessity(textmodel.fit_text_model(df, "content", "quality"), df, "content", "quality", 512)
    return out.withColumn("delta", F.round("delta", 4)).withColumn("baseline_nll", F.round("baseline_nll", 4))
