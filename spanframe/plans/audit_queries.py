"""Duplicates, leakage, constraints and event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.rounding import round_double
from spanframe.operators import audit, cohort, components, events
from spanframe.plans.cohort_queries import SPLIT3
from spanframe.plans.registry import query
from spanframe.plans.views import table, view
from spanframe.sources import behavior

DOCSPLIT = "case when length(source) = 4 then 'val' else 'train' end"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _split():
    return F.when(F.length("source") == 4, "val").otherwise("train")


@query(
    "c1_exact_dedup",
    """with h as (select doc_id, sha256(text) as content_hash from documents)
    select doc_id, content_hash, case when doc_id <> min(doc_id) over (partition by content_hash) then min(doc_id) over (partition by content_hash) end as duplicate_of,
    count(*) over (partition by content_hash) as group_size from h""",
)
def c1(spark, sf):
    return audit.exact_dedup(_docs(spark, sf), "text", ["doc_id"], "doc_id")


PLAN = f"""h as (select doc_id as path, sha256(text) as content_hash, lang as label, {DOCSPLIT} as split from documents),
g as (select *, count(*) over (partition by content_hash) as group_size, min(label) over (partition by content_hash) <> max(label) over (partition by content_hash) as conflict,
  row_number() over (partition by content_hash order by (split <> 'val')::int, path) as rk from h),
pl as (select content_hash, label, split, path, group_size, case when conflict then 'drop_conflict' when rk = 1 then 'keep' else 'drop_duplicate' end as action from g)"""


def _plan(spark, sf):
    d = _docs(spark, sf).select("text", F.col("doc_id").alias("path"), F.col("lang").alias("label"), _split().alias("split"))
    return audit.dedup_plan(audit.content_hashes(d, "text", ["path", "label", "split"]), "content_hash", "label", "split", "path")


@query("c2_dedup_plan", f"with {PLAN} select * from pl")
def c2(spark, sf):
    return _plan(spark, sf)


@query("c2_dedup_report", f"with {PLAN} select split, action, count(*) as n, count(*) filter (group_size > 1) as n_in_groups from pl group by all")
def c2r(spark, sf):
    return audit.dedup_report(_plan(spark, sf), "split")


COMP = f"""nd as (select doc_id as id, lang as label, {DOCSPLIT} as split, sha256(text) as k1, split_part(text, chr(10), 1) as k2 from documents),
e0 as (select a.id as a, b.m as b from nd a join (select k1, min(id) as m from nd group by k1) b on a.k1 = b.k1
  union select a.id, b.m from nd a join (select k2, min(id) as m from nd group by k2) b on a.k2 = b.k2),
ed as (select a, b from e0 where a <> b union select b, a from e0 where a <> b),
rc(id, root) as (select id, id from nd union select ed.b, rc.root from rc join ed on ed.a = rc.id),
cp as (select id, min(root) as component from rc group by id)"""


def _edges(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("k1"), F.split("text", "\n")[0].alias("k2"))
    from spanframe.session import durable

    keys = durable(d.select("id", "k1", F.sha2("k2", 256).alias("k2")))
    return components.star_edges(keys, "k1").unionByName(components.star_edges(keys, "k2"))


@query("c3_connected_components", f"with recursive {COMP} select id, component from cp where id in (select a from ed)")
def c3c(spark, sf):
    return components.connected_components(_edges(spark, sf))


@query(
    "c3_component_dedup",
    f"""with recursive {COMP}, j as (select nd.*, component from nd join cp using (id)),
    f as (select *, count(*) over (partition by component) as n, min(label) over (partition by component) <> max(label) over (partition by component) as conflict,
      row_number() over (partition by component order by (split <> 'val')::int, id) as rk from j)
    select id, label, split, component, case when n > 1 and conflict then 'component_has_conflicting_labels' when rk > 1 then 'duplicate_in_component' end as reason,
      not (n > 1 and conflict) and rk = 1 as keep from f""",
)
def c3(spark, sf):
    nodes = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), _split().alias("split"))
    return components.component_dedup(nodes, _edges(spark, sf))


@query(
    "c4_check_group_leakage",
    f"""select lower(source) as group_key, count(distinct sp) as n_splits, count(*) as n_rows, string_agg(distinct sp, ',' order by sp) as splits
    from (select source, {SPLIT3} as sp from documents) group by 1 having count(distinct sp) > 1""",
)
def c4(spark, sf):
    d = _docs(spark, sf).select("source", cohort.hash_split("doc_id", (0.7, 0.15, 0.15), "split-v1").alias("sp"))
    return audit.check_group_leakage(d, "source", "sp")


@query(
    "c5_check_constraints",
    """select 'unique_segment_name' as rule, lower(c_mktsegment) as key from customer group by 2 having count(*) > 1
    union all select 'contiguous_ids', min(p_partkey) || '..' || max(p_partkey) from part having min(p_partkey) <> 1 or max(p_partkey) - min(p_partkey) + 1 <> count(distinct p_partkey)
    union all select 'order_customer', k::varchar from (select distinct o_custkey as k from orders) where k not in (select c_custkey from customer where c_acctbal > 0)
    union all select 'brand_format', p_partkey::varchar from part where not regexp_matches(p_brand, '^Brand#[1-4][1-5]$')
    union all select 'status_value', o_orderkey::varchar from orders where o_orderstatus not in ('F', 'O')
    union all select 'score_range', l_orderkey::varchar from lineitem where l_discount * 11 not between 0 and 1
    union all select 'one_of_range_or_box', doc_id::varchar from labels where (quality = 1) = (toxic = 1)
    union all select 'dependent_required', event_id::varchar from events where event_type = 'purchase' and (value is null or value < 1)""",
)
def c5(spark, sf):
    t = lambda n: table(spark, sf, n)
    v, col = audit.violation, F.col
    return audit.all_violations([
        audit.unique_violations(t("customer"), "unique_segment_name", "c_mktsegment"),
        audit.contiguous_violations(t("part"), "contiguous_ids", "p_partkey"),
        audit.reference_violations(t("orders"), t("customer").filter("c_acctbal > 0"), "order_customer", "o_custkey", "c_custkey"),
        v(t("part"), "brand_format", ~col("p_brand").rlike("^Brand#[1-4][1-5]$"), col("p_partkey")),
        v(t("orders"), "status_value", ~col("o_orderstatus").isin("F", "O"), col("o_orderkey")),
        v(t("lineitem"), "score_range", ~(col("l_discount") * 11).between(0, 1), col("l_orderkey")),
        v(t("labels"), "one_of_range_or_box", (col("quality") == 1) == (col("toxic") == 1), col("doc_id")),
        v(t("events"), "dependent_required", (col("event_type") == "purchase") & (col("value").isNull() | (col("value") < 1)), col("event_id")),
    ])


@query(
    "c6_check_geometry",
    """select image_id, box_id, case when px1 < 0 or py1 < 0 then 'negative_origin' when px1 + w > 600 or py1 + h > 600 then 'outside_image' end as rule
    from v_box where px1 < 0 or py1 < 0 or px1 + w > 600 or py1 + h > 600""",
    ("v_box",),
)
def c6(spark, sf):
    b = view(spark, sf, "v_box").select("image_id", "box_id", F.col("px1").alias("x1"), F.col("py1").alias("y1"), "w", "h")
    images = b.select("image_id").distinct().withColumn("width", F.lit(600)).withColumn("height", F.lit(600))
    return audit.check_geometry(b, images)


@query(
    "c6_check_ranges",
    """select r.sample_id, idx, case when src_hi <= src_lo then 'empty_range' when src_lo < 0 or src_hi > s.n then 'outside_source' end as rule
    from v_region r join (select sample_id, file_size - 10 as n from v_size) s using (sample_id) where src_hi <= src_lo or src_lo < 0 or src_hi > s.n""",
    ("v_region", "v_size"),
)
def c6r(spark, sf):
    r = view(spark, sf, "v_region").select("sample_id", "idx", F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi"))
    s = view(spark, sf, "v_size").select("sample_id", (F.col("file_size") - 10).alias("n"))
    return audit.check_ranges(r, s)


@query("c7_profile_dataset", "select lang, source, count(*) as n, grouping_id(lang, source)::int as level from documents group by cube (lang, source)")
def c7(spark, sf):
    return audit.profile_dataset(_docs(spark, sf), "lang", "source")


@query("c7_size_histogram", "select lang, n_chars // 500 * 500 as bucket, count(*) as n from documents group by 1, 2")
def c7h(spark, sf):
    return audit.size_histogram(_docs(spark, sf), "lang", "n_chars", 500)


@query(
    "c7_duplicate_summary",
    f"""with g as (select sha256(text) as h, count(*) as n, count(distinct {DOCSPLIT}) > 1 as cr from documents group by 1 having count(*) > 1)
    select count(*) as n_groups, cast(sum(n) as bigint) as n_rows, count(*) filter (cr) as n_cross_split from g""",
)
def c7d(spark, sf):
    d = _docs(spark, sf).select(F.sha2("text", 256).alias("h"), _split().alias("split"))
    return audit.duplicate_summary(d, "h", "split")


LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::ubigint::hugeint) as s{i}" for i in range(4))


@query("c8_dataset_fingerprint", f"with r as (select sha256(concat_ws('|', doc_id, n_chars, sha256(text))) as h from documents), a as (select count(*) as n, {LANES} from r) select n, sha256(concat_ws('|', n, s0, s1, s2, s3)) as fingerprint from a")
def c8(spark, sf):
    d = _docs(spark, sf).select("doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    return audit.dataset_fingerprint(d, ["doc_id", "n_chars", "h"])


@query("c9_leaking_rows", r"select doc_id from documents where regexp_matches(text, '(?i)(^|[^0-9a-zA-Z_])[0-9a-f]{64}($|[^0-9a-zA-Z_])') union all select event_id + 1000000 from (select event_id, case when event_type = 'error' then sha256(props) else props end as p from events) where regexp_matches(p, '[0-9a-f]{64}')")
def c9(spark, sf):
    ev = table(spark, sf, "events").select((F.col("event_id") + 1000000).alias("doc_id"), F.when(F.col("event_type") == "error", F.sha2("props", 256)).otherwise(F.col("props")).alias("text"))
    both = _docs(spark, sf).select("doc_id", "text").unionByName(ev)
    return audit.leaking_rows(both).select("doc_id")


@query("c10_mask_tokens", "select doc_id, regexp_replace(text || ' ' || sha256(source), '[0-9a-f]{64}', '<sha>', 'g') as masked from documents")
def c10(spark, sf):
    return _docs(spark, sf).select("doc_id", cohort.mask_tokens(F.concat("text", F.lit(" "), F.sha2("source", 256))).alias("masked"))


@query(
    "c11_scan_secrets",
    """select doc_id, 'hex_token' as rule from documents where regexp_matches(text, 'token = "[0-9a-f]{40}"')
    union all select doc_id, 'private_key' from documents where regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')
    union all select doc_id, 'fine_grained_token' from documents where regexp_matches(text, 'github_pat_[A-Za-z0-9_]{20,}')
    union all select doc_id, 'classic_token' from documents where regexp_matches(text, 'ghp_[A-Za-z0-9]{30,}')
    union all select doc_id, 'cloud_key_id' from documents where regexp_matches(text, 'AKIA[0-9A-Z]{16}')
    union all select doc_id, 'executable_mz' from documents where text like 'MZ%'
    union all select doc_id, 'executable_elf' from documents where starts_with(text, chr(127) || 'ELF')""",
)
def c11(spark, sf):
    return audit.scan_secrets(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", {"hex_token": 'token = "[0-9a-f]{40}"'})


@query(
    "c11_scan_paths",
    """select page_id, 'suffix ' || s as rule from pages, (values """ + ", ".join(f"('{x}')" for x in audit.FORBIDDEN_SUFFIXES) + """) as t(s) where ends_with(lower(url || case when page_id < 50 then '.ZIP' else '' end), s)
    union all select page_id, 'prefix ' || p from pages, (values """ + ", ".join(f"('{x}')" for x in audit.FORBIDDEN_PREFIXES) + """) as t(p) where starts_with(lower(url), p)""",
)
def c11p(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") < 50, ".ZIP").otherwise("")).alias("url"))
    return audit.scan_paths(p, "page_id", "url")


AUD = f"""x as (select doc_id, n_chars, quality, {SPLIT3} as split from documents join labels using (doc_id)),
c as (select quality, avg(n_chars) as m from x where split = 'train' group by 1),
p as (select x.doc_id, x.split, x.quality, c.quality as guess, row_number() over (partition by x.doc_id order by abs(n_chars - m), c.quality) as rk from x cross join c)"""


def _audit(spark, sf):
    d = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "n_chars", "quality", cohort.hash_split("doc_id", (0.7, 0.15, 0.15), "split-v1").alias("split"))


@query("c12_shortcut_audit", f"with {AUD} select split, count(*) as n, round(avg((guess = quality)::int::double), 9) as accuracy, 1.0::double / (select count(*) from c) as chance from p where rk = 1 group by split")
def c12(spark, sf):
    return audit.shortcut_audit(_audit(spark, sf), "quality", "n_chars").withColumn("accuracy", F.round("accuracy", 9))


@query(
    "c12_split_summary",
    f"""with {AUD}, f as (select split, least(1.0, n_chars / 5000.0)::double as v from x)
    select split, count(*) as n, round(min(v), 9) as minimum, round(quantile_cont(v, 0.5), 9) as median, round(avg(v), 9) as mean, count(*) filter (v < 0.5) as below_0_5, count(*) filter (v < 0.1) as below_0_1 from f group by 1""",
)
def c12s(spark, sf):
    a = _audit(spark, sf).withColumn("v", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))
    out = audit.split_summary(a, "v")
    for c in ("minimum", "median", "mean"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query(
    "c13_reconcile",
    """with e as (select l_returnflag as grp, 'price' as metric, round(avg(l_extendedprice), 1) as v from lineitem group by 1 union all select l_returnflag, 'quantity', avg(l_quantity) from lineitem where l_returnflag <> 'R' group by 1),
    a as (select l_returnflag as grp, 'price' as metric, avg(l_extendedprice) as v from lineitem group by 1 union all select l_returnflag, 'quantity', avg(l_quantity) + case when l_returnflag = 'A' then 1 else 0 end from lineitem group by 1 union all select 'all', 'rows', count(*)::double from lineitem)
    select coalesce(e.grp, a.grp) as grp, coalesce(e.metric, a.metric) as metric, round(e.v, 6) as expected, round(a.v, 6) as actual,
    case when e.v is null then 'unexpected' when a.v is null then 'missing' when abs(e.v - a.v) < 0.1 then 'match' else 'differs' end as status from e full join a on a.grp = e.grp and a.metric = e.metric""",
)
def c13(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("grp"))
    q = g.agg(F.avg("l_quantity").alias("value")).withColumn("metric", F.lit("quantity"))
    p = g.agg(F.avg("l_extendedprice").alias("value")).withColumn("metric", F.lit("price"))
    expected = p.withColumn("value", F.round("value", 1)).unionByName(q.filter("grp <> 'R'"))
    actual = p.unionByName(q.withColumn("value", F.col("value") + F.when(F.col("grp") == "A", 1).otherwise(0)))
    actual = actual.unionByName(li.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("all").alias("grp"), "value", F.lit("rows").alias("metric")))
    out = audit.reconcile(expected, actual, ["grp", "metric"], 0.1)
    return out.withColumn("expected", F.round("expected", 6)).withColumn("actual", F.round("actual", 6))


@query(
    "c13_significance_changes",
    """with r as (select l_suppkey, count(*) as n, avg(l_tax - 0.04) as mean, stddev_samp(l_tax) as sd from lineitem group by 1)
    select l_suppkey, n, round(mean, 9) as mean, round(sd, 9) as sd, abs(mean) > 1.0 * sd / sqrt(n) as under_published, abs(mean) > 1.2 * sd / sqrt(n) as under_exact,
    (abs(mean) > 1.0 * sd / sqrt(n)) <> (abs(mean) > 1.2 * sd / sqrt(n)) as changes from r""",
)
def c13s(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("l_tax") - 0.04).alias("mean"), F.stddev_samp("l_tax").alias("sd"))
    out = audit.significance_changes(r, F.lit(1.0), F.lit(1.2))
    return out.withColumn("mean", round_double("mean", 9)).withColumn("sd", round_double("sd", 9))


RUNS = """kv as (select user_id, cast(ts as date)::varchar as day, ts, event_id, event_type from events where event_type <> 'error'),
lg as (select *, lag(event_type) over (partition by user_id, day order by ts, event_id) as pv from kv),
cr as (select user_id, day, event_id, event_type, row_number() over (partition by user_id, day order by ts, event_id) - 1 as pos from lg where pv is distinct from event_type)"""


def _collapsed(spark, sf):
    e = table(spark, sf, "events").filter("event_type <> 'error'").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "event_type")
    return events.collapse_runs(e, ["user_id", "day"], F.hour("ts"), ["ts", "event_id"], "event_type")


@query("c16_collapse_runs", f"with {RUNS} select * from cr")
def c16(spark, sf):
    return _collapsed(spark, sf).select("user_id", "day", "event_id", "event_type", F.col("pos").cast("bigint").alias("pos"))


@query(
    "c16_dedup_sequences",
    f"""with {RUNS}, sq as (select user_id, day, count(*) as length, string_agg(event_type, '>' order by pos) as s from cr group by 1, 2)
    select user_id, min(day) as day, length, count(*) as copies from sq group by user_id, s, length""",
)
def c16d(spark, sf):
    digests = events.sequence_digest(_collapsed(spark, sf), ["user_id", "day"], "event_type")
    return events.dedup_sequences(digests, ["user_id"], ["user_id", "day"]).drop("digest")


@query(
    "c17_sequence_profile",
    """select event_type, count(*) as n_calls, cast(sum(length(props)) as bigint) as n_chars, greatest(cast(sum(length(props)) as bigint) - 16384, 0) as truncated, greatest(16384 - cast(sum(length(props)) as bigint), 0) as repeated from events group by 1""",
)
def c17(spark, sf):
    return events.sequence_profile(table(spark, sf, "events"), "event_type", "props")


@query(
    "c17_character_codes",
    "select event_id, i as at, least(255, floor(ascii(substr(event_type, (i + 1)::int, 1)) * 256 / 128))::int as code from (select event_id, event_type, unnest(range(length(event_type)))::int as i from events)",
)
def c17c(spark, sf):
    return events.character_codes(table(spark, sf, "events"), ["event_id"], "event_type")


#: Events as reports of 64 numbers with a process per user class; a few names are not ASCII or blank.
CALLS = """e as (select event_id // 64 as report, user_id % 3 as process, event_id, case event_type when 'click' then 'process' when 'signup' then 'registry' when 'purchase' then 'network' when 'view' then 'filesystem' end as category,
    case when event_id % 640 = 7 then 'Ouvré' when event_id % 960 = 11 then ' ' when value < 50 then 'Open' else 'Close' end as api from events),
wrong as (select report, arg_min(case when api = ' ' then 'api is no text' else 'api is not ASCII' end, process * 1000000000000 + event_id) as fault
    from e where category is not null and api in (' ', 'Ouvré') group by 1)"""


def _reports(spark, sf):
    """JSON documents of at most 64 events each."""
    kinds = {"click": "process", "signup": "registry", "purchase": "network", "view": "filesystem"}
    category = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("misc"))
    api = F.when(F.col("event_id") % 640 == 7, "Ouvré").when(F.col("event_id") % 960 == 11, " ").when(F.col("value") < 50, "Open").otherwise("Close")
    call = F.struct("event_id", category.alias("category"), api.alias("api"), F.struct(F.col("props").alias("value")).alias("arguments"))
    e = table(spark, sf, "events").select(F.expr("event_id div 64").alias("report"), (F.col("user_id") % 3).alias("process"), call.alias("call"))
    processes = e.groupBy("report", "process").agg(F.sort_array(F.collect_list("call")).alias("calls"))
    whole = processes.groupBy("report").agg(F.sort_array(F.collect_list(F.struct("process", "calls"))).alias("processes"))
    return whole.select("report", F.to_json(F.struct(F.struct("processes").alias("behavior"))).alias("json"))


@query(
    "c16_behavior_reports",
    f"""with {CALLS} select e.report, any_value(fault) as fault, count(*) filter (fault is null and category is null) as ignored,
    count(*) filter (fault is null and category is not null) as n_calls from e left join wrong using (report) group by 1""",
)
def c16r(spark, sf):
    read = behavior.read_behavior_reports(_reports(spark, sf), "report", "json")
    return read.select("report", "fault", "ignored", F.size("calls").cast("bigint").alias("n_calls"))


@query(
    "c17_behavior_profile",
    f"""with {CALLS}, k as (select * from e where category is not null and report not in (select report from wrong)),
    lg as (select *, category || ':' || api as what, lag(category || ':' || api) over (partition by report, process order by event_id) as pv from k),
    cr as (select * from lg where what is distinct from pv),
    sq as (select report, process, string_agg(what, '>' order by event_id) as s from cr group by 1, 2),
    firsts as (select report, min(process) as process from sq group by report, s),
    n as (select report, category, count(*) as n_calls, cast(sum(length(api)) as bigint) as n_chars from cr join firsts using (report, process) group by 1, 2)
    select *, greatest(n_chars - 16384, 0) as truncated, greatest(16384 - n_chars, 0) as repeated from n""",
)
def c17b(spark, sf):
    read = behavior.read_behavior_reports(_reports(spark, sf), "report", "json")
    return events.sequence_profile(behavior.behavior_sequences(read), ["report", "category"], "api")
