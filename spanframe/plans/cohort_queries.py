"""Cohort curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.rounding import round_double
from spanframe.operators import cohort as co
from spanframe.operators import sequence
from spanframe.plans.registry import query
from spanframe.plans.sql_parts import ENTROPY
from spanframe.plans.views import table, view

U16 = "('0x' || substr(sha256(concat_ws('|', 'split-v1', doc_id)), 1, 16))::ubigint::double / 18446744073709551616.0"
SPLIT3 = f"case when {U16} < 0.7 then 'train' when {U16} < 0.7::double + 0.15::double then 'validation' else 'test' end"


@query(
    "a1_read_candidates",
    """select c_custkey as sample_id, c_mktsegment as segment, list_filter([case when c_acctbal::int % 3 > 0 then 'first' end, case when c_nationkey % 4 > 0 then 'second' end], lambda x: x is not null) as tags,
    concat(c_acctbal::int % 3, ',', c_nationkey % 4) as counts from customer where c_acctbal > 0""",
)
def a1(spark, sf):
    c = table(spark, sf, "customer").withColumn("first_n", F.bround("c_acctbal").cast("int") % 3).withColumn("second_n", F.col("c_nationkey") % 4)
    out = co.read_candidates(c, ["c_custkey", "c_acctbal", "c_nationkey"], F.col("c_acctbal") > 0,
                             {"first": "first_n", "second": "second_n"}, {"sample_id": "c_custkey", "segment": "c_mktsegment"})
    return out.select("sample_id", "segment", "tags", F.concat_ws(",", F.col("tag_counts")["first"], F.col("tag_counts")["second"]).alias("counts"))


def _ord_split():
    return co.temporal_split(F.col("o_orderdate"), (F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")))


ORD_SPLIT = "case when o_orderdate < timestamp '1997-01-01' then 'train' when o_orderdate < timestamp '1999-01-01' then 'validation' else 'test' end"


@query("b1_temporal_split", f"select o_orderkey, {ORD_SPLIT} as split from orders")
def b1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", _ord_split().alias("split"))


@query("b2_hash_split", f"select doc_id, {SPLIT3} as split from documents")
def b2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", co.hash_split("doc_id", (0.7, 0.15, 0.15), "split-v1").alias("split"))


TAGS = ("A", "N", "R")
TAGC = """tc as (select l_orderkey as sample_id, sum((l_returnflag = 'A')::int)::int as a, sum((l_returnflag = 'N')::int)::int as n, sum((l_returnflag = 'R')::int)::int as r from lineitem group by 1)"""


def _tag_text(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        *[F.sum((F.col("l_returnflag") == t).cast("int")).cast("int").alias(t) for t in TAGS]
    )
    # a text with a stray part and an unreadable number, as files hold them
    return li.select("sample_id", F.concat_ws(";", *[F.concat(F.lit(f"{t}="), F.col(t)) for t in TAGS], F.lit("odd"), F.lit("X=many")).alias("text"))


@query(
    "b3_tag_counts",
    f"""with {TAGC} select sample_id, concat_ws(';', case when a <> 0 then 'A=' || a end, case when n <> 0 then 'N=' || n end, case when r <> 0 then 'R=' || r end) as formatted,
    case when greatest(a, n, r) = 0 then null when a >= n and a >= r then 'A' when n >= r then 'N' else 'R' end as dominant, 3 as n_tags from tc""",
)
def b3(spark, sf):
    m = _tag_text(spark, sf).withColumn("m", co.parse_tag_counts(F.col("text")))
    return m.select("sample_id", co.format_tag_counts(F.col("m"), TAGS).alias("formatted"), co.dominant_tag(F.col("m"), TAGS).alias("dominant"), F.size("m").alias("n_tags"))


TERT = f"""os as (select o_orderkey as sample_id, {ORD_SPLIT} as split, o_custkey % 97 as cnt, o_orderpriority as prio from orders),
oq as (select *, row_number() over (partition by split order by cnt) - 1 as i, count(*) over (partition by split) as n from os),
tt as (select split, max(cnt) filter (i = least(n - 1, n // 3)) as t1, max(cnt) filter (i = least(n - 1, 2 * n // 3)) as t2, max(n) as n from oq group by split)"""


def _pool(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), _ord_split().alias("split"), (F.col("o_custkey") % 97).alias("cnt"), "o_orderpriority", "o_orderstatus")


@query("b4_count_tertiles", f"with {TERT} select split, t1, t2, n from tt")
def b4(spark, sf):
    return co.count_tertiles(_pool(spark, sf), ["split"], "cnt")


@query("b4_count_stratum", f"with {TERT} select sample_id, os.split, case when cnt <= t1 then 'low' when cnt <= t2 then 'mid' else 'high' end as stratum from os join tt using (split)")
def b4s(spark, sf):
    p = _pool(spark, sf)
    t = co.count_tertiles(p, ["split"], "cnt")
    return p.join(F.broadcast(t), "split").select(  # one row per split
        "sample_id", "split", co.count_stratum(F.col("cnt"), F.col("t1"), F.col("t2")).alias("stratum"))


RR_TAGS = ("urgent", "high", "pending")
TARGET = 60


def _strata(spark, sf):
    p = _pool(spark, sf)
    t = co.count_tertiles(p, ["split"], "cnt")
    tags = F.array_compact(F.array(
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderpriority") == "2-HIGH", "high"), F.when(F.col("o_orderstatus") == "P", "pending")
    ))
    return p.join(F.broadcast(t), "split").select(  # one row per split
        "sample_id", "split", tags.alias("tags"), co.count_stratum(F.col("cnt"), F.col("t1"), F.col("t2")).alias("stratum"))


@query("b5_stratified_round_robin")
def b5(spark, sf):
    return co.stratified_round_robin(_strata(spark, sf), TARGET, "rr", RR_TAGS)


@query(
    "b6_reserve_pool",
    f"""with os as (select o_orderkey as sample_id, {ORD_SPLIT} as split, o_orderstatus = 'P' as picked from orders),
    r as (select sample_id, split, row_number() over (partition by split order by sha256('rr' || sample_id), sample_id) as rank from os where not picked) select * from r where rank <= 200""",
)
def b6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), _ord_split().alias("split"), "o_orderstatus")
    return co.reserve_pool(o, o.filter("o_orderstatus = 'P'"), 1000, "rr")


@query(
    "b7_cap_per_group",
    """with r as (select doc_id, source, row_number() over (partition by source order by sha256(concat_ws('|', 'cap', doc_id)), doc_id) as rank from documents) select * from r where rank <= 20""",
)
def b7(spark, sf):
    return co.cap_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", 20, "cap", "doc_id")


HOLD = """x as (select d.doc_id, d.source || '-' || d.lang || '-' || l.quality as label from documents d join labels l using (doc_id)),
s as (select label, count(*) as n, least(25, greatest(1, round_even(count(*) * 0.2::double, 0)::bigint)) as quota from x group by 1),
r as (select x.*, row_number() over (partition by label order by sha256(concat_ws('|', 'hold', doc_id)), doc_id) as rk from x)"""


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.concat_ws("-", "source", "lang", "quality").alias("label"))


@query("b8_stratified_holdout", f"with {HOLD} select doc_id, label from r join s using (label) where n > quota and rk <= quota")
def b8(spark, sf):
    return co.stratified_holdout(_labelled(spark, sf), "label", 25, 0.2, "hold", "doc_id")[0].select("doc_id", "label")


@query("b8_refused_classes", f"with {HOLD} select label, n, quota from s where n <= quota")
def b8r(spark, sf):
    return co.stratified_holdout(_labelled(spark, sf), "label", 25, 0.2, "hold", "doc_id")[1]


def _manifest(spark, sf):
    m = view(spark, sf, "v_manifest")
    reason = F.when((F.col("role") == "primary") & (F.col("sample_id") % 23 == 0), "selection:withdrawn")
    return m.withColumn("exclusion_reason", reason).withColumn("replaces", F.lit(None).cast("bigint"))


ERR = "case when sample_id % 3 = 0 then 'HTTPError: status 404 for ' || sha256(sample_id::varchar) when sample_id % 3 = 1 then 'timeout: gone' else '' end"


def _outcomes(spark, sf):
    s = F.col("sample_id")
    err = F.when(s % 3 == 0, F.concat(F.lit("HTTPError: status 404 for "), F.sha2(s.cast("string"), 256))).when(s % 3 == 1, "timeout: gone").otherwise("")
    # small orders were not covered by this stage
    return view(spark, sf, "v_manifest").filter("size >= 60000").select("sample_id", "ok", F.when(~F.col("ok"), err).alias("error"))


MANI = f"""mf as (select *, case when role = 'primary' and sample_id % 23 = 0 then 'selection:withdrawn' end as ex from v_manifest),
fl as (select sample_id, split, row_number() over (partition by split order by pos) as k, 'preflight:' || case when sample_id % 3 = 0 then 'HTTPError: status 404 for <sha>' when sample_id % 3 = 1 then 'timeout: gone' else 'unknown' end as reason
  from mf where role = 'primary' and ex is null and not ok and size >= 60000),
rv as (select sample_id, split, row_number() over (partition by split order by pos) as k from mf where role = 'reserve'),
sw as (select rv.sample_id, fl.sample_id as old from rv join fl on fl.split = rv.split and fl.k = rv.k),
pm as (select mf.sample_id, mf.split, mf.pos, case when sw.old is not null then 'replacement' else role end as role, coalesce(fl.reason, ex) as exclusion_reason, sw.old as replaces
  from mf left join fl on fl.sample_id = mf.sample_id left join sw on sw.sample_id = mf.sample_id)"""


@query("b9_effective_rows", f"with {MANI} select sample_id, split, pos from mf where role = 'primary' and ex is null", ("v_manifest",))
def b9(spark, sf):
    return co.effective_rows(_manifest(spark, sf)).select("sample_id", "split", "pos")


@query("b10_promote_reserves", f"with {MANI} select * from pm", ("v_manifest",))
def b10(spark, sf):
    out = co.promote_reserves(_manifest(spark, sf), _outcomes(spark, sf), "preflight")
    return out.select("sample_id", "split", "pos", "role", "exclusion_reason", "replaces")


@query(
    "b10_promotion_report",
    f"""with {MANI} select split, count(*) filter (exclusion_reason like 'preflight:%') as excluded, count(*) filter (role = 'replacement') as promoted,
    count(*) filter (role in ('primary', 'replacement') and exclusion_reason is null) as effective_after, count(*) filter (role = 'reserve') as reserve_remaining,
    count(*) filter (exclusion_reason like 'preflight:%') > count(*) filter (role = 'replacement') as reserve_exhausted from pm group by split""",
    ("v_manifest",),
)
def b10r(spark, sf):
    m = _manifest(spark, sf)
    return co.promotion_report(m, co.promote_reserves(m, _outcomes(spark, sf), "preflight"))


@query("b11_budget_guard", "select cast(sum(q) as bigint) as total, sum(q) > 1000000 as refused from v_line where l_linestatus = 'O'", ("v_line",))
def b11(spark, sf):
    return co.budget_guard(view(spark, sf, "v_line"), "q", F.col("l_linestatus") == "O", 1_000_000)


@query(
    "b11_budget_prefix",
    """with r as (select sample_id, idx, q, cast(sum(q) over (order by sample_id, idx rows unbounded preceding) as bigint) as running_total from v_line) select * from r where running_total <= 700000""",
    ("v_line",),
)
def b11p(spark, sf):
    return co.budget_prefix(view(spark, sf, "v_line").select("sample_id", "idx", "q"), ["sample_id", "idx"], "q", 700_000)


@query(
    "b12_bucket_errors",
    """with e as (select case when event_type = 'error' then 'ValueError: bad ' || props || ' at ' || sha256(user_id::varchar) when event_type = 'click' then 'timeout after ' || props || repeat('x', 200) else '' end as error from events),
    m as (select case when error = '' then 'unknown' else regexp_replace(regexp_replace(error, '[0-9a-f]{64}', '<sha>', 'g'), '^[A-Za-z_]\\w*(?:Error|Exception): ', '') end as t from e)
    select substr(t, 1, 160) as bucket, count(*) as n from m group by 1""",
)
def b12(spark, sf):
    t = F.col("event_type")
    err = F.when(t == "error", F.concat(F.lit("ValueError: bad "), "props", F.lit(" at "), F.sha2(F.col("user_id").cast("string"), 256))).when(
        t == "click", F.concat(F.lit("timeout after "), "props", F.repeat(F.lit("x"), 200))).otherwise("")
    return co.bucket_errors(table(spark, sf, "events").select(err.alias("error")), "error")


@query("b12_reason_counts", f"with {MANI} select case when exclusion_reason is null then 'unknown' else split_part(exclusion_reason, ':', 1) end as reason, count(*) as n from pm group by 1", ("v_manifest",))
def b12r(spark, sf):
    return co.reason_counts(co.promote_reserves(_manifest(spark, sf), _outcomes(spark, sf), "preflight"), "exclusion_reason")


PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
LSET = f"""os as (select o_orderkey, {ORD_SPLIT} as split, case when o_custkey % 11 = 0 then null when o_custkey % 7 = 0 then o_orderpriority else case when o_custkey % 2 = 0 then '1-URGENT' else '2-HIGH' end end as label from orders),
su as (select label, count(*) as s from os where split = 'train' group by 1),
nm as (select * from (values {', '.join(f"('{p}', {i})" for i, p in enumerate(PRIO))}) as p(label, pos)),
cl as (select nm.label, pos, coalesce(s, 0) as s, coalesce(s, 0) >= 150 as kept from nm left join su on su.label = nm.label),
cs as (select label, s as train_support, case when kept then label when (select bool_or(not kept and s > 0) from cl) then 'other' end as class_name,
  case when kept then (sum(kept::int) over (order by pos rows unbounded preceding) - 1)::int when (select bool_or(not kept and s > 0) from cl) then (select sum(kept::int) from cl)::int end as class_index from cl)"""


def _prio(spark, sf):
    k = F.col("o_custkey")
    label = F.when(k % 11 == 0, None).when(k % 7 == 0, F.col("o_orderpriority")).when(k % 2 == 0, "1-URGENT").otherwise("2-HIGH")
    return table(spark, sf, "orders").select("o_orderkey", _ord_split().alias("split"), label.alias("label"))


@query("b13_label_classes", f"with {LSET} select label, train_support, class_name, class_index from cs")
def b13c(spark, sf):
    return co.label_set(_prio(spark, sf), "label", PRIO, 150)[0]


@query("b13_label_set", f"with {LSET} select o_orderkey, split, os.label, class_name, class_index from os left join cs on cs.label = os.label")
def b13(spark, sf):
    return co.label_set(_prio(spark, sf), "label", PRIO, 150)[1]


@query("b13_label_summary", f"with {LSET} select split, count(*) as n, count(class_index) as trainable from os left join cs on cs.label = os.label group by split")
def b13s(spark, sf):
    return co.label_summary(co.label_set(_prio(spark, sf), "label", PRIO, 150)[1])


@query(
    "b14_class_weights",
    """with c as (select unnest(range(4))::int as quality), n as (select quality, count(*) as n from labels group by 1), t as (select c.quality, coalesce(n, 0) as n from c left join n on n.quality = c.quality)
    select quality, n, round(case when n > 0 then (select sum(n) from t)::double / (4 * n) else 0 end, 9) as weight from t""",
)
def b14(spark, sf):
    classes = spark.range(4).select(F.col("id").cast("int").alias("quality"))
    return co.class_weights(table(spark, sf, "labels"), "quality", classes).withColumn("weight", round_double("weight", 9))


@query("b15_pseudonymize", "select doc_id, source, printf('case-%03d', row_number() over (order by sha256(doc_id::varchar))) as case from documents")
def b15(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").withColumn("h", F.sha2(F.col("doc_id").cast("string"), 256))
    return co.pseudonymize(d, ["h"]).drop("h")


def pick(n: str, what: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', 'pair', '{what}', sample_id, attempt)), 1, 13))::ubigint::bigint % ({n}))"


PAIR = f"""{ENTROPY}, sm as (select doc_id as sample_id, lang as grp, n_chars as n from documents),
dn as (select sample_id, grp, row_number() over (partition by grp order by sample_id) as no from sm where n >= 256),
de as (select d.doc_id as sample_id, unnest(['head', 'tail']) as k, unnest([substr(text, ((n_chars - 256) // 2 + 1)::int, 64), substr(text, ((n_chars - 256) // 2 + 193)::int, 64)]) as t from documents d where n_chars >= 256),
dc as (select sample_id, k, unnest(string_split(t, '')) as c from de),
dh as (select sample_id, k, c, count(*) as n from dc group by all),
dk as (select sample_id, k, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) as e from dh group by all),
dx as (select sample_id, max(e) filter (k = 'head') as head, max(e) filter (k = 'tail') as tail from dk group by 1),
gr as (select grp, max(no) as size, row_number() over (order by grp) - 1 as g, count(*) over () as groups from dn group by grp),
ho as (select sm.*, size, g, groups, dn.no as own, unnest(range(32)) as attempt from sm join gr using (grp) left join dn on dn.sample_id = sm.sample_id where n >= 768),
t1 as (select *, least({pick('n - 256 + 1', 'start')} // 64 * 64, (n - 256) // 64 * 64) as start, {pick('groups - 1', 'group')} as oo, {pick('size - 1', 'native')} as mm from ho where groups > 1 and size > 1),
t2 as (select t1.*, gr.grp as donor_grp, gr.size as osize from t1 join gr on gr.g = oo + (oo >= t1.g)::int),
t3 as (select *, {pick('osize', 'foreign')} + 1 as fno, mm + 1 + (mm + 1 >= own)::int as nno from t2),
t4 as (select t3.*, c.sample_id as cross_id, cx.head as ch, cx.tail as ct, s.sample_id as same_id, sx.head as sh, sx.tail as st, lb.entropy as hb, ra.entropy as ha
  from t3 join dn c on c.grp = t3.donor_grp and c.no = fno join dx cx on cx.sample_id = c.sample_id
  join dn s on s.grp = t3.grp and s.no = nno join dx sx on sx.sample_id = s.sample_id
  left join ent lb on lb.sample_id = t3.sample_id and lb.tile = start // 64 - 1 left join ent ra on ra.sample_id = t3.sample_id and ra.tile = (start + 256) // 64),
t5 as (select *, coalesce(greatest(case when start > 0 then abs(coalesce(hb, 0) - ch) end, case when start + 256 < n then abs(coalesce(ha, 0) - ct) end), 0) as cseam,
  coalesce(greatest(case when start > 0 then abs(coalesce(hb, 0) - sh) end, case when start + 256 < n then abs(coalesce(ha, 0) - st) end), 0) as sseam from t4),
t6 as (select *, row_number() over (partition by sample_id order by attempt) as rk from t5 where cseam <= 0.3 and sseam <= 0.3),
pairs as (select sample_id, grp, attempt, start, cross_id, same_id, round(cseam, 6) as cross_seam, round(sseam, 6) as same_seam from t6 where rk = 1)"""


def _pairs(spark, sf):
    d = table(spark, sf, "documents")
    samples = d.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("grp"), F.col("n_chars").alias("n"))
    tiles = sequence.tile_entropy(d.select("doc_id", "text"), "doc_id", "text", 64).withColumn("entropy", round_double("entropy", 9))
    ends = tiles.select("sample_id", ((F.col("tile") + 1) * 64).alias("pos"), F.col("entropy").alias("before"))
    starts = tiles.select("sample_id", (F.col("tile") * 64).alias("pos"), F.col("entropy").alias("after"))
    edges = ends.join(starts, ["sample_id", "pos"], "full")
    at = F.expr("int((n_chars - 256) div 2)")
    piece = d.filter("n_chars >= 256").select(F.col("doc_id").alias("sample_id"), F.col("text").substr(at + 1, F.lit(64)).alias("h"), F.col("text").substr(at + 193, F.lit(64)).alias("t"))
    donor = piece.select("sample_id", round_double(sequence.text_entropy(F.col("h")), 9).alias("head"), round_double(sequence.text_entropy(F.col("t")), 9).alias("tail"))
    return co.matched_pairs(samples, edges, donor, 256, 64, "pair")


@query("b16_matched_pairs", f"with {PAIR} select * from pairs")
def b16(spark, sf):
    return _pairs(spark, sf)[0].withColumn("cross_seam", round_double("cross_seam", 6)).withColumn("same_seam", round_double("same_seam", 6))


@query("b16_pair_rejections", f"with {PAIR} select sample_id, grp, case when n < 768 then 'host_too_short' else 'no_pair_within_seam_limit' end as reason from sm where sample_id not in (select sample_id from pairs)")
def b16r(spark, sf):
    return _pairs(spark, sf)[1]


SNAP = """lf as (select doc_id as sample_id, lang as label, case when length(source) = 4 then 'val' else 'train' end as split from documents where n_chars >= 400),
rt as (select doc_id as sample_id, case when toxic = 1 then 'xx' else lang end as label, case when length(source) = 4 and quality = 1 then 'val' else 'train' end as split from documents join labels using (doc_id))"""


def _snapshots(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "lang", "source", "n_chars")
    val = F.length("source") == 4
    left = d.filter("n_chars >= 400").select("sample_id", F.col("lang").alias("label"), F.when(val, "val").otherwise("train").alias("split"))
    right = d.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "sample_id"), "sample_id").select(
        "sample_id", F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang")).alias("label"), F.when(val & (F.col("quality") == 1), "val").otherwise("train").alias("split"))
    return left, right


@query(
    "b17_pair_representations",
    f"""with {SNAP} select coalesce(lf.sample_id, rt.sample_id) as sample_id, case when rt.sample_id is null then 'only_left' when lf.sample_id is null then 'only_right'
    when lf.label <> rt.label then 'label_mismatch' when lf.split <> rt.split then 'split_mismatch' else 'matched' end as status,
    lf.label as left_label, rt.label as right_label, lf.split as left_split, rt.split as right_split from lf full join rt on rt.sample_id = lf.sample_id""",
)
def b17(spark, sf):
    return co.pair_representations(*_snapshots(spark, sf))
