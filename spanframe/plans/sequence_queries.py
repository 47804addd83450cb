"""Sequence features and spans on documents and event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.rounding import round_double
from spanframe.operators import headers, intervals, sequence, spans
from spanframe.plans import flagship
from spanframe.plans.registry import query
from spanframe.plans.sql_parts import CHARS, ENTROPY, MERGED, RANKS, SPANS
from spanframe.plans.views import table

BYTES = CHARS + """,
hc as (select sample_id, pos, hex(encode(c)) as h from ch),
hb as (select sample_id, pos, h, unnest(range(length(h) // 2)) as k from hc),
bt as (select sample_id, row_number() over (partition by sample_id order by pos, k) - 1 as pos, ('0x' || substr(h, 2 * k + 1, 2))::integer as b from hb)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))


@query("e1_symbol_histogram", f"with {CHARS} select sample_id, 0::bigint as tile, unicode(c)::bigint as code, count(*) as cnt from ch group by all")
def e1(spark, sf):
    return sequence.symbol_histogram(_docs(spark, sf), "doc_id", "text")


@query("e1_symbol_probabilities", f"with {CHARS}, h as (select sample_id, unicode(c)::bigint as code, count(*) as n from ch group by all) select sample_id, code, round(n / sum(n) over (partition by sample_id), 9) as p from h")
def e1p(spark, sf):
    d = _docs(spark, sf)
    p = sequence.symbol_probabilities(sequence.symbol_histogram(d, "doc_id", "text"), d.select(F.col("doc_id").alias("sample_id")))
    return p.withColumn("p", round_double("p", 9))


@query("e2_tile_entropy", f"with {ENTROPY} select * from ent")
def e2(spark, sf):
    return sequence.tile_entropy(_docs(spark, sf), "doc_id", "text", 64).withColumn("entropy", round_double("entropy", 9))


@query("e2_block_entropy", f"with {ENTROPY} select sample_id, tile, entropy from ent where n_units = 64")
def e2a(spark, sf):
    return sequence.block_entropy(_docs(spark, sf), "doc_id", "text", 64).select("sample_id", "tile", round_double("entropy", 9).alias("entropy"))


@query("e2_entropy_guide", f"with {ENTROPY} select sample_id, tile, round(entropy / 8.0, 6) as guide from ent")
def e2c(spark, sf):
    g = sequence.entropy_guide(_docs(spark, sf), "doc_id", "text", 64)
    return g.select("sample_id", "tile", round_double(round_double("entropy", 9) / 8.0, 6).alias("guide"))


@query(
    "e3_row_statistics",
    f"""with {BYTES}, n as (select sample_id, count(*) as nb from bt group by all),
    padded as (select sample_id, pos, b from bt union all select sample_id, unnest(range(nb, ((nb + 511) // 512) * 512)), 0 from n),
    h as (select sample_id, pos // 512 as row, b, count(*) as c from padded group by all)
    select sample_id, row, round(sum(b * c) / 512.0 / 255.0, 9) as mean, round((9 - sum(c * log2(c)) / 512.0) / 8.0, 9) as entropy, round(count(*) / 256.0, 9) as "distinct" from h group by all""",
)
def e3(spark, sf):
    r = sequence.row_statistics(_bytes(spark, sf), "doc_id", "content")
    return r.select("sample_id", "row", *[round_double(c, 9).alias(c) for c in ("mean", "entropy", "distinct")])


@query(
    "e4_hashed_bigram_features",
    f"""with {BYTES}, pr as (select sample_id, b, lead(b) over (partition by sample_id order by pos) as nx from bt),
    f as (select sample_id, b::bigint as index, 0 as kind from bt union all select sample_id, 256 + (b * 256 + nx) % 1024, 1 from pr where nx is not null),
    c as (select sample_id, kind, index, count(*) as n from f group by all)
    select sample_id, index, round(n / sum(n) over (partition by sample_id, kind), 9) as value from c""",
)
def e4(spark, sf):
    return sequence.hashed_bigram_features(_bytes(spark, sf), "doc_id", "content").withColumn("value", round_double("value", 9))


@query(
    "e5_boundary_score",
    f"""with {ENTROPY} select sample_id, tile, round(greatest(coalesce(abs(entropy - lag(entropy) over w), 0.0), coalesce(abs(entropy - lead(entropy) over w), 0.0)), 9) as boundary
    from ent window w as (partition by sample_id order by tile)""",
)
def e5(spark, sf):
    t = sequence.tile_entropy(_docs(spark, sf), "doc_id", "text", 64).withColumn("entropy", round_double("entropy", 9))
    return sequence.boundary_score(t).select("sample_id", "tile", round_double("boundary", 9).alias("boundary"))


HOURLY = """hr as (select event_type as key, cast((extract(day from ts) - 1) * 24 + extract(hour from ts) as bigint) as row, avg(value) as value from events group by all)"""


def _hourly(spark, sf):
    hour = ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("bigint")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("key"), hour.alias("row")).agg(F.avg("value").alias("value"))


@query(
    "e6_boundary_contrast",
    f"""with {HOURLY}, cuts as (select distinct key, row // 24 * 24 as cut from hr),
    j as (select c.key, c.cut, h.row < c.cut as before, h.value from cuts c join hr h on h.key = c.key and h.row >= c.cut - 8 and h.row < c.cut + 8),
    a as (select key, cut, avg(value) filter (before) as ma, avg(value) filter (not before) as mb, var_pop(value) filter (before) as va, var_pop(value) filter (not before) as vb,
      count(*) filter (before) as n_before, count(*) filter (not before) as n_after from j group by all)
    select key, cut, n_before, n_after, round(abs(ma - mb) / case when sqrt((va + vb) / 2) = 0 then 1e-9 else sqrt((va + vb) / 2) end, 6) as contrast from a""",
)
def e6(spark, sf):
    rows = _hourly(spark, sf)
    cuts = rows.select("key", (F.floor(F.col("row") / 24) * 24).alias("cut")).distinct()
    return sequence.boundary_contrast(rows, cuts).withColumn("contrast", round_double("contrast", 6))


@query(
    "e7_seam_delta",
    """with p as (select d.doc_id, d.text as host, b.text as graft, (d.n_chars // 2) as s, length(b.text) as g, d.n_chars as n from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)),
    w as (select doc_id, 'b' as k, substr(host, (greatest(s - 2048, 0) + 1)::int, (s - greatest(s - 2048, 0))::int) as t from p
      union all select doc_id, 'a', substr(host, (s + g + 1)::int, 2048) from p
      union all select doc_id, 'gh', substr(graft, 1, 2048) from p
      union all select doc_id, 'gt', substr(graft, (greatest(g - 2048, 0) + 1)::int, 2048) from p),
    c as (select doc_id, k, unnest(string_split(t, '')) as ch from w where length(t) > 0),
    h as (select doc_id, k, ch, count(*) as n from c group by all),
    e as (select doc_id, k, log2(sum(n)) - sum(n * log2(n)) / sum(n) as en from h group by all),
    x as (select p.doc_id, s, g, n, coalesce(max(en) filter (k = 'b'), 0) as b, coalesce(max(en) filter (k = 'a'), 0) as a, coalesce(max(en) filter (k = 'gh'), 0) as gh, coalesce(max(en) filter (k = 'gt'), 0) as gt
      from p left join e on e.doc_id = p.doc_id group by p.doc_id, s, g, n)
    select doc_id, round(coalesce(greatest(case when s > 0 then abs(b - gh) end, case when s + g < n then abs(a - gt) end), 0.0), 9) as seam_delta from x""",
)
def e7(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("graft"))
    d = table(spark, sf, "documents").join(F.broadcast(b.agg(F.count(F.lit(1)).alias("items"))))  # one row
    d = d.select("doc_id", "text", (F.col("doc_id") % F.col("items")).alias("item_id"), F.expr("n_chars div 2").alias("start"))
    return sequence.seam_delta(d.join(b, "item_id"), "text", "graft", "start").select("doc_id", round_double("seam_delta", 9).alias("seam_delta"))


@query(
    "e8_in_distribution",
    f"""with {ENTROPY}, o as (select sample_id, quantile_cont(entropy::double, 0.05) as lo, quantile_cont(entropy::double, 0.5) as md, quantile_cont(entropy::double, 0.95) as hi from ent where n_units = 64 group by all),
    w as (select sample_id, c, sum(n) as n from hist group by all),
    f as (select sample_id, 'histogram' as fill, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) as en from w group by all union all select sample_id, 'zero', 0.0 from o)
    select f.sample_id, f.fill, en as fill_entropy, round(lo, 6) as sample_low, round(md, 6) as sample_median, round(hi, 6) as sample_high, en between lo and hi as in_distribution from f join o using (sample_id)""",
)
def e8(spark, sf):
    d = _docs(spark, sf)
    observed = sequence.block_entropy(d, "doc_id", "text", 64).withColumn("entropy", round_double("entropy", 9))
    whole = sequence.symbol_histogram(d, "doc_id", "text").groupBy("sample_id").agg(
        round_double(F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")) / F.sum("cnt"), 9).alias("entropy")
    )
    fills = whole.withColumn("fill", F.lit("histogram")).unionByName(
        observed.select("sample_id").distinct().select("sample_id", F.lit(0.0).alias("entropy"), F.lit("zero").alias("fill"))
    )
    out = sequence.in_distribution(fills, observed)
    return out.select("sample_id", "fill", "fill_entropy", *[round_double(c, 6).alias(c) for c in ("sample_low", "sample_median", "sample_high")], "in_distribution")


SERIES = """ev as (select event_type as key, cast((extract(day from ts) - 1) * 144 + extract(hour from ts) * 6 + extract(minute from ts) // 10 as bigint) as slot, value from events),
cells as (select key, unnest(range(720)) as cell from (select distinct key from ev)),
co as (select c.key, c.cell, coalesce(avg(e.value), 0.0) as value from cells c left join ev e on e.key = c.key and e.slot // 6 = c.cell group by all),
gd as (select c.key, c.i, count(e.value) / 10.0 as g from (select key, unnest(range(4320)) as i from (select distinct key from ev)) c left join ev e on e.key = c.key and e.slot = c.i group by all)"""


def _series(spark, sf):
    slot = ((F.dayofmonth("ts") - 1) * 144 + F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)).cast("bigint")
    ev = table(spark, sf, "events").select(F.col("event_type").alias("key"), slot.alias("slot"), "value")
    keys = ev.select("key").distinct()
    coarse = ev.groupBy("key", F.floor(F.col("slot") / 6).alias("cell")).agg(F.avg("value").alias("value"))
    grid = keys.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(719).cast("bigint"))).alias("cell"))
    coarse = grid.join(coarse, ["key", "cell"], "left").fillna(0.0, ["value"])
    fine = keys.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4319).cast("bigint"))).alias("i"))
    guide = fine.join(ev.groupBy("key", F.col("slot").alias("i")).agg((F.count("value") / 10.0).alias("g")), ["key", "i"], "left").fillna(0.0, ["g"])
    sizes = keys.select("key", F.lit(720).cast("bigint").alias("m"), F.lit(4320).cast("bigint").alias("target"))
    return coarse, guide, sizes


LINEAR = """fi as (select key, i, least(greatest((i + 0.5) * (720::double / 4320) - 0.5, 0.0), 719.0) as att from gd),
li as (select f.key, f.i, a.value + (b.value - a.value) * (att - floor(att)) as value from fi f join co a on a.key = f.key and a.cell = floor(att) join co b on b.key = f.key and b.cell = least(floor(att) + 1, 719))"""


@query("e9_upsample_nearest", f"with {SERIES} select g.key, g.i, round(c.value, 9) as value from gd g join co c on c.key = g.key and c.cell = g.i * 720 // 4320")
def e9n(spark, sf):
    coarse, _, sizes = _series(spark, sf)
    return sequence.upsample_nearest(coarse, sizes).withColumn("value", round_double("value", 9))


@query("e9_upsample_linear", f"with {SERIES}, {LINEAR} select key, i, round(value, 9) as value from li")
def e9l(spark, sf):
    coarse, _, sizes = _series(spark, sf)
    return sequence.upsample_linear(coarse, sizes).withColumn("value", round_double("value", 9))


@query(
    "e10_upsample_guided",
    f"""with {SERIES}, {LINEAR}, cg as (select key, i // 6 as cell, avg(g) as cg from gd group by all),
    w as (select g.key, g.i, c.value, exp(-0.5 * pow(((g.i + 0.5) - (c.cell + 0.5) * 6.0) / 6.0, 2)) * exp(-0.5 * pow((g.g - k.cg) / 0.15, 2)) as w
      from gd g join co c on c.key = g.key join cg k on k.key = c.key and k.cell = c.cell),
    s as (select key, i, sum(w) as t, sum(w * value) as wv from w group by all)
    select s.key, s.i, round(case when t > 0 then wv / t else li.value end, 6) as value from s join li on li.key = s.key and li.i = s.i""",
)
def e10(spark, sf):
    coarse, guide, sizes = _series(spark, sf)
    return sequence.upsample_guided(coarse, guide, sizes).withColumn("value", round_double("value", 6))


@query(
    "e11_area_resample",
    f"""with {SERIES}, b as (select key, unnest(range(101)) as bin from (select distinct key from gd)),
    e as (select key, bin, floor(bin * (4320::double / 101)) as lo, case when bin = 100 then 4320 else ceil((bin + 1) * (4320::double / 101)) end as hi from b)
    select e.key, e.bin, round(avg(g.g), 9) as value from e join gd g on g.key = e.key and g.i >= e.lo and g.i < e.hi group by all""",
)
def e11(spark, sf):
    _, guide, sizes = _series(spark, sf)
    out = sequence.area_resample(guide.withColumnRenamed("g", "value"), sizes.select("key", F.col("target").alias("m"), F.lit(101).cast("bigint").alias("target")))
    return out.withColumn("value", round_double("value", 9))


@query(
    "e12_boundary_recovery_error",
    f"""with {SERIES}, {LINEAR}, mx as (select key, max(value) as mv from co group by key),
    pr as (select 'nearest' as arm, g.key, g.i, c.value / mv as value from gd g join co c on c.key = g.key and c.cell = g.i // 6 join mx on mx.key = g.key
      union all select 'linear', li.key, i, value / mv from li join mx on mx.key = li.key),
    e as (select arm, key, min(i) filter (value >= 0.5) as a, max(i) filter (value >= 0.5) as b from pr group by all),
    d as (select arm, key, case when a is null then 4000 * 10 else abs(a - 100) * 10 end as ds, case when b is null then 4000 * 10 else abs(b + 1 - 4100) * 10 end as de from e)
    select arm, count(*) as n, avg(ds) as mae_start, avg(de) as mae_end, avg((ds = 0)::int::double) as hit_start, avg((de = 0)::int::double) as hit_end from d group by arm""",
)
def e12(spark, sf):
    coarse, _, sizes = _series(spark, sf)
    peak = coarse.groupBy("key").agg(F.max("value").alias("mv"))
    near = sequence.upsample_nearest(coarse, sizes).withColumn("arm", F.lit("nearest"))
    lin = sequence.upsample_linear(coarse, sizes).withColumn("arm", F.lit("linear"))
    prof = near.unionByName(lin).join(peak, "key").withColumn("value", F.col("value") / F.col("mv"))
    truth = sizes.select("key", F.lit(100).cast("bigint").alias("lo"), F.lit(4100).cast("bigint").alias("hi"))
    return sequence.recovery_summary(sequence.boundary_recovery_error(prof, truth, 10))


@query(
    "e13_sliding_ngrams",
    """with t as (select conv_id, turn, string_split(text, ' ') as w from conversations)
    select conv_id, turn, i as pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as gram, null::varchar as error from (select *, unnest(range(len(w) - 2)) as i from t where len(w) >= 3)
    union all select conv_id, turn, 0, null, 'needs at least 3 tokens' from t where len(w) < 3""",
)
def e13(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    return sequence.sliding_ngrams(c, ["conv_id", "turn"], "w", 3)


@query("d21_literal_spans", f"with {SPANS} select sample_id, rule, lo, hi from spans")
def d21(spark, sf):
    return spans.literal_spans(_docs(spark, sf), "doc_id", "text", flagship.RULES).select("sample_id", "rule", "lo", "hi")


@query("d21_regex_spans", f"with {SPANS} select sample_id, rule, lo, hi from spans")
def d21r(spark, sf):
    import re

    return spans.regex_spans(_docs(spark, sf), "doc_id", "text", {r: re.escape(r) for r in flagship.RULES})


@query("d21_span_summary", f"with {SPANS} select sample_id, count(distinct rule) as n_rules, count(*) as n_strings from spans group by all")
def d21s(spark, sf):
    return spans.span_summary(spans.literal_spans(_docs(spark, sf), "doc_id", "text", flagship.RULES))


#: Planted headers, in ASCII: pointer 64, one to three sections, an optional part of 96 bytes.
PIECE = 97


def _planted(spark, sf):
    """Texts with a header at their start, in the middle twice in a row (the second lies in the region
    of the first), a bare mark, a header of no sections and one at the end, cut into pieces."""
    z = lambda n: F.repeat(F.lit("\0"), n)
    n = F.chr(F.col("doc_id") % 3 + 1)

    def header(sections, gap):
        return F.concat(F.lit("MZ"), z(58), F.chr(F.lit(64 + gap)), z(3 + gap), F.lit("PE"), z(4), sections, z(13), F.lit("`"), z(3), F.chr(F.lit(11)), F.chr(F.lit(1)))

    t = F.regexp_replace("text", "[^\\x00-\\x7F]", "?")
    half = (F.length(t) / 2).cast("int")
    whole = F.concat(
        header(n, 0), F.substring(t, F.lit(1), half), header(n, 0), header(n, 0), F.substring(t, half + 1, F.length(t)), F.lit("MZ"), header(F.lit("\0"), 0), F.lit("M"), header(n, 9))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.encode(whole, "utf-8").alias("c"))
    cut = d.select("sample_id", "c", F.explode(F.sequence(F.lit(0), F.expr(f"(length(c) - 1) div {PIECE}"))).alias("piece"))
    return cut.select("sample_id", "piece", F.col("c").substr(F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("content"))


@query(
    "d21_header_scan",
    r"""with recursive z as (select chr(0) as o),
    t as (select doc_id as sample_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') as t, chr((doc_id % 3 + 1)::int) as n from documents),
    h as (select sample_id, t, (length(t) // 2)::int as half, 'MZ' || repeat(o, 58) || chr(64) || repeat(o, 3) || 'PE' || repeat(o, 4) || n || repeat(o, 13) || '`' || repeat(o, 3) || chr(11) || chr(1) as hd,
      'MZ' || repeat(o, 58) || chr(64) || repeat(o, 3) || 'PE' || repeat(o, 4) || o || repeat(o, 13) || '`' || repeat(o, 3) || chr(11) || chr(1) as h0,
      'MZ' || repeat(o, 58) || chr(73) || repeat(o, 12) || 'PE' || repeat(o, 4) || n || repeat(o, 13) || '`' || repeat(o, 3) || chr(11) || chr(1) as h9 from t, z),
    c as (select sample_id, hd || substr(t, 1, half) || hd || hd || substr(t, half + 1) || 'MZ' || h0 || 'M' || h9 as c from h),
    f as (select sample_id, c, unnest(list_transform(string_split(c, 'MZ'), lambda x: length(x))) as n, generate_subscripts(string_split(c, 'MZ'), 1) as j from c),
    p as (select sample_id, c, j, sum(n + 2) over (partition by sample_id order by j rows between unbounded preceding and 1 preceding) - 1 as i from f),
    m as (select sample_id, i::bigint as k, length(c) as total, ascii(substr(c, i::bigint + 60, 1)) as jump, c from p where i >= 2),
    v as (select sample_id, k, total, row_number() over (partition by sample_id order by k) as r, case when k + 63 <= total and jump > 0 and k + jump + 25 <= total and substr(c, k + jump, 4) = 'PE' || chr(0) || chr(0)
      and ascii(substr(c, k + jump + 6, 1)) between 1 and 96 and ascii(substr(c, k + jump + 25, 1)) in (1, 2) and ascii(substr(c, k + jump + 24, 1)) = 11 then jump + 24 + ascii(substr(c, k + jump + 20, 1)) + 40 * ascii(substr(c, k + jump + 6, 1)) end as span from m),
    walk as (select sample_id, 0::bigint as r, 0::bigint as lo, 0::bigint as hi, 2::bigint as go from c
      union all select w.sample_id, v.r, v.k, case when v.span is null or v.k < w.go then 0 else least(v.k + v.span, v.total + 1) end,
        case when v.k < w.go then w.go when v.span is null then v.k + 2 else least(v.k + v.span, v.total + 1) end
      from walk w join v on v.sample_id = w.sample_id and v.r = w.r + 1)
    select sample_id, lo - 1 as lo, hi - 1 as hi from walk where hi > 0""",
)
def d21h(spark, sf):
    return headers.scan_headers(_planted(spark, sf), PIECE)


@query(
    "d24_merge_blocks",
    f"""with {RANKS}, s as (select sample_id, tile, tile * 64 as lo, tile * 64 + tile_len as hi from rk where r_entropy <= least(n_tiles, greatest(1, cast(ceil(0.10::double * n_tiles) as bigint)))),
    g as (select *, tile - row_number() over (partition by sample_id order by tile) as isl from s) select sample_id, min(lo) as lo, max(hi) as hi from g group by sample_id, isl""",
)
def d24(spark, sf):
    from spanframe.operators import budget as bd

    tiles = flagship.scored_tiles(spark, sf)
    top = tiles.withColumn("rank", bd.rank_by(F.col("entropy"))).filter(F.col("rank") <= bd.budget_size(F.col("n_tiles"), 0.10))
    return intervals.merge_blocks(top.withColumn("n_units", F.col("tile") * 64 + F.col("tile_len")), ["sample_id"], 64)


@query("d20_union_sources", f"with {MERGED} select sample_id, lo, hi from merged")
def d20(spark, sf):
    d = _docs(spark, sf)
    found = {r: spans.literal_spans(d, "doc_id", "text", [r]) for r in flagship.RULES}
    return spans.union_sources(found)[0]


@query(
    "d20_source_status",
    f"""with {SPANS}, m as (select *, case when lag(hi) over (partition by sample_id, rule order by lo) = lo then 0 else 1 end as fresh from spans)
    select sample_id, rule as source, cast(sum(fresh) as bigint) as n_regions, cast(sum(hi - lo) as bigint) as n_bytes, 'ok' as status from m group by all
    union all select doc_id, 'analyzer', 0, 0, 'error:too_short' from documents where n_chars < 64""",
)
def d20s(spark, sf):
    docs = table(spark, sf, "documents")
    d = docs.select("doc_id", "text")
    found = {r: spans.literal_spans(d, "doc_id", "text", [r]) for r in flagship.RULES}
    bad = docs.filter("n_chars < 64").select(F.col("doc_id").alias("sample_id"), F.lit("analyzer").alias("source"), F.lit("error:too_short").alias("status"))
    return spans.union_sources(found, bad)[1]
