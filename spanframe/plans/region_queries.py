"""Coordinate mapping on per-order layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import audit, controls, coordinates, intervals, regions, stats, verdicts
from spanframe.plans.interval_queries import ISLANDS
from spanframe.plans.registry import query
from spanframe.plans.views import view
from spanframe.session import durable, read_tasks

VR = ("v_region", "v_size")
BASE = """sz as (select *, case when sample_id % 2 = 0 then overlay_offset + 2 end as cert_lo, case when sample_id % 2 = 0 then overlay_offset + 6 end as cert_hi from v_size),
rg as (select *, src_hi - src_lo as raw_size, dst_hi - dst_lo as vsize, least(src_hi - src_lo, dst_hi - dst_lo) as mapped from v_region)"""


def cand(name: str, src: str, direction: str) -> str:
    """Candidate status and value of ``src(sample_id, pos)``."""
    if direction == "offset":
        return f"""{name}_n as (select p.sample_id, p.pos, count(r.idx) as n, max(r.src_lo) as slo, max(r.dst_lo) as dlo, max(r.mapped) as mp from {src} p
 left join rg r on r.sample_id = p.sample_id and p.pos >= r.src_lo and p.pos < r.src_hi group by 1, 2),
{name}_s as (select o.*, case when n + (pos < header_len)::int + coalesce(pos >= cert_lo and pos < cert_hi, false)::int > 1 then 'overlapping'
 when pos < header_len then case when pos >= file_size then 'truncated' else 'headers' end
 when n = 1 then case when pos >= file_size then 'truncated' when pos - slo < mp then 'ok' else 'padding' end
 when coalesce(pos >= cert_lo and pos < cert_hi, false) then case when pos >= file_size then 'truncated' else 'certificate' end
 when pos >= overlay_offset then case when pos >= file_size then 'unmapped' else 'overlay' end else 'padding' end as st from {name}_n o join sz using (sample_id)),
{name} as (select sample_id, pos, st, case when st = 'headers' then pos when st = 'ok' then dlo + pos - slo end as val from {name}_s)"""
    return f"""{name}_n as (select p.sample_id, p.pos, count(r.idx) as n, max(r.src_lo) as slo, max(r.dst_lo) as dlo, max(r.mapped) as mp from {src} p
 left join rg r on r.sample_id = p.sample_id and p.pos >= r.dst_lo and p.pos < r.dst_hi group by 1, 2),
{name}_s as (select o.*, case when n + (pos < header_len)::int > 1 then 'overlapping'
 when n = 1 then case when pos - dlo >= mp then 'virtual_only' when slo + pos - dlo >= file_size then 'truncated' else 'ok' end
 when pos < header_len then case when pos >= file_size then 'truncated' else 'headers' end else 'unmapped' end as st from {name}_n o join sz using (sample_id)),
{name} as (select sample_id, pos, st, case when st = 'headers' then pos when st = 'ok' then slo + pos - dlo end as val from {name}_s)"""


def resolve(name: str, src: str, direction: str) -> str:
    other = "rva" if direction == "offset" else "offset"
    return f"""{cand(name + 'f', src, direction)}, {name}b as (select distinct sample_id, val as pos from {name}f where val is not null), {cand(name + 'r', name + 'b', other)},
{name} as (select f.sample_id, f.pos, case when f.st in ('ok', 'headers') and not (r.st in ('ok', 'headers') and r.val = f.pos) then 'overlapping' else f.st end as status,
 case when f.st in ('ok', 'headers') and r.st in ('ok', 'headers') and r.val = f.pos then f.val end as value
 from {name}f f left join {name}r r on r.sample_id = f.sample_id and r.pos = f.val)"""


OFF_PTS = """pts as (select distinct sample_id, unnest([src_lo - 1, src_lo, src_hi - 1, src_hi, src_lo + 3]) as pos from v_region
 union select sample_id, unnest([0, 3, overlay_offset, overlay_offset + 2, file_size - 1, file_size, file_size + 3]) from v_size)"""
RVA_PTS = """pts as (select distinct sample_id, unnest([dst_lo - 1, dst_lo, dst_hi - 1, dst_hi, dst_lo + 5]) as pos from v_region union select sample_id, unnest([0, 3, 4, file_size]) from v_size)"""


def _layouts(spark, sf):
    v = view(spark, sf, "v_region")
    reg = v.select("sample_id", "idx", F.col("src_lo").alias("raw_lo"), (F.col("src_hi") - F.col("src_lo")).alias("raw_size"),
                   F.col("dst_lo").alias("rva"), (F.col("dst_hi") - F.col("dst_lo")).alias("vsize"))
    s = view(spark, sf, "v_size")
    even = F.col("sample_id") % 2 == 0
    s = s.withColumn("cert_lo", F.when(even, F.col("overlay_offset") + 2)).withColumn("cert_hi", F.when(even, F.col("overlay_offset") + 6))
    return regions.build_layouts(s, reg)


def _points(spark, sf, cols, extra):
    v, s = view(spark, sf, "v_region"), view(spark, sf, "v_size")
    a = v.select("sample_id", F.explode(F.array(*[F.expr(c) for c in cols])).alias("pos"))
    b = s.select("sample_id", F.explode(F.array(*[F.expr(c) for c in extra])).alias("pos"))
    return a.unionByName(b).distinct()


@query("d13_map_points", f"with {BASE}, {OFF_PTS}, {resolve('m', 'pts', 'offset')} select * from m", VR)
def d13(spark, sf):
    pts = _points(spark, sf, ["src_lo - 1", "src_lo", "src_hi - 1", "src_hi", "src_lo + 3"],
                  ["0L", "3L", "overlay_offset", "overlay_offset + 2", "file_size - 1", "file_size", "file_size + 3"])
    return regions.map_points(pts, _layouts(spark, sf))


@query("d13_map_points_back", f"with {BASE}, {RVA_PTS}, {resolve('m', 'pts', 'rva')} select * from m", VR)
def d13b(spark, sf):
    pts = _points(spark, sf, ["dst_lo - 1", "dst_lo", "dst_hi - 1", "dst_hi", "dst_lo + 5"], ["0L", "3L", "4L", "file_size"])
    return regions.map_points(pts, _layouts(spark, sf), "rva")


@query(
    "d13_map_addresses",
    f"""with {BASE}, {RVA_PTS}, {resolve('m', 'pts', 'rva')} select sample_id, pos + 4096 + sample_id as va, status, value from m
    union all select sample_id, 4095, 'unmapped', null from v_size""",
    VR,
)
def d13va(spark, sf):
    pts = _points(spark, sf, ["dst_lo - 1", "dst_lo", "dst_hi - 1", "dst_hi", "dst_lo + 5"], ["0L", "3L", "4L", "file_size"])
    va = pts.select("sample_id", (F.col("pos") + 4096 + F.col("sample_id")).alias("va")).unionByName(view(spark, sf, "v_size").select("sample_id", F.lit(4095).cast("bigint").alias("va")))
    lay = _layouts(spark, sf).withColumn("image_base", (F.col("sample_id") + 4096).cast("decimal(20,0)"))
    return regions.map_addresses(va, lay)


CUTS_OFF = """rb as (select sample_id, unnest([0, header_len, file_size]) as b from sz union select sample_id, unnest([dst_lo, dst_lo + mapped, dst_hi]) from rg),
ob as (select sample_id, unnest([0, header_len, overlay_offset, file_size, cert_lo, cert_hi]) as b from sz union select sample_id, unnest([src_lo, src_lo + mapped, src_hi]) from rg)"""
OFF_CUTS = CUTS_OFF + """, cu as (select * from ob where b is not null union select rb.sample_id, b from rb join sz using (sample_id) where b between 0 and header_len
 union select rb.sample_id, src_lo + b - dst_lo from rb join rg using (sample_id) where b - dst_lo between 0 and mapped)"""
RVA_CUTS = CUTS_OFF + """, cu as (select * from rb union select ob.sample_id, b from ob join sz using (sample_id) where b between 0 and header_len
 union select ob.sample_id, dst_lo + b - src_lo from ob join rg using (sample_id) where b - src_lo between 0 and mapped)"""


def segments(cuts: str, direction: str) -> str:
    """CTE ``sg`` of mapped segments for intervals ``ivs(sample_id, component_id, lo, hi)``."""
    return f"""{cuts}, al as (select sample_id, component_id, lo, hi, unnest([lo, hi]) as c from ivs union select i.sample_id, component_id, lo, hi, b from ivs i join cu on cu.sample_id = i.sample_id and b > lo and b < hi),
pc as (select sample_id, component_id, lo, hi, c as src_lo, lead(c) over (partition by sample_id, component_id, lo, hi order by c) as src_hi from al),
pts as (select distinct sample_id, src_lo as pos from pc where src_hi is not null), {resolve('m', 'pts', direction)},
sg as (select pc.sample_id, component_id, lo, hi, src_lo, src_hi, status, value as dst_lo, value + src_hi - src_lo as dst_hi from pc join m on m.sample_id = pc.sample_id and m.pos = pc.src_lo where src_hi is not null)"""


OFF_IV = "ivs as (select sample_id, idx as component_id, src_lo - 1 as lo, src_hi + 2 as hi from v_region)"
RVA_IV = "ivs as (select sample_id, idx as component_id, dst_lo - 2 as lo, dst_hi + 3 as hi from v_region)"


def _off_iv(spark, sf):
    return view(spark, sf, "v_region").select("sample_id", F.col("idx").alias("component_id"), (F.col("src_lo") - 1).alias("lo"), (F.col("src_hi") + 2).alias("hi"))


def _rva_iv(spark, sf):
    return view(spark, sf, "v_region").select("sample_id", F.col("idx").alias("component_id"), (F.col("dst_lo") - 2).alias("lo"), (F.col("dst_hi") + 3).alias("hi"))


@query("d12_map_intervals", f"with {BASE}, {OFF_IV}, {segments(OFF_CUTS, 'offset')} select * from sg", VR)
def d12(spark, sf):
    return regions.map_intervals(_off_iv(spark, sf), _layouts(spark, sf))


@query("d12_map_intervals_back", f"with {BASE}, {RVA_IV}, {segments(RVA_CUTS, 'rva')} select * from sg", VR)
def d12b(spark, sf):
    return regions.map_intervals(_rva_iv(spark, sf), _layouts(spark, sf), "rva")


@query(
    "d12_component_rollup",
    f"""with {BASE}, {RVA_IV}, {segments(RVA_CUTS, 'rva')} select sample_id, component_id, cast(sum(src_hi - src_lo) as bigint) as source_length,
    cast(sum(case when status in ('ok', 'headers') then 0 else src_hi - src_lo end) as bigint) as unmapped_length, bool_and(status in ('ok', 'headers')) as fully_mapped from sg group by 1, 2""",
    VR,
)
def d12r(spark, sf):
    return regions.component_rollup(regions.map_intervals(_rva_iv(spark, sf), _layouts(spark, sf), "rva"))[1]


@query(
    "d12_component_targets",
    f"""with {BASE}, {RVA_IV}, {segments(RVA_CUTS, 'rva')}, src as (select sample_id * 100 + component_id as key, dst_lo as lo, dst_hi as hi from sg where status in ('ok', 'headers')), {ISLANDS}
    select key // 100 as sample_id, key % 100 as component_id, lo, hi from norm""",
    VR,
)
def d12t(spark, sf):
    return regions.component_rollup(regions.map_intervals(_rva_iv(spark, sf), _layouts(spark, sf), "rva"))[0]


WHOLE = "ivs as (select sample_id, 0 as component_id, 0 as lo, file_size as hi from v_size)"


def _whole(spark, sf):
    iv = view(spark, sf, "v_size").select("sample_id", F.lit(0).alias("component_id"), F.lit(0).cast("bigint").alias("lo"), F.col("file_size").alias("hi"))
    return regions.map_intervals(iv, _layouts(spark, sf))


@query("d16_coverage_histogram", f"with {BASE}, {WHOLE}, {segments(OFF_CUTS, 'offset')} select sample_id, status, cast(sum(src_hi - src_lo) as bigint) as n_bytes from sg group by 1, 2", VR)
def d16(spark, sf):
    return regions.coverage_histogram(_whole(spark, sf))


FACTS = """cf as (select g.sample_id, cast(sum(src_hi - src_lo) as bigint) as total_bytes, cast(sum(case when status in ('ok', 'headers') then src_hi - src_lo else 0 end) as bigint) as ok_bytes,
 any_value(file_size - overlay_offset) as overlay_bytes, any_value((file_size - overlay_offset)::double / file_size) as overlay_share from sg g join sz using (sample_id) group by 1)"""


@query(
    "d16_coverage_facts",
    f"""with {BASE}, {WHOLE}, {segments(OFF_CUTS, 'offset')}, {FACTS} select sample_id, total_bytes, ok_bytes, round(ok_bytes::double / total_bytes, 9) as coverage, overlay_bytes,
    round(overlay_share, 9) as overlay_share, case when overlay_share > 0.5 then 'overlay_dominant' else 'non_dominant' end as stratum from cf""",
    VR,
)
def d16f(spark, sf):
    out = regions.coverage_facts(_whole(spark, sf), _layouts(spark, sf))
    return out.withColumn("coverage", F.round("coverage", 9)).withColumn("overlay_share", F.round("overlay_share", 9))


TRIP = f"""{BASE}, {WHOLE}, {segments(OFF_CUTS, 'offset')}, sp as (select distinct sample_id, src_lo, src_hi, unnest([src_lo, src_lo + (src_hi - src_lo) // 2, src_hi - 1]) as pos from sg where status in ('ok', 'headers')),
tp as (select distinct sample_id, pos from sp), {resolve('t', 'tp', 'offset')}, bp as (select distinct sample_id, value as pos from t where value is not null), {resolve('u', 'bp', 'rva')},
rt as (select sp.sample_id, count(*) as points, count(*) filter (not coalesce(t.status in ('ok', 'headers') and u.status in ('ok', 'headers') and u.value = sp.pos, false)) as errors
 from sp join t on t.sample_id = sp.sample_id and t.pos = sp.pos left join u on u.sample_id = t.sample_id and u.pos = t.value group by 1)"""


@query("d17_round_trip_check", f"with {TRIP} select * from rt", VR)
def d17(spark, sf):
    return regions.round_trip_check(_whole(spark, sf), _layouts(spark, sf))


@query(
    "d17_pixel_round_trip",
    f"""with {BASE}, {WHOLE}, {segments(OFF_CUTS, 'offset')}, sp as (select sample_id, unnest([src_lo, src_lo + (src_hi - src_lo) // 2, src_hi - 1]) as pos from sg union select sample_id, unnest([0, file_size - 1]) from sz)
    select sample_id, 2 * count(distinct pos) as points, 0::bigint as errors from sp group by 1""",
    VR,
)
def d17p(spark, sf):
    return regions.pixel_round_trip(_whole(spark, sf), _layouts(spark, sf))


@query(
    "d15_overlapping_regions",
    """with p as (select a.sample_id, a.idx as a, b.idx as b, a.src_lo < b.src_hi and b.src_lo < a.src_hi as raw, a.dst_lo < b.dst_hi and b.dst_lo < a.dst_hi as vir from v_region a join v_region b on a.sample_id = b.sample_id and a.idx < b.idx)
    select sample_id, a, b, 'raw' as space from p where raw union all select sample_id, a, b, 'virtual' from p where vir""",
    VR,
)
def d15(spark, sf):
    return regions.overlapping_regions(_layouts(spark, sf))


MATCH = """mt as (select sample_id, 'r' || (idx % 3) as rule, dst_lo + 1 as lo, dst_lo + 4 as hi from v_region union all select sample_id, 'x', dst_lo + 1, dst_lo + 4 from v_region where idx % 2 = 0)"""


def _matches(spark, sf):
    v = view(spark, sf, "v_region")
    one = v.select("sample_id", F.concat(F.lit("r"), F.col("idx") % 3).alias("rule"), (F.col("dst_lo") + 1).alias("lo"), (F.col("dst_lo") + 4).alias("hi"))
    two = v.filter("idx % 2 = 0").select("sample_id", F.lit("x").alias("rule"), (F.col("dst_lo") + 1).alias("lo"), (F.col("dst_lo") + 4).alias("hi"))
    return one.unionByName(two)


SPANS22 = f"""{BASE}, {MATCH}, ivs as (select distinct sample_id, lo as component_id, lo, hi from mt), {segments(RVA_CUTS, 'rva')}, src as (select sample_id as key, dst_lo as lo, dst_hi as hi from sg where status in ('ok', 'headers')), {ISLANDS}"""


@query("d22_component_spans", f"with {SPANS22} select key as sample_id, lo, hi from norm", VR)
def d22(spark, sf):
    return regions.component_spans(_matches(spark, sf), _layouts(spark, sf))[0]


@query(
    "d22_component_counts",
    f"""with {SPANS22}, b as (select key as sample_id, sum(hi - lo) as mb from norm group by 1) select mt.sample_id, count(distinct (lo, hi)) as n_functions, count(distinct rule) as n_rules, cast(coalesce(any_value(mb), 0) as bigint) as mapped_bytes
    from mt left join b using (sample_id) group by 1""",
    VR,
)
def d22c(spark, sf):
    return regions.component_spans(_matches(spark, sf), _layouts(spark, sf))[1]


@query(
    "c14_compare_layouts",
    """with l as (select sample_id, idx, dst_lo as rva, src_lo as raw_lo, src_hi - src_lo as raw_size from v_region),
    r as (select sample_id, idx, case when l_tax > 0.06 then rva + 1 else rva end as rva, raw_lo, case when l_discount > 0.09 then raw_size + 1 else raw_size end as raw_size from l join v_line using (sample_id, idx) where not (idx >= 6 and l_linestatus = 'F')),
    a as (select sample_id, count(*) as n, list((rva, raw_lo, raw_size) order by idx) as f, list_sort(list_distinct(list((raw_lo, raw_size)))) as s from l group by 1),
    b as (select sample_id, count(*) as n, list((rva, raw_lo, raw_size) order by idx) as f, list_sort(list_distinct(list((raw_lo, raw_size)))) as s from r group by 1)
    select coalesce(a.sample_id, b.sample_id) as sample_id, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right,
    case when coalesce(a.n, 0) <> coalesce(b.n, 0) then 'section_count' when a.f <> b.f then 'section_fields' else 'ok' end as status, coalesce(a.s = b.s, false) as raw_agreement
    from a full join b on a.sample_id = b.sample_id""",
    VR,
)
def c14(spark, sf):
    v = view(spark, sf, "v_region")
    left = v.select("sample_id", "idx", F.col("dst_lo").alias("rva"), F.col("src_lo").alias("raw_lo"), (F.col("src_hi") - F.col("src_lo")).alias("raw_size"))
    li = view(spark, sf, "v_line").select("sample_id", "idx", "l_tax", "l_discount", "l_linestatus")
    right = left.join(li, ["sample_id", "idx"]).filter("not (idx >= 6 and l_linestatus = 'F')").select(
        "sample_id", "idx", F.when(F.col("l_tax") > 0.06, F.col("rva") + 1).otherwise(F.col("rva")).alias("rva"), "raw_lo",
        F.when(F.col("l_discount") > 0.09, F.col("raw_size") + 1).otherwise(F.col("raw_size")).alias("raw_size"))
    return regions.compare_layouts(left, right)


SEGS = """sg as (select sample_id, 'seg' || idx as name, src_lo * 128 as lo, idx <= 3 as real from v_region), bs as (select sample_id, header_len * 128 as base, file_size * 100 as n from v_size),
al as (select sg.sample_id, name, real, lo - base as dump_offset, lo - base >= 0 and lo - base < n as in_range, (lo - base) % 512 = 0 as aligned_512, (lo - base) % 4096 = 0 as aligned_4096 from sg join bs using (sample_id))"""


def _alignment(spark, sf):
    seg = view(spark, sf, "v_region").select("sample_id", F.concat(F.lit("seg"), "idx").alias("name"), (F.col("src_lo") * 128).alias("lo"), (F.col("idx") <= 3).alias("real"))
    size = view(spark, sf, "v_size").select("sample_id", (F.col("header_len") * 128).alias("base"), (F.col("file_size") * 100).alias("n"))
    return regions.segment_alignment(seg, size)


@query("d26_segment_alignment", f"with {SEGS} select * from al", VR)
def d26(spark, sf):
    return _alignment(spark, sf)


@query(
    "d26_alignment_verdict",
    f"""with {SEGS} select count(*) filter (real and in_range) as n_real, count(*) filter (real and in_range and aligned_512) as real_aligned_512, count(*) filter (real and in_range and aligned_4096) as real_aligned_4096,
    count(*) filter (not real) as n_other, count(*) filter (not real and aligned_512) as other_aligned_512, (select bool_and(a) from (select bool_or(in_range) as a from al group by sample_id)) as coordinates_match from al""",
    VR,
)
def d26v(spark, sf):
    return regions.alignment_verdict(_alignment(spark, sf))


SECONDS = "cast((extract(day from ts) - 1) * 86400 + extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as bigint)"
ENC = """ln as (select key, max(hi) as n from v_iv group by key),
en as (select key as sample_id, case key % 3 when 0 then 'raw-rgb' when 1 then 'word16-rgb' else 'opcode-3gram-rgb' end as mode, case key % 3 when 0 then 3 when 1 then 2 else 1 end as stride, 3 as window_,
 n as n_source, case key % 3 when 0 then (n + 2) // 3 when 1 then (n + 1) // 2 else n - 2 end as n_pixels from ln)"""
PX = ENC + """, px as (select key, mode, greatest(0, lo) as l, least(hi, n_source) as h, stride, n_pixels from v_iv join en on sample_id = key where greatest(0, lo) < least(hi, n_source)),
src as (select key, case when mode like 'opcode%' then greatest(0, l - 2) else l // stride end as lo, case when mode like 'opcode%' then least(h, n_pixels) else ceil(h::double / stride)::bigint end as hi from px), """ + ISLANDS


def _enc(spark, sf):
    """One encoding per user; its length is the end of the user's last interval."""
    k = F.col("key") % 3
    long = lambda c: c.cast("bigint")
    ends = view(spark, sf, "v_iv").groupBy("key").agg(F.max("hi").alias("n"))
    return ends.select(
        F.col("key").alias("sample_id"), F.when(k == 0, "raw-rgb").when(k == 1, "word16-rgb").otherwise("opcode-3gram-rgb").alias("mode"),
        long(F.when(k == 0, 3).when(k == 1, 2).otherwise(1)).alias("stride"), F.lit(3).alias("window"), F.col("n").alias("n_source"),
        long(F.when(k == 0, F.expr("(n + 2) div 3")).when(k == 1, F.expr("(n + 1) div 2")).otherwise(F.col("n") - 2)).alias("n_pixels"))


def _iv(spark, sf):
    return view(spark, sf, "v_iv").select(F.col("key").alias("sample_id"), "lo", "hi")


@query("d18_bytes_to_pixels", f"with {PX} select key as sample_id, lo, hi from norm", ("v_iv",))
def d18(spark, sf):
    return coordinates.bytes_to_pixels(_iv(spark, sf), _enc(spark, sf))


@query(
    "d18_pixels_to_bytes",
    f"""with {ENC}, px as (select key, greatest(0, lo) * stride as lo, least(hi * stride, n_source * stride - 1) as hi from v_iv join en on sample_id = key where mode not like 'opcode%'),
    src as (select * from px where lo < hi), {ISLANDS} select key as sample_id, lo, hi from norm""",
    ("v_iv",),
)
def d18b(spark, sf):
    # the intervals are pixels here; the last pixel lacks one channel
    enc = _enc(spark, sf).withColumn("n_pixels", F.col("n_source")).withColumn("n_source", F.col("n_source") * F.col("stride") - 1)
    return coordinates.pixels_to_bytes(_iv(spark, sf), enc)


@query(
    "d18_points",
    f"""with {ENC} select event_id, lo // stride as pixel, lo % stride as channel, case when lo // stride < n_pixels then lo // stride * stride end as span_lo, case when lo // stride < n_pixels then least((lo // stride + 1) * stride, n_source) end as span_hi
    from (select event_id, user_id, {SECONDS} as lo from events) e join en on en.sample_id = user_id""",
    ("v_iv",),
)
def d18p(spark, sf):
    e = view(spark, sf, "events").select("event_id", F.col("user_id").alias("sample_id"), F.expr(SECONDS).alias("lo")).join(_enc(spark, sf), "sample_id")
    pc = coordinates.byte_to_pixel_channel(F.col("lo"), F.col("stride"))
    e = e.withColumn("pc", pc).withColumn("span", coordinates.pixel_to_byte_span(F.col("pc.pixel"), F.col("stride"), F.col("n_pixels"), F.col("n_source")))
    return e.select("event_id", "pc.pixel", "pc.channel", F.col("span.lo").alias("span_lo"), F.col("span.hi").alias("span_hi"))


@query(
    "d19_interval_to_boxes",
    """with p as (select key as sample_id, lo, hi, lo // 256 as r0, lo % 256 as c0, (hi - 1) // 256 as r1, (hi - 1) % 256 as c1 from (select distinct key, lo, hi from v_iv))
    select sample_id, lo, hi, c0 as x, r0 as y, c1 - c0 + 1 as w, 1::bigint as h from p where r0 = r1
    union all select sample_id, lo, hi, c0, r0, 256 - c0, 1 from p where r0 < r1 and c0 > 0
    union all select sample_id, lo, hi, 0, r0 + (c0 > 0)::int, 256, r1 + 1 - (c1 <> 255)::int - r0 - (c0 > 0)::int from p where r0 < r1 and r0 + (c0 > 0)::int < r1 + 1 - (c1 <> 255)::int
    union all select sample_id, lo, hi, 0, r1, c1 + 1, 1 from p where r0 < r1 and c1 <> 255""",
    ("v_iv",),
)
def d19(spark, sf):
    return coordinates.interval_to_boxes(_iv(spark, sf).distinct(), F.lit(256))


@query(
    "d19_interval_to_row_boxes",
    """with p as (select key as sample_id, lo, hi, unnest(range(lo // 256, (hi - 1) // 256 + 1)) as y from (select distinct key, lo, hi from v_iv))
    select sample_id, lo, hi, greatest(lo, y * 256) - y * 256 as x, y, least(hi, (y + 1) * 256) - greatest(lo, y * 256) as w, 1::bigint as h from p""",
    ("v_iv",),
)
def d19r(spark, sf):
    return coordinates.interval_to_row_boxes(_iv(spark, sf).distinct(), F.lit(256))


BOXB = ENC + """, bx as (select image_id % 1500 as sample_id, x1 as x, y1 as y, w, h from v_box), rw as (select sample_id, unnest(range(y, y + h)) * 640 + x as lo, w from bx),
pb as (select r.sample_id as key, lo * stride as lo, least(least(lo + w, n_pixels) * stride, n_source) as hi from rw r join en using (sample_id) where mode not like 'opcode%' and lo < n_pixels), src as (select * from pb where lo < hi), """ + ISLANDS


@query("d19_bbox_to_bytes", f"with {BOXB} select key as sample_id, lo, hi from norm", ("v_box", "v_iv"))
def d19b(spark, sf):
    b = view(spark, sf, "v_box").select((F.col("image_id") % 1500).alias("sample_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h")
    return coordinates.bbox_to_bytes(b, _enc(spark, sf), 640, 16 * read_tasks(view(spark, sf, "lineitem")))


@query(
    "d19_mask_to_bytes",
    f"""with {ENC}, p as (select distinct user_id as sample_id, event_id as pos from events), s as (select p.sample_id as key, pos * stride as lo, least((pos + 1) * stride, n_source) as hi from p join en using (sample_id) where mode not like 'opcode%'),
    src as (select * from s), {ISLANDS} select key as sample_id, lo, hi from norm""",
    ("v_iv",),
)
def d19m(spark, sf):
    m = view(spark, sf, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("pos"))
    return coordinates.mask_to_bytes(m, _enc(spark, sf))


@query(
    "d19_project_to_regions",
    f"""with {BASE}, bx as (select sample_id, idx as x, 0 as y, 2 as w, 3 as h from v_region), rw as (select sample_id, unnest(range(y, y + h)) * 16 + x as lo, w from bx),
    src as (select r.sample_id as key, lo * 3 as lo, least((lo + w) * 3, file_size) as hi from rw r join sz using (sample_id) where lo * 3 < file_size), {ISLANDS},
    ivs as (select key as sample_id, lo as component_id, lo, hi from norm), {segments(OFF_CUTS, 'offset')} select sample_id, lo, hi, component_id, src_lo, src_hi, status, dst_lo, dst_hi from sg""",
    VR,
)
def d19g(spark, sf):
    b = view(spark, sf, "v_region").select("sample_id", F.col("idx").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(2).alias("w"), F.lit(3).alias("h"))
    enc = view(spark, sf, "v_size").select("sample_id", F.lit("raw-rgb").alias("mode"), F.lit(3).cast("bigint").alias("stride"), F.col("file_size").alias("n_source"), F.ceil(F.col("file_size") / 3).alias("n_pixels"))
    return coordinates.project_to_regions(b, enc, _layouts(spark, sf), 16)


def _controls(spark, sf):
    # read by every step that follows, so swept once
    a = durable(intervals.normalize(view(spark, sf, "v_iv").filter("set_id = 'A'").select(F.col("key").alias("sample_id"), "lo", "hi"), ["sample_id"]))
    samples = view(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.lit(2_600_000).cast("bigint").alias("n"))
    return a, controls.matched_controls(a, samples, "ctl")


@query("d25_matched_controls")
def d25(spark, sf):
    return _controls(spark, sf)[1][0]


@query("d25_controls_disjoint", f"with src as (select key, lo, hi from v_iv where set_id = 'A'), {ISLANDS} select key as sample_id, count(*) as n_evidence, count(*) as n_placed, 0::bigint as evidence_overlap, 0::bigint as self_overlap from norm group by key", ("v_iv",))
def d25d(spark, sf):
    a, (placed, _) = _controls(spark, sf)
    placed = durable(placed)
    over = intervals.overlap_sums(a, placed.select("sample_id", "lo", "hi"), ["sample_id"]).select("sample_id", F.col("inter_len").alias("evidence_overlap"))
    merged = intervals.normalize(placed.select("sample_id", "lo", "hi"), ["sample_id"]).groupBy("sample_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("_m"))
    own = placed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_placed"), F.sum(F.col("hi") - F.col("lo")).alias("_t"))
    n = a.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return n.join(own, "sample_id", "left").join(merged, "sample_id", "left").join(over, "sample_id").select(
        "sample_id", "n_evidence", "n_placed", "evidence_overlap", (F.col("_t") - F.col("_m")).alias("self_overlap"))


@query(
    "i13_cohort_summary",
    f"""with {TRIP}, {FACTS}, r as (select cf.*, ok_bytes > total_bytes / 2 as ok, ok_bytes::double / total_bytes as coverage, coalesce(points, 0) as points, coalesce(errors, 0) as errors from cf left join rt using (sample_id))
    select count(*) as n, round(avg(ok::int::double), 6) as ok_rate, round(avg(coverage), 6) as coverage_mean, round(sum(ok_bytes)::double / sum(total_bytes), 6) as coverage_byte_weighted, cast(sum(total_bytes) as bigint) as total_bytes,
    cast(sum(points) as bigint) as roundtrip_points, cast(sum(errors) as bigint) as roundtrip_errors, count(*) filter (overlay_share > 0.5) as overlay_dominant from r""",
    VR,
)
def i13(spark, sf):
    facts = regions.whole_file_facts(_layouts(spark, sf)).withColumn("ok", F.col("ok_bytes") > F.col("total_bytes") / 2)
    return verdicts.cohort_summary(facts)


@query(
    "i13_coverage_quantiles",
    f"""with {BASE}, {WHOLE}, {segments(OFF_CUTS, 'offset')}, {FACTS}, q as (select ok_bytes::double / total_bytes as x from cf), r as (select x, row_number() over (order by x) - 1 as i, count(*) over () as n from q)
    select max(n) as n, """ + ", ".join(f"round(max(x) filter (i = round_even({p}::double * (n - 1), 0)), 6) as p{int(p * 100)}" for p in (0.10, 0.25, 0.50, 0.75, 0.90)) + " from r",
    VR,
)
def i13q(spark, sf):
    return stats.nearest_rank_quantiles(regions.coverage_facts(_whole(spark, sf), _layouts(spark, sf)), [], "coverage")


@query("i13_status_totals", f"with {BASE}, {WHOLE}, {segments(OFF_CUTS, 'offset')} select status, cast(sum(src_hi - src_lo) as bigint) as n_bytes from sg group by 1", VR)
def i13s(spark, sf):
    return regions.coverage_histogram(_whole(spark, sf)).groupBy("status").agg(F.sum("n_bytes").alias("n_bytes"))


IMP = """ro as (select 'C:\\\\rois/IMG' || image_id || '.PNG' as path, label, x1, y1, w, h, image_id from v_box),
im as (select o_orderkey as image_id, 'img' || o_orderkey || '.png' as b, case when o_orderstatus = 'P' then null when o_orderstatus = 'O' then 'train' else 'val' end as split from orders where o_totalprice > 20000
 union all select o_orderkey, 'img' || o_orderkey || '.png', 'train' from orders where o_totalprice > 450000),
ig as (select b, count(*) as n, min(image_id) as image_id, min(split) as split from im group by b),
jn as (select ro.*, ig.n, ig.image_id as iid, ig.split, 'img' || ro.image_id || '.png' as key, case label when 'A' then 'alpha' when 'N' then 'Beta' end as category,
  case when ig.n is null then 'unknown_image' when ig.n > 1 then 'ambiguous_image' when ig.split is null then 'missing_split' end as rule from ro left join ig on ig.b = 'img' || ro.image_id || '.png')"""


def _import(spark, sf):
    rois = view(spark, sf, "v_box").select(F.concat(F.lit("C:\\rois/IMG"), "image_id", F.lit(".PNG")).alias("path"), "label", F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h")
    o = view(spark, sf, "orders")
    name = F.concat(F.lit("a/b/img"), "o_orderkey", F.lit(".png")).alias("path")
    split = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "O", "train").otherwise("val")
    images = o.filter("o_totalprice > 20000").select(name, F.col("o_orderkey").alias("image_id"), split.alias("split")).unionByName(
        o.filter("o_totalprice > 450000").select(name, F.col("o_orderkey").alias("image_id"), F.lit("train").alias("split")))
    policy = spark.createDataFrame([("a", "alpha"), ("n", "Beta"), ("r", None)], "label string, category string")
    return audit.import_annotations(rois, images, policy)


@query("c15_import_annotations", f"with {IMP} select distinct iid as image_id, split, category, x1 as x, y1 as y, w, h, case category when 'alpha' then 1 else 2 end as category_id from jn where rule is null and category is not null", ("v_box",))
def c15(spark, sf):
    return _import(spark, sf)[0]


@query("c15_import_violations", f"with {IMP} select rule, key, count(*) as n from jn where rule is not null group by 1, 2", ("v_box",))
def c15v(spark, sf):
    return _import(spark, sf)[1]
