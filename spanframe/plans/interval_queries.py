"""Interval algebra on per-user activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import intervals as iv
from spanframe.plans.registry import query
from spanframe.plans.views import view

K = ["key"]

# running-maximum islands, a different method from the sweep under test
ISLANDS = """
imx as (select *, max(hi) over (partition by key order by lo, hi rows between unbounded preceding and 1 preceding) as pm from src),
i as (select *, sum(case when pm is null or pm < lo then 1 else 0 end) over (partition by key order by lo, hi rows unbounded preceding) as isl from imx),
norm as (select key, min(lo) as lo, max(hi) as hi from i group by key, isl)
"""
SWEEP = """
ev as (select key, set_id, lo as pos, 1 as d from v_iv union all select key, set_id, hi, -1 from v_iv),
g as (select key, pos, sum(case when set_id = 'A' then d else 0 end) as a, sum(case when set_id = 'B' then d else 0 end) as b from ev group by key, pos),
seg as (select key, pos as lo, lead(pos) over w as hi, sum(a) over w as da, sum(b) over w as db from g window w as (partition by key order by pos)),
"""


def _sets(spark, sf):
    v = view(spark, sf, "v_iv")
    return v, v.filter("set_id = 'A'"), v.filter("set_id = 'B'")


def _pick(cond: str) -> str:
    return f"with {SWEEP} src as (select key, lo, hi from seg where hi is not null and {cond}), {ISLANDS} select key, lo, hi from norm"


@query("d1_normalize", f"with src as (select key, lo, hi from v_iv where set_id = 'A'), {ISLANDS} select key, lo, hi from norm", ("v_iv",))
def d1(spark, sf):
    return iv.normalize(_sets(spark, sf)[1], K)


@query("d1_union", f"with src as (select key, lo, hi from v_iv), {ISLANDS} select key, lo, hi from norm", ("v_iv",))
def d1_union(spark, sf):
    _, a, b = _sets(spark, sf)
    return iv.union(a, b, K)


@query("d2_intersect", _pick("da > 0 and db > 0"), ("v_iv",))
def d2(spark, sf):
    _, a, b = _sets(spark, sf)
    return iv.intersect(a, b, K)


@query("d3_difference", _pick("da > 0 and db = 0"), ("v_iv",))
def d3(spark, sf):
    _, a, b = _sets(spark, sf)
    return iv.difference(a, b, K)


@query(
    "d4_clamp",
    """select key, set_id, greatest(lo, cast(600000 as bigint)) as lo, least(hi, cast(1200000 as bigint)) as hi from v_iv
       where least(hi, 1200000) > greatest(lo, 600000)""",
    ("v_iv",),
)
def d4(spark, sf):
    v, _, _ = _sets(spark, sf)
    return iv.clamp(v, F.lit(600000).cast("bigint"), F.lit(1200000).cast("bigint"))


RATIO = f"""with {SWEEP}
s as (select key, sum(case when da > 0 and db > 0 then hi - lo else 0 end) as i, sum(case when da > 0 or db > 0 then hi - lo else 0 end) as u
      from seg where hi is not null group by key),
uni as (select distinct c_custkey as key from customer)
select uni.key, cast(coalesce(i, 0) as bigint) as inter_len, cast(coalesce(u, 0) as bigint) as union_len, coalesce(i, 0) > 0 as overlaps,
  round(case when coalesce(u, 0) = 0 then {{empty}} else cast(i as double) / u end, 9) as {{name}} from uni left join s on s.key = uni.key"""


@query("d5_jaccard", RATIO.format(empty="1.0::double", name="jaccard"), ("v_iv",))
def d5(spark, sf):
    _, a, b = _sets(spark, sf)
    keys = view(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return iv.jaccard(a, b, K, keys).withColumn("jaccard", F.round("jaccard", 9))


@query("d23_byte_iou", RATIO.format(empty="0.0::double", name="byte_iou"), ("v_iv",))
def d23(spark, sf):
    _, a, b = _sets(spark, sf)
    keys = view(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return iv.byte_iou(a, b, K, keys).withColumn("byte_iou", F.round("byte_iou", 9))


@query(
    "d6_total_length",
    f"""with src as (select key, lo, hi from v_iv where set_id = 'A'), {ISLANDS}
    select key, count(*) as n, cast(sum(hi - lo) as bigint) as total_len, min(lo) as span_lo, max(hi) as span_hi from norm group by key""",
    ("v_iv",),
)
def d6(spark, sf):
    return iv.total_length(iv.normalize(_sets(spark, sf)[1], K), K)


@query(
    "d7_points_in",
    f"""with src as (select key, lo, hi from v_iv where set_id = 'A'), {ISLANDS}
    select p.key, p.pos, coalesce(p.pos < n.hi, false) as inside
    from (select key, lo as pos from v_iv where set_id = 'B') p asof left join norm n on p.key = n.key and p.pos >= n.lo""",
    ("v_iv",),
)
def d7(spark, sf):
    _, a, b = _sets(spark, sf)
    return iv.points_in(b.select("key", F.col("lo").alias("pos")), iv.normalize(a, K), K)


@query(
    "d8_from_positions",
    """with p as (select distinct l_orderkey % 100 as key, l_partkey as pos from lineitem),
    r as (select *, pos - row_number() over (partition by key order by pos) as g from p)
    select key, min(pos) as lo, max(pos) + 1 as hi from r group by key, g""",
)
def d8(spark, sf):
    li = view(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("key"), F.col("l_partkey").alias("pos"))
    return iv.from_positions(li, K)


@query(
    "d8_to_positions",
    """with n as (select doc_id as key, doc_id as lo, doc_id + 1 + n_chars % 5 as hi from documents)
    select key, unnest(range(lo, least(hi, (select max(doc_id) + 1 from documents)))) as pos from n""",
)
def d8_to(spark, sf):
    docs = view(spark, sf, "documents")
    n = docs.selectExpr("doc_id as key", "doc_id as lo", "doc_id + 1 + n_chars % 5 as hi")
    n = n.join(F.broadcast(docs.agg((F.max("doc_id") + 1).alias("limit"))))  # one row
    return iv.to_positions(n, K, F.col("limit"))


@query(
    "d9_tiles",
    """select sample_id, n_units, unnest(range(n_tiles)) as tile, tile * 64 as lo, least((tile + 1) * 64, n_units) as hi from v_tile""",
    ("v_tile",),
)
def d9(spark, sf):
    return iv.tile_rows(view(spark, sf, "v_tile").select("sample_id", "n_units"), 64)


@query(
    "d9_blocks",
    """select key, n_units, unnest(range(cast(ceil(n_units / 4096.0) as bigint))) as block, block * 4096 as lo, least((block + 1) * 4096, n_units) as hi
    from (select doc_id as key, n_chars - 100 as n_units from documents) where n_units > 0""",
)
def d9_blocks(spark, sf):
    d = view(spark, sf, "documents").selectExpr("doc_id as key", "n_chars - 100 as n_units")
    return iv.tile_rows(d.filter("n_units > 0"), 4096, at_least_one=False, name="block")


PIECES = """p as (select key, lo, hi, unnest(range(lo // 3600, (hi - 1) // 3600 + 1)) as tile from v_iv)"""


@query("d10_tiles_touched", f"with {PIECES} select distinct key, tile from p", ("v_iv",))
def d10(spark, sf):
    return iv.tiles_touched(view(spark, sf, "v_iv"), K, 3600)


@query(
    "d11_tile_overlap",
    f"with {PIECES} select key, tile, cast(sum(least(hi, (tile + 1) * 3600) - greatest(lo, tile * 3600)) as bigint) as n_bytes, count(*) as n_intervals from p group by key, tile",
    ("v_iv",),
)
def d11(spark, sf):
    return iv.tile_overlap(view(spark, sf, "v_iv"), K, 3600)
