"""Budgeted selection on document tiles and score vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.hashing import hash_hex, unit_draw
from spanframe.functions.rounding import round_double
from spanframe.operators import budget as bd
from spanframe.operators import sequence
from spanframe.plans import flagship
from spanframe.plans.registry import query
from spanframe.plans.sql_parts import ENTROPY, EVAL, RANKS, SPANS, TILES
from spanframe.plans.views import table, view

K10 = "least(n_tiles, greatest(1, cast(ceil(0.10::double * n_tiles) as bigint)))"


def _tiles(spark, sf):
    t = sequence.tile_entropy(table(spark, sf, "documents"), "doc_id", "text", 64)
    t = t.withColumn("entropy", round_double("entropy", 9))
    from pyspark.sql import Window

    return t.withColumn("n_tiles", F.max("tile").over(Window.partitionBy("sample_id")) + 1)


def _grid(spark, sf):
    from spanframe.operators.intervals import tile_rows

    return tile_rows(view(spark, sf, "v_tile"), 64)


def _k(b=0.10):
    return bd.budget_size(F.col("n_tiles"), b)


@query(
    "f1_budget_size",
    f"""select sample_id, b.budget, least(n_tiles, greatest(1, cast(ceil(b.budget * n_tiles) as bigint))) as k
    from v_tile, (values (0.02::double), (0.05::double), (0.10::double), (0.20::double), (0.50::double)) as b(budget)""",
    ("v_tile",),
)
def f1(spark, sf):
    b = F.explode(F.array(*[F.lit(x) for x in bd.BUDGETS]))
    v = view(spark, sf, "v_tile").select("sample_id", "n_tiles", b.alias("budget"))
    return v.select("sample_id", "budget", bd.budget_size(F.col("n_tiles"), F.col("budget")).alias("k"))


@query("f2_select_topk", f"with {RANKS} select sample_id, tile, r_boundary as rank, boundary as score from rk where r_boundary <= {K10}")
def f2(spark, sf):
    t = sequence.boundary_score(_tiles(spark, sf)).withColumn("score", round_double("boundary", 9))
    return bd.select_topk(t, _k()).select("sample_id", "tile", "rank", "score")


@query(
    "f3_select_random",
    f"""with r as (select sample_id, n_tiles, unnest(range(n_tiles)) as tile from v_tile),
    x as (select *, row_number() over (partition by sample_id order by sha256(concat_ws('|', 'tiles-v1', sample_id, tile)), tile) as rn from r)
    select sample_id, tile from x where rn <= {K10}""",
    ("v_tile",),
)
def f3(spark, sf):
    g = _grid(spark, sf).withColumn("rank", bd.random_order(flagship.SEED))
    return g.filter(F.col("rank") <= _k()).select("sample_id", "tile")


@query(
    "f4_select_uniform",
    f"""with s as (select sample_id, n_tiles, {K10} as k from v_tile)
    select sample_id, unnest(range(k)) * n_tiles // k as tile from s""",
    ("v_tile",),
)
def f4(spark, sf):
    return _grid(spark, sf).filter(bd.is_uniform(F.col("tile"), F.col("n_tiles"), _k())).select("sample_id", "tile")


@query(
    "f4_uniform_rounded",
    f"""with s as (select sample_id, n_tiles, {K10} as k from v_tile),
    j as (select sample_id, n_tiles, k, unnest(range(k)) as j from s)
    select distinct sample_id, cast(round_even(case when k > 1 then j * ((n_tiles - 1)::double / (k - 1)) else 0 end, 0) as bigint) as tile from j""",
    ("v_tile",),
)
def f4b(spark, sf):
    v = view(spark, sf, "v_tile")
    return v.select("sample_id", F.explode(bd.uniform_rounded(F.col("n_tiles"), _k())).alias("tile"))


@query(
    "f5_select_front_back",
    f"""with r as (select sample_id, n_tiles, unnest(range(n_tiles)) as tile from v_tile)
    select sample_id, tile, tile < {K10} as front, tile >= n_tiles - {K10} as back from r where tile < {K10} or tile >= n_tiles - {K10}""",
    ("v_tile",),
)
def f5(spark, sf):
    front, back = F.col("tile") < _k(), F.col("tile") >= F.col("n_tiles") - _k()
    return _grid(spark, sf).select("sample_id", "tile", front.alias("front"), back.alias("back")).filter("front or back")


@query("f6_select_entropy", f"with {RANKS} select sample_id, tile, r_entropy <= {K10} as by_entropy, r_boundary <= {K10} as by_boundary from rk where r_entropy <= {K10} or r_boundary <= {K10}")
def f6(spark, sf):
    t = sequence.boundary_score(_tiles(spark, sf)).withColumn("boundary", round_double("boundary", 9))
    e, b = bd.rank_by(F.col("entropy")) <= _k(), bd.rank_by(F.col("boundary")) <= _k()
    return t.select("sample_id", "tile", e.alias("by_entropy"), b.alias("by_boundary")).filter("by_entropy or by_boundary")


@query("f7_select_oracle", f"with {RANKS} select sample_id, tile, evidence from rk where r_oracle <= {K10}")
def f7(spark, sf):
    tiles = flagship.scored_tiles(spark, sf)
    return tiles.withColumn("rank", bd.rank_by(F.col("evidence").cast("double"))).filter(F.col("rank") <= _k()).select("sample_id", "tile", F.col("evidence").cast("bigint").alias("evidence"))


@query(
    "f8_select_external",
    """with s as (select vec_id as sample_id, unnest(embedding) as score, unnest(range(len(embedding))) as tile, len(embedding) as n from embeddings),
    x as (select *, row_number() over (partition by sample_id order by score desc, tile) as rn from s)
    select sample_id, tile, rn as rank from x where rn <= greatest(1, cast(ceil(0.2::double * n) as bigint))""",
)
def f8(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.size("embedding").alias("n_tiles"), F.posexplode("embedding").alias("tile", "score")
    ).withColumn("tile", F.col("tile").cast("bigint"))
    return bd.select_topk(e, _k(0.2)).select("sample_id", "tile", "rank")


SPLIT = "('0x' || substr(sha256(concat_ws('|', 'prior', sample_id)), 1, 13))::ubigint::double / 4503599627370496.0 < 0.7"


@query(
    "f9_position_prior",
    f"""with {TILES}, tr as (select * from tl where {SPLIT}),
    t as (select *, sum(evidence) over (partition by sample_id) as tot from tr),
    b as (select least(cast(floor((tile + 0.5) / n_tiles * 20) as bigint), 19) as bin, cast(evidence as double) / tot as s from t where tot > 0)
    select g.bin, round(coalesce(avg(s), 0.0), 9) as density from (select unnest(range(20)) as bin) g left join b on b.bin = g.bin group by g.bin""",
)
def f9(spark, sf):
    tiles = flagship.scored_tiles(spark, sf)
    train = tiles.filter(unit_draw("prior", "sample_id") < 0.7)
    return bd.fit_position_prior(train).select("bin", round_double("density", 9).alias("density"))


@query(
    "f9_score_position",
    f"""with {TILES}, tr as (select * from tl where {SPLIT}),
    t as (select *, sum(evidence) over (partition by sample_id) as tot from tr),
    b as (select least(cast(floor((tile + 0.5) / n_tiles * 20) as bigint), 19) as bin, cast(evidence as double) / tot as s from t where tot > 0),
    d as (select bin, avg(s) as density from b group by bin)
    select sample_id, tile, round(coalesce(density, 0.0), 9) as position_only from tl left join d on d.bin = least(cast(floor((tile + 0.5) / n_tiles * 20) as bigint), 19)""",
)
def f9s(spark, sf):
    tiles = flagship.scored_tiles(spark, sf)
    prior = bd.fit_position_prior(tiles.filter(unit_draw("prior", "sample_id") < 0.7))
    return bd.score_position(tiles.select("sample_id", "tile", "n_tiles"), prior).select("sample_id", "tile", round_double("position_only", 9).alias("position_only"))


@query(
    "f10_selection_metrics",
    f"""with {EVAL} select sample_id, selector, budget, round(coverage, 9) as coverage, round(byte_iou, 9) as byte_iou,
    round(interval_recall_50, 9) as interval_recall_50, evidence_hit, k from ev where selector in ('entropy', 'front_first') and budget = 0.10""",
)
def f10(spark, sf):
    chosen = bd.choices(bd.rank_selectors(flagship.scored_tiles(spark, sf), flagship.SEED), (0.10,), ("entropy", "front_first"))
    out = bd.selection_metrics(chosen, ["selector", "budget"])
    return out.select(
        "sample_id", "selector", "budget", round_double("coverage", 9).alias("coverage"), round_double("byte_iou", 9).alias("byte_iou"),
        round_double("interval_recall_50", 9).alias("interval_recall_50"), "evidence_hit", "k",
    )


@query(
    "f11_evaluate_grid",
    f"""with {EVAL} select sample_id, stratum, selector, budget, round(coverage, 9) as coverage, round(byte_iou, 9) as byte_iou,
    round(interval_recall_50, 9) as interval_recall_50, evidence_hit, k, has_evidence, n_regions from ev""",
)
def f11(spark, sf):
    ev = flagship.evaluation(spark, sf)
    for c in ("coverage", "byte_iou", "interval_recall_50"):
        ev = ev.withColumn(c, round_double(c, 9))
    return ev


@query(
    "f11_evidence_by_selector",
    f"""with {EVAL} select stratum, selector, budget, count(*) as n_samples, cast(sum(has_evidence::int) as bigint) as n_with_evidence,
    round(avg(coverage), 9) as mean_coverage, round(avg(byte_iou), 9) as mean_byte_iou, round(avg(interval_recall_50), 9) as mean_interval_recall
    from ev group by all""",
)
def f11_means(spark, sf):
    return flagship.evidence_by_selector(spark, sf)


@query(
    "f13_top_mean",
    """with r as (select *, count(*) over (partition by sample_id) as n, row_number() over (partition by sample_id order by l_extendedprice desc, idx) as rn from v_line)
    select sample_id, round(avg(l_extendedprice), 6) as top_mean from r where rn <= greatest(1, ceil(n * 0.25::double)) group by sample_id""",
    ("v_line",),
)
def f13(spark, sf):
    t = bd.top_mean(view(spark, sf, "v_line"), ["sample_id"], "l_extendedprice", 0.25, ["idx"])
    return t.select("sample_id", round_double("top_mean", 6).alias("top_mean"))


@query(
    "f14_routing_scores",
    f"""with {ENTROPY}, e as (select *, max(tile) over (partition by sample_id) + 1 as n_tiles from ent),
    c as (select sample_id, tile // 8 as cell, avg(entropy) as v, (max(n_tiles) + 7) // 8 as m from e group by all),
    f as (select e.sample_id, e.tile, e.entropy, e.n_tiles, m,
      least(greatest((e.tile + 0.5) * (m::double / n_tiles) - 0.5, 0.0), (m - 1)::double) as att from e join (select distinct sample_id, m from c) using (sample_id)),
    p as (select f.*, floor(att) as a, a.v as va, b.v as vb from f join c a on a.sample_id = f.sample_id and a.cell = floor(att)
      join c b on b.sample_id = f.sample_id and b.cell = least(floor(att) + 1, f.m - 1))
    select sample_id, tile, round(va + (vb - va) * (att - a), 6) as coarse, round(entropy / 8.0, 6) as entropy,
      round(('0x' || substr(sha256(concat_ws('|', 'route', sample_id, tile)), 1, 13))::ubigint::double / 4503599627370496.0, 9) as random,
      -abs(tile::double % 1.0) as uniform,
      cast({K10} + 1 + m + 1 as bigint) as coarse_passes, cast({K10} + 1 as bigint) as cheap_passes from p""",
)
def f14(spark, sf):
    t = _tiles(spark, sf)
    coarse = t.groupBy(F.col("sample_id").alias("key"), F.floor(F.col("tile") / 8).alias("cell")).agg(F.avg("entropy").alias("value"))
    sizes = t.groupBy(F.col("sample_id").alias("key")).agg(F.max("n_tiles").alias("target")).withColumn("m", F.expr("(target + 7) div 8"))
    up = sequence.upsample_linear(coarse, sizes).select(F.col("key").alias("sample_id"), F.col("i").alias("tile"), "value")
    m = F.expr("(n_tiles + 7) div 8")
    return t.join(up, ["sample_id", "tile"]).select(
        "sample_id", "tile", round_double("value", 6).alias("coarse"), round_double(F.col("entropy") / 8.0, 6).alias("entropy"),
        round_double(unit_draw("route", "sample_id", "tile"), 9).alias("random"),
        (-F.abs(F.col("tile").cast("double") % 1.0)).alias("uniform"),
        bd.routing_cost(m, _k(), "coarse").alias("coarse_passes"), bd.routing_cost(m, _k(), "entropy").alias("cheap_passes"),
    )


@query(
    "f15_combine_scores",
    """with p as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
    m as (select vec_id, max(1.0 / (1.0 + exp(-x))) as pr from p group by vec_id),
    q as (select *, least(greatest(pr, 1e-7::double), (1 - 1e-7)::double) as c from m),
    h as (select *, least(greatest(-(c * log2(c) + (1 - c) * log2(1 - c)), 0.0), 1.0) as en from q)
    select vec_id, round(pr, 9) as probability, round(en, 9) as entropy, round(least(greatest((0.7 * pr + 0.3 * en) / 1.0, 0.0), 1.0), 9) as combined from h""",
)
def f15(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    e = e.select("vec_id", (1.0 / (1.0 + F.exp(-F.col("x").cast("double")))).alias("p"))
    m = bd.max_over_levels(e, ["vec_id"], "p").withColumn("entropy", bd.binary_entropy(F.col("probability")))
    return m.select(
        "vec_id", round_double("probability", 9).alias("probability"), round_double("entropy", 9).alias("entropy"),
        round_double(bd.combine_scores(F.col("probability"), F.col("entropy"), 0.7, 0.3), 9).alias("combined"),
    )


@query(
    "f16_normalize_scores",
    """with q as (select l_returnflag, quantile_cont(l_extendedprice::double, 0.99) as h from v_line group by l_returnflag)
    select sample_id, idx, round(least(greatest(l_extendedprice / h, 0.0), 1.0), 9) as normalized from v_line join q using (l_returnflag)""",
    ("v_line",),
)
def f16(spark, sf):
    n = bd.normalize_scores(view(spark, sf, "v_line").select("sample_id", "idx", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return n.select("sample_id", "idx", round_double("normalized", 9).alias("normalized"))
