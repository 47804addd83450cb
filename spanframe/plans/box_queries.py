"""F12, G1-G8, K1-K10."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import annotations as an
from spanframe.operators import boxes as bx
from spanframe.plans.registry import query
from spanframe.plans.stats_queries import _r
from spanframe.plans.views import view

V = ("v_box",)
AX = "(select unnest([0, 205, 384]) as s)"  # 640 pixels, 256-pixel tiles, 20 % overlap
TILES = f"""im as (select distinct image_id from v_box), tl as (select im.image_id, (row_number() over (partition by im.image_id order by y.s, x.s)) - 1 as tile, x.s::double as x1, y.s::double as y1, x.s + 256.0::double as x2, y.s + 256.0::double as y2
 from im cross join {AX} x cross join {AX} y)"""


def _images(spark, sf):
    return view(spark, sf, "v_box").select("image_id").distinct().withColumn("width", F.lit(640)).withColumn("height", F.lit(640))


def _tiles(spark, sf):
    return bx.tile_grid(_images(spark, sf), 256, 256, 0.2)


def _truth(spark, sf):
    return bx.corners(view(spark, sf, "v_box").select("image_id", "box_id", "label", "x1", "y1", "w", "h"))


def _pred(spark, sf):
    v = view(spark, sf, "v_box").select("image_id", "box_id", "label", "score", F.col("px1").alias("x1"), F.col("py1").alias("y1"), "w", "h")
    return bx.corners(v)


@query("g1_tile_grid", f"with {TILES} select image_id, tile, x1, y1, x2, y2 from tl", V)
def g1(spark, sf):
    return _tiles(spark, sf).drop("width", "height")


IOU = "greatest(least(x1 + w, px1 + w) - greatest(x1, px1), 0)::double * greatest(least(y1 + h, py1 + h) - greatest(y1, py1), 0)"


@query("g2_box_iou", f"with i as (select *, {IOU} as i from v_box) select image_id, box_id, round(i / (2.0 * w * h - i), 9) as iou, round(i / (w * h), 9) as ios from i where i > 0", V)
def g2(spark, sf):
    p = bx.touching_pairs(_truth(spark, sf), _pred(spark, sf), extra=["box_id"])
    out = p.select(F.col("a.image_id").alias("image_id"), F.col("a.box_id").alias("box_id"), bx.overlap_ratio("a", "b").alias("iou"), bx.overlap_ratio("a", "b", "ios").alias("ios"))
    return _r(out, "iou", "ios", digits=9)


@query(
    "g3_tile_recall",
    f"""with {TILES}, b as (select v.image_id, v.box_id, max(greatest(least(v.x1 + w, t.x2) - greatest(v.x1, t.x1), 0) * greatest(least(v.y1 + h, t.y2) - greatest(v.y1, t.y1), 0) / (w * h)) as c from v_box v join tl t on t.image_id = v.image_id group by 1, 2)
    select image_id, count(*) as n_truth, round(avg((c >= 0.5)::int::double), 9) as recall from b group by 1""",
    V,
)
def g3(spark, sf):
    return _r(bx.tile_recall(_tiles(spark, sf), _truth(spark, sf)), "recall", digits=9)


#: All overlapping pairs of predictions ``p`` and truths ``t`` of an image.
NEAR = """bp as (select image_id, box_id, label, score, px1::double as x1, py1::double as y1, px1::double + w as x2, py1::double + h as y2 from v_box),
bt as (select image_id, box_id, label, x1::double as x1, y1::double as y1, x1::double + w as x2, y1::double + h as y2 from v_box)"""


@query(
    "g4_match_detections",
    f"""with recursive {NEAR},
    jo as (select p.image_id, p.box_id as pred_id, t.box_id as truth_id, p.score, p.label = t.label as same, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) as i,
      (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) as s from bp p join bt t on t.image_id = p.image_id),
    pr as (select *, i / (s - i) as iou from jo where i > 0 and i / (s - i) >= 0.5),
    o as (select *, row_number() over (partition by image_id order by not same, case when same then -score else 0 end, pred_id, -iou, truth_id) as r from pr),
    walk as (select distinct image_id, 0::bigint as r, []::bigint[] as ps, []::bigint[] as ts, false as hit from o
      union all select w.image_id, o.r, case when f.ok then list_append(w.ps, o.pred_id) else w.ps end, case when f.ok then list_append(w.ts, o.truth_id) else w.ts end, f.ok
      from walk w join o on o.image_id = w.image_id and o.r = w.r + 1, lateral (select not list_contains(w.ps, o.pred_id) and not list_contains(w.ts, o.truth_id) as ok) f),
    mt as (select o.image_id, o.pred_id, o.truth_id, o.iou, case when same then 'true_positive' else 'class_mismatch' end as status from walk w join o on o.image_id = w.image_id and o.r = w.r where w.hit)
    select image_id, pred_id, truth_id, round(iou, 9) as iou, status from mt
    union all select image_id, box_id, null, null, 'false_positive' from bp where not exists (select 1 from mt where mt.image_id = bp.image_id and mt.pred_id = bp.box_id and status = 'true_positive')
    union all select image_id, null, box_id, null, 'false_negative' from bt where not exists (select 1 from mt where mt.image_id = bt.image_id and mt.truth_id = bt.box_id and status = 'true_positive')""",
    V,
    recursive=True,
)
def g4(spark, sf):
    return _r(bx.match_detections(_pred(spark, sf), _truth(spark, sf)), "iou", digits=9)


@query(
    "g4_match_simple",
    f"""with n as (select *, count(*) over (partition by image_id, label) as k from v_box), m as (select *, {IOU} as i from n where k = 1),
    o as (select image_id, label, box_id, i / (2.0 * w * h - i) >= 0.5 as hit from m) select image_id, count(*) as n_truth, count(*) filter (hit) as tp from o group by 1""",
    V,
)
def g4s(spark, sf):
    one = view(spark, sf, "v_box").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("k"), F.min("box_id").alias("box_id")).filter("k = 1").select("image_id", "box_id")
    st = bx.match_detections(_pred(spark, sf).join(one, ["image_id", "box_id"]), _truth(spark, sf).join(one, ["image_id", "box_id"]))
    return bx.status_counts(st).select("image_id", "n_truth", "tp")


@query(
    "g5_merge_boxes",
    f"""with recursive {NEAR},
    o as (select *, row_number() over (partition by image_id order by -score, label, x1, y1, x2, y2, box_id) as r from bp),
    near as (select b.image_id, b.r, list(a.r order by a.r) as js from o a join o b on a.image_id = b.image_id and a.label = b.label and a.r < b.r
      and least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)
      and (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.5 group by 1, 2),
    walk as (select distinct image_id, 0::bigint as r, []::bigint[] as seeds, 0::bigint as own from o
      union all select w.image_id, o.r, case when f.j is null then list_append(w.seeds, o.r) else w.seeds end, coalesce(f.j, o.r)
      from walk w join o on o.image_id = w.image_id and o.r = w.r + 1 left join near n on n.image_id = o.image_id and n.r = o.r, lateral (select list_min(list_intersect(w.seeds, coalesce(n.js, []::bigint[]))) as j) f)
    select o.image_id, any_value(s.label) as label, max(o.score) as score, round(sum(o.x1 * greatest(o.score, 1e-8)) / sum(greatest(o.score, 1e-8)), 6) as x1, round(sum(o.y1 * greatest(o.score, 1e-8)) / sum(greatest(o.score, 1e-8)), 6) as y1,
      round(sum(o.x2 * greatest(o.score, 1e-8)) / sum(greatest(o.score, 1e-8)), 6) as x2, round(sum(o.y2 * greatest(o.score, 1e-8)) / sum(greatest(o.score, 1e-8)), 6) as y2, count(*) as n_merged
    from walk w join o on o.image_id = w.image_id and o.r = w.r join o s on s.image_id = w.image_id and s.r = w.own group by o.image_id, w.own""",
    V,
    recursive=True,
)
def g5(spark, sf):
    return _r(bx.merge_boxes(_pred(spark, sf)), "x1", "y1", "x2", "y2")


@query(
    "g6_guard_flags",
    f"""with {TILES}, g as (select distinct t.image_id, t.tile from tl t join v_box v on v.image_id = t.image_id and v.score >= 0.7 and v.px1 < t.x2 and v.px1 + w > t.x1 and v.py1 < t.y2 and v.py1 + h > t.y1)
    select tl.image_id, tl.tile, g.tile is not null as guarded from tl left join g on g.image_id = tl.image_id and g.tile = tl.tile""",
    V,
)
def g6(spark, sf):
    return bx.guard_flags(_tiles(spark, sf), _pred(spark, sf), 0.7).select("image_id", "tile", "guarded")


@query("g7_shift_to_image", f"with {TILES}, l as (select image_id, box_id, box_id % 9 as tile, x1 % 200 as x, y1 % 200 as y, w, h from v_box) select l.image_id, l.box_id, l.tile, x + t.x1 as x1, y + t.y1 as y1, x + w + t.x1 as x2, y + h + t.y1 as y2 from l join tl t on t.image_id = l.image_id and t.tile = l.tile", V)
def g7(spark, sf):
    local = view(spark, sf, "v_box").select("image_id", "box_id", (F.col("box_id") % 9).alias("tile"), (F.col("x1") % 200).alias("x1"), (F.col("y1") % 200).alias("y1"), "w", "h")
    return bx.shift_to_image(bx.corners(local), _tiles(spark, sf))


@query("g8_reductions", "select image_id, round(1 - count(*) filter (score >= 0.7) / count(*)::double, 9) as call_reduction, round(1 - sum(w) filter (score >= 0.7) / sum(w)::double, 9) as latency_reduction from v_box group by 1 having count(*) filter (score >= 0.7) > 0", V)
def g8(spark, sf):
    from spanframe.operators.verdicts import reduction

    keep = F.col("score") >= 0.7
    g = view(spark, sf, "v_box").groupBy("image_id").agg(F.count(F.when(keep, F.lit(1))).alias("a"), F.count(F.lit(1)).alias("b"), F.sum(F.when(keep, F.col("w"))).alias("c"), F.sum("w").alias("d")).filter("a > 0")
    return _r(g.select("image_id", reduction(F.col("a"), F.col("b")).alias("call_reduction"), reduction(F.col("c"), F.col("d")).alias("latency_reduction")), "call_reduction", "latency_reduction", digits=9)


SCORE = "('0x' || substr(sha256(concat_ws('|', 'tile', image_id, tile)), 1, 13))::ubigint::double / 4503599627370496.0"


def _scored(spark, sf):
    from spanframe.functions.hashing import unit_draw

    t = bx.guard_flags(_tiles(spark, sf), _pred(spark, sf), 0.9)
    return t.withColumn("score", unit_draw("tile", "image_id", "tile"))


@query(
    "f12_select_guarded_no_coverage",
    f"""with {TILES}, g as (select distinct t.image_id, t.tile from tl t join v_box v on v.image_id = t.image_id and v.score >= 0.9 and v.px1 < t.x2 and v.px1 + w > t.x1 and v.py1 < t.y2 and v.py1 + h > t.y1),
    s as (select tl.image_id, tl.tile, g.tile is not null as guarded, {SCORE.replace('image_id', 'tl.image_id').replace(', tile)', ', tl.tile)')} as score from tl left join g on g.image_id = tl.image_id and g.tile = tl.tile),
    r as (select *, row_number() over (partition by image_id order by guarded desc, score desc, tile) as rk from s) select image_id, tile from r where rk <= 3""",
    V,
)
def f12s(spark, sf):
    return bx.select_guarded(_scored(spark, sf), 0.3, 0.0)


@query(
    "f12_select_guarded",
    f"""with recursive {TILES}, g as (select distinct t.image_id, t.tile from tl t join v_box v on v.image_id = t.image_id and v.score >= 0.9 and v.px1 < t.x2 and v.px1 + w > t.x1 and v.py1 < t.y2 and v.py1 + h > t.y1),
    s as (select tl.image_id, tl.tile, g.tile is not null as guarded, (tl.x1 + tl.x2)::double / 2 / 640 as cx, (tl.y1 + tl.y2)::double / 2 / 640 as cy,
      {SCORE.replace('image_id', 'tl.image_id').replace(', tile)', ', tl.tile)')} as score from tl left join g on g.image_id = tl.image_id and g.tile = tl.tile),
    r as (select *, row_number() over (partition by image_id, guarded order by score desc, tile) as rk, greatest(1, least(count(*) over (partition by image_id), ceil(count(*) over (partition by image_id) * 0.5::double)))::int as want from s),
    z as (select image_id, any_value(want) as want, coalesce(list({{'tile': tile, 'cx': cx, 'cy': cy}}) filter (guarded and rk <= want), []) as chosen from r group by image_id),
    walk as (select image_id, want, 0 as k, least(want - len(chosen), ceil(want * 0.4::double))::int as slots, chosen from z
      union all select w.image_id, w.want, w.k + 1, w.slots, list_append(w.chosen, list({{'tile': s.tile, 'cx': s.cx, 'cy': s.cy}}
        order by coalesce(list_min(list_transform(w.chosen, lambda c: (s.cx - c.cx) * (s.cx - c.cx) + (s.cy - c.cy) * (s.cy - c.cy))), 0) desc, s.score desc, s.tile)[1])
      from walk w join s on s.image_id = w.image_id where w.k < w.slots and not list_contains(list_transform(w.chosen, lambda c: c.tile), s.tile) group by w.image_id, w.want, w.k, w.slots, w.chosen),
    done as (select image_id, want, list_transform(chosen, lambda c: c.tile) as ts from walk where k = slots),
    more as (select s.image_id, s.tile, row_number() over (partition by s.image_id order by score desc, s.tile) as rk, want - len(ts) as room from s join done d on d.image_id = s.image_id where not list_contains(ts, s.tile))
    select image_id, unnest(ts) as tile from done union all select image_id, tile from more where rk <= room""",
    V,
    recursive=True,
)
def f12(spark, sf):
    return bx.select_guarded(_scored(spark, sf), 0.5, 0.4)


ANN = "an as (select image_id, image_id * 100 + box_id as ann_id, label as category, px1 as x, py1 as y, w, h from v_box), im as (select o_orderkey as image_id, 640 as width, 600 as height from orders)"


def _ann(spark, sf):
    return view(spark, sf, "v_box").select("image_id", (F.col("image_id") * 100 + F.col("box_id")).alias("ann_id"), F.col("label").alias("category"), F.col("px1").alias("x"), F.col("py1").alias("y"), "w", "h")


def _im(spark, sf):
    return view(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(640).alias("width"), F.lit(600).alias("height"))


@query(
    "k1_annotation_stats",
    f"""with {ANN}, p as (select im.image_id, count(an.ann_id) as n from im left join an on an.image_id = im.image_id group by 1)
    select count(*) as n_images, cast(sum(n) as bigint) as n_annotations, count(*) filter (n = 0) as n_negative, min(n) filter (n > 0) as min_per_image, max(n) as max_per_image, round(avg(n) filter (n > 0), 9) as avg_per_image,
    (select min(w * h) from an) as min_area, (select max(w * h) from an) as max_area, round((select avg(w * h) from an), 6) as avg_area from p""",
    V,
)
def k1(spark, sf):
    return _r(_r(an.annotation_stats(_im(spark, sf), _ann(spark, sf)), "avg_area"), "avg_per_image", digits=9)


@query("k1_category_stats", f"with {ANN} select category, count(*) as n, count(distinct image_id) as n_images, min(w * h) as min_area, max(w * h) as max_area, round(avg(w * h), 6) as avg_area from an group by 1", V)
def k1c(spark, sf):
    return _r(an.category_stats(_ann(spark, sf)), "avg_area")


MERGE = ANN + """, b as (select image_id, ann_id, case category when 'A' then 'Z' else category end as category, x, y, w, h from an where category <> 'N'), tp as (select (select max(image_id) from im) as i, (select max(ann_id) from an) as a),
mg as (select * from an union all select image_id + i + 1, ann_id + a + 1, category, x, y, w, h from b, tp), ct as (select category, row_number() over (order by category) - 1 as category_id from (select distinct category from mg))"""


@query("k2_merge_datasets", f"with {MERGE} select mg.*, category_id::int as category_id from mg join ct using (category)", V)
def k2(spark, sf):
    a = _ann(spark, sf)
    b = a.filter("category <> 'N'").withColumn("category", F.when(F.col("category") == "A", "Z").otherwise(F.col("category")))
    return an.merge_datasets(_im(spark, sf), a, _im(spark, sf), b)[1]


@query("k3_remap_categories", f"with {ANN} select *, case category when 'R' then 0 else 1 end as category_id from an where category in ('R', 'A')", V)
def k3(spark, sf):
    return an.remap_categories(_ann(spark, sf), {"R": 0, "A": 1})


@query("k4_filter_area", f"with {ANN} select * from an where case when category = 'A' then w * h between 400 and 900 else w * h between 1000 and 2500 end", V)
def k4(spark, sf):
    return an.filter_area(_ann(spark, sf), 1000, 2500, {"A": (400, 900)})


@query("k5_clip_boxes", f"with {ANN} select image_id, ann_id, category, greatest(x, 0) as x, greatest(y, 0) as y, least(x + w, 640) - greatest(x, 0) as w, least(y + h, 600) - greatest(y, 0) as h from an where least(x + w, 640) > greatest(x, 0) and least(y + h, 600) > greatest(y, 0)", V)
def k5(spark, sf):
    return an.clip_boxes(_ann(spark, sf), _im(spark, sf))


@query("k5_drop_negatives", f"with {ANN} select * from im where image_id in (select image_id from an)", V)
def k5n(spark, sf):
    return an.drop_negatives(_im(spark, sf), _ann(spark, sf))


DRAW = "('0x' || substr(sha256(concat_ws('|', 'sub', image_id)), 1, 13))::ubigint::bigint % 10 = 0"


@query("k6_subsample", f"with {ANN} select image_id, width, height, 'all' as mode from im where {DRAW} union all select image_id, width, height, 'category' from im where {DRAW} or image_id not in (select image_id from an where category = 'R') union all select image_id, width, height, 'negatives' from im where {DRAW} or image_id in (select image_id from an)", V)
def k6(spark, sf):
    im, a = _im(spark, sf), _ann(spark, sf)
    tag = lambda d, m: d.withColumn("mode", F.lit(m))
    return tag(an.subsample(im, a, 10, "sub"), "all").unionByName(tag(an.subsample(im, a, 10, "sub", category="R"), "category")).unionByName(tag(an.subsample(im, a, 10, "sub", negatives=True), "negatives"))


@query("k6_upsample", f"with {ANN} select image_id, width, height, unnest(range(1, 1 + case when image_id in (select image_id from an where category = 'R') then 3 else 1 end))::int as copy from im", V)
def k6u(spark, sf):
    return an.upsample(_im(spark, sf), _ann(spark, sf), 3, "R")


@query("k7_split_train_val", f"with {ANN} select *, case when ('0x' || substr(sha256(concat_ws('|', 'tv', image_id)), 1, 16))::ubigint::double / 18446744073709551616.0 < 0.85 then 'train' else 'val' end as split from im", V)
def k7(spark, sf):
    return an.split_train_val(_im(spark, sf), 0.85, "tv")


@query(
    "k8_slice_annotations",
    f"""with {ANN}, ys as (select unnest([0, 205, 344]) as s), tl as (select image_id, row_number() over (partition by image_id order by y.s, x.s) - 1 as tile, x.s as x1, y.s as y1 from im cross join {AX} x cross join ys y),
    p as (select a.image_id, tile, ann_id, category, greatest(x, x1) - x1 as nx, greatest(y, y1) - y1 as ny, least(x + w, x1 + 256) - greatest(x, x1) as nw, least(y + h, y1 + 256) - greatest(y, y1) as nh, w * h as ar from an a join tl t on t.image_id = a.image_id)
    select image_id, tile, ann_id, category, nx::double as x, ny::double as y, nw::double as w, nh::double as h from p where nw > 0 and nh > 0 and nw * nh >= 0.1 * ar""",
    V,
)
def k8(spark, sf):
    return an.slice_annotations(_im(spark, sf), _ann(spark, sf), 256, 256, 0.2)


@query("k9_to_yolo", f"with {ANN} select image_id, ann_id, printf('%d %.8f %.8f %.8f %.8f', case category when 'A' then 0 when 'N' then 1 else 2 end, (x + w / 2.0::double) / 640, (y + h / 2.0::double) / 600, w / 640.0::double, h / 600.0::double) as line from an", V)
def k9(spark, sf):
    return an.to_yolo(an.remap_categories(_ann(spark, sf), {"A": 0, "N": 1, "R": 2}), _im(spark, sf))


@query("k10_drop_invalid_predictions", "select image_id, box_id, px1 as x, py1 as y, w, h, score from v_box where px1 >= 0 and py1 >= 0 and px1 + w <= 640 and py1 + h <= 600 and score between 0 and 1", V)
def k10(spark, sf):
    p = view(spark, sf, "v_box").select("image_id", "box_id", F.col("px1").alias("x"), F.col("py1").alias("y"), "w", "h", "score")
    return an.drop_invalid_predictions(p, _im(spark, sf))
