"""Boxes, tiles and matching on images.

Boxes meet tiles and other boxes through grid cells: both sides list the cells they
touch, join on (image, cell), and a pair is kept only in the cell that holds the
corner of its intersection, so no pair appears twice and no image is joined with itself
as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.greedy import greedy_owners, greedy_pairs
from spanframe.session import durable


GRID = 256
#: Cells for tiles against boxes: a tile touches few of them, and a cell meets a bounded number of tiles.
TILE_GRID = 1024


def axis_starts(length: Column, size: int, overlap: float) -> Column:
    """Tile starts along one axis; the last start always ends at the border."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    step = max(1, round(size * (1 - overlap)))
    final = (length - size).cast("int")
    many = F.array_union(F.sequence(F.lit(0), F.greatest(final, F.lit(0)), F.lit(step)), F.array(final))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(many)


def tile_grid(images: DataFrame, w: int, h: int, overlap: float) -> DataFrame:
    """Row-major tiles of each image. images: image_id, width, height."""
    xs, ys = axis_starts(F.col("width"), w, overlap), axis_starts(F.col("height"), h, overlap)
    rows = images.withColumn("_xs", xs).select("*", F.posexplode(ys).alias("_yi", "y1"))
    rows = rows.select("*", F.posexplode("_xs").alias("_xi", "x1"))
    return rows.select(
        "image_id", "width", "height", (F.col("_yi") * F.size("_xs") + F.col("_xi")).cast("bigint").alias("tile"), F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"),
        F.least(F.col("x1") + w, F.col("width")).cast("double").alias("x2"), F.least(F.col("y1") + h, F.col("height")).cast("double").alias("y2"),
    )


def intersection(a: str, b: str) -> Column:
    dx = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    dy = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    return F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0))


def area(a: str) -> Column:
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def overlap_ratio(a: str, b: str, metric: str = "iou") -> Column:
    """Intersection over union, or over the smaller box (``ios``)."""
    inter = intersection(a, b)
    den = area(a) + area(b) - inter if metric == "iou" else F.least(area(a), area(b))
    return F.when(den > 0, inter / F.when(den > 0, den)).otherwise(0.0)


def corners(df: DataFrame, x: str = "x1", y: str = "y1", w: str = "w", h: str = "h") -> DataFrame:
    """Corner columns of an origin-and-size table."""
    d = lambda c: c.cast("double")
    out = df.withColumn("_x", d(F.col(x))).withColumn("_y", d(F.col(y))).withColumn("_x2", d(F.col(x) + F.col(w))).withColumn("_y2", d(F.col(y) + F.col(h)))
    drop = [c for c in {x, y, w, h, "x2", "y2"} if c in out.columns]
    return out.drop(*drop).withColumnRenamed("_x", "x1").withColumnRenamed("_y", "y1").withColumnRenamed("_x2", "x2").withColumnRenamed("_y2", "y2")


def _cells(df: DataFrame, grid: int) -> DataFrame:
    lo = lambda c: F.floor(F.col(c) / grid)
    hi = lambda a, b: F.greatest(F.floor(F.col(a) / grid), F.ceil(F.col(b) / grid) - 1)
    return df.withColumn("_gx", F.explode(F.sequence(lo("x1"), hi("x1", "x2")))).withColumn("_gy", F.explode(F.sequence(lo("y1"), hi("y1", "y2"))))


def touching_pairs(a: DataFrame, b: DataFrame, grid: int = GRID, extra: list[str] = ()) -> DataFrame:
    """Pairs ``a``/``b`` of one image whose interiors meet; columns stay under the aliases a and b.

    The optimizer sizes a side as if its tiles and cells were not unfolded, so a large side can
    pass for one to broadcast; the hint keeps both sides in the shuffle.
    """
    cond = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a._gx") == F.col("b._gx")) & (F.col("a._gy") == F.col("b._gy"))
    for c in extra:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    j = _cells(a, grid).alias("a").join(_cells(b, grid).alias("b").hint("merge"), cond)
    cx = F.floor(F.greatest(F.col("a.x1"), F.col("b.x1")) / grid)
    cy = F.floor(F.greatest(F.col("a.y1"), F.col("b.y1")) / grid)
    return j.filter((intersection("a", "b") > 0) & (F.col("a._gx") == cx) & (F.col("a._gy") == cy))


def tile_recall(tiles: DataFrame, truth: DataFrame, min_cov: float = 0.5) -> DataFrame:
    """Share of truth boxes of which one tile covers enough; an image without truth scores 1."""
    best = touching_pairs(truth, tiles).withColumn("_c", intersection("a", "b") / area("a")).groupBy(F.col("a.image_id").alias("image_id"), F.col("a.box_id").alias("box_id")).agg(F.max("_c").alias("_c"))
    per = truth.select("image_id", "box_id").join(best, ["image_id", "box_id"], "left").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_truth"), F.avg((F.coalesce("_c", F.lit(0.0)) >= min_cov).cast("double")).alias("recall")
    )
    images = tiles.select("image_id").distinct()
    return images.join(per, "image_id", "left").select("image_id", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("recall", F.lit(1.0)).alias("recall"))


def guard_flags(tiles: DataFrame, boxes: DataFrame, threshold: float) -> DataFrame:
    """Tiles touched by a box of at least the threshold score.

    The hit tiles of an image, a grid of bounded size, come back as one array by image, so that
    the tiles themselves need not move.
    """
    near = touching_pairs(tiles, boxes.filter(F.col("score") >= threshold).select("image_id", "x1", "y1", "x2", "y2"), TILE_GRID)
    hit = near.groupBy(F.col("a.image_id").alias("image_id")).agg(F.collect_set("a.tile").alias("_hit"))
    return tiles.join(hit.hint("merge"), "image_id", "left").withColumn("guarded", F.coalesce(F.array_contains("_hit", F.col("tile")), F.lit(False))).drop("_hit")


def shift_to_image(local: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile-local boxes in image coordinates."""
    t = tiles.select("image_id", "tile", F.col("x1").alias("_dx"), F.col("y1").alias("_dy"))
    j = local.join(t, ["image_id", "tile"])
    for c, d in (("x1", "_dx"), ("x2", "_dx"), ("y1", "_dy"), ("y2", "_dy")):
        j = j.withColumn(c, F.col(c) + F.col(d))
    return j.drop("_dx", "_dy")


def localization_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from n_pred, n_truth, tp with the rules for empty sets."""
    p, t, tp = F.col("n_pred"), F.col("n_truth"), F.col("tp")
    prec = F.when(p > 0, tp / F.when(p > 0, p)).otherwise(F.when(t == 0, 1.0).otherwise(0.0))
    rec = F.when(t > 0, tp / F.when(t > 0, t)).otherwise(1.0)
    out = df.withColumn("fp", p - tp).withColumn("fn", t - tp).withColumn("precision", prec).withColumn("recall", rec)
    s = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / F.when(s > 0, s)).otherwise(0.0))


def match_detections(pred: DataFrame, truth: DataFrame, iou: float = 0.5) -> DataFrame:
    """Status per prediction and truth box: true_positive, class_mismatch, false_positive, false_negative.

    pred: image_id, box_id, label, score, corners; truth: image_id, box_id, label, corners.
    Only pairs of enough overlap can ever match: predictions by falling score take their
    best free truth box of the same folded label, then the rest, by id, report overlaps with
    another label. An image of few pairs is walked in its row, others run as rounds over all
    images, so an image may hold any number of boxes. A null score counts as 0.
    """
    near = touching_pairs(pred, truth).withColumn("iou", overlap_ratio("a", "b", "iou")).filter(F.col("iou") >= iou)
    pairs = near.select(
        F.col("a.image_id").alias("image_id"), F.col("a.box_id").alias("pred_id"), F.col("b.box_id").alias("truth_id"), F.coalesce(F.col("a.score"), F.lit(0.0)).alias("score"), "iou",
        (F.lower(F.col("a.label")) == F.lower(F.col("b.label"))).alias("same"),
    )

    # pairs of one label come first, so one pass in this order is both passes
    order = [~F.col("same"), F.when(F.col("same"), -F.col("score")).otherwise(0.0), F.col("pred_id"), -F.col("iou"), F.col("truth_id")]
    taken = durable(greedy_pairs(pairs, "image_id", "pred_id", "truth_id", order))
    matched = taken.select("image_id", "pred_id", "truth_id", "iou", F.when(F.col("same"), "true_positive").otherwise("class_mismatch").alias("status"))
    tp = matched.filter("status = 'true_positive'")
    none = lambda t: F.lit(None).cast(t)
    fp = pred.select("image_id", F.col("box_id").alias("pred_id")).join(tp.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti")
    fn = truth.select("image_id", F.col("box_id").alias("truth_id")).join(tp.select("image_id", "truth_id"), ["image_id", "truth_id"], "left_anti")
    return matched.unionByName(fp.select("image_id", "pred_id", none("bigint").alias("truth_id"), none("double").alias("iou"), F.lit("false_positive").alias("status"))).unionByName(
        fn.select("image_id", none("bigint").alias("pred_id"), "truth_id", none("double").alias("iou"), F.lit("false_negative").alias("status"))
    )


def status_counts(status: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, F.lit(1)))
    g = status.groupBy("image_id").agg(n("true_positive").alias("tp"), n("false_positive").alias("_fp"), n("false_negative").alias("_fn"), n("class_mismatch").alias("class_mismatches"))
    return localization_metrics(g.withColumn("n_pred", F.col("tp") + F.col("_fp")).withColumn("n_truth", F.col("tp") + F.col("_fn")).drop("_fp", "_fn"))


def merge_boxes(det: DataFrame, threshold: float = 0.5, metric: str = "ios", class_aware: bool = True) -> DataFrame:
    """Greedy merge: the best box absorbs what overlaps it; coordinates are score-weighted.

    det: image_id, box_id, label, score, corners. Boxes go by falling score, then label,
    corners and id; one that is still free takes its free partners. This runs as rounds over
    all images, so an image may hold any number of boxes.
    """
    extra = ["label"] if class_aware else []
    place = lambda a: F.struct((-F.col(f"{a}.score")).alias("neg"), *[F.col(f"{a}.{c}").alias(c) for c in ("label", "x1", "y1", "x2", "y2", "box_id")])
    pair = touching_pairs(det, det, extra=extra).filter((place("b") < place("a")) & (overlap_ratio("a", "b", metric) >= threshold))
    rivals = pair.select(F.col("a.image_id").alias("image_id"), F.col("a.box_id").alias("box_id"), F.col("b.box_id").alias("rival"), place("b").alias("key"))
    owners = greedy_owners(det, rivals, "image_id", "box_id")
    w = F.greatest(F.col("score"), F.lit(1e-8))
    label = det.select("image_id", F.col("box_id").alias("owner"), "label")
    groups = det.join(owners, ["image_id", "box_id"]).groupBy("image_id", "owner").agg(
        F.max("score").alias("score"), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("x1", "y1", "x2", "y2")], F.count(F.lit(1)).alias("n_merged"))
    return groups.join(label, ["image_id", "owner"]).select("image_id", "label", "score", "x1", "y1", "x2", "y2", "n_merged")


def select_guarded(tiles: DataFrame, budget: float, coverage_ratio: float = 0.2) -> DataFrame:
    """Exact-budget tiles: guarded first by score, then farthest-point slots, then best score.

    tiles: image_id, tile, score, guarded, corners, width, height. The tiles of one
    image form a grid of bounded size, so they travel as one array row per image.
    """
    cx = (F.col("x1") + F.col("x2")) / 2 / F.col("width")
    cy = (F.col("y1") + F.col("y2")) / 2 / F.col("height")
    cell = F.struct("tile", F.col("score").cast("double").alias("score"), F.col("guarded").alias("guarded"), cx.alias("cx"), cy.alias("cy"))
    names = ("tile", "score", "guarded", "cx", "cy")
    rows = tiles.groupBy("image_id").agg(F.collect_list(cell).alias("cells")).select("image_id", *[F.col("cells")[c].alias(c) for c in names])

    def choose(tile, score, guarded, cx, cy):
        """Chosen tiles of images that have equally many: one row of each array per image."""
        m, n = tile.shape
        want = max(1, min(n, math.ceil(n * budget)))
        rank = np.lexsort((tile, -score), axis=-1)
        place = np.argsort(rank, axis=-1)  # of each tile in the order of scores

        def first(mask, limit):
            """The first ``limit`` tiles of the mask in the order of scores."""
            ranked = np.take_along_axis(mask, rank, 1)
            ranked &= np.cumsum(ranked, axis=1) <= limit
            return np.take_along_axis(ranked, place, 1)

        chosen = first(guarded, want)
        near = np.full((m, n), np.inf)  # squared distance to the nearest chosen tile, -inf for chosen ones

        def approach(at, c):
            dx, dy = cx[at] - cx[at, c][:, None], cy[at] - cy[at, c][:, None]
            near[at] = np.minimum(near[at], dx * dx + dy * dy)
            near[at, c] = -np.inf

        for c in range(n):
            at = np.flatnonzero(chosen[:, c])
            approach(at, np.full(len(at), c))
        slots = np.minimum(want - chosen.sum(axis=1), math.ceil(want * coverage_ratio))
        for k in range(slots.max(initial=0)):
            at = np.flatnonzero(slots > k)
            far = near[at] == near[at].max(axis=1, keepdims=True)  # before the first choice all are as far
            best = np.argmin(np.where(far, place[at], n), axis=1)
            chosen[at, best] = True
            approach(at, best)
        return chosen | first(~chosen, want - chosen.sum(axis=1, keepdims=True))

    def run(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column("tile"))
            for n in pc.unique(sizes).to_pylist():
                same = b.filter(pc.equal(sizes, n))
                tile, score, guarded, cx, cy = (same.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in names)
                at, k = np.nonzero(choose(tile, score, guarded, cx, cy))
                yield pa.RecordBatch.from_arrays([same.column("image_id").take(pa.array(at)), pa.array(tile[at, k])], names=["image_id", "tile"])

    return rows.mapInArrow(run, "image_id bigint, tile bigint")
