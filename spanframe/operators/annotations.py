"""Annotation-table operators: images, categories and boxes as three tables.

annotations: image_id, ann_id, category, x, y, w, h; images: image_id, width, height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.hashing import index_draw
from spanframe.operators.boxes import area, corners, intersection, tile_grid, touching_pairs
from spanframe.operators.cohort import hash_split


def annotation_stats(images: DataFrame, ann: DataFrame) -> DataFrame:
    """One row of totals: counts, negatives, per-image and area extremes."""
    per = images.select("image_id").join(ann.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id", "left").na.fill(0, ["n"])
    a = per.agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("n").alias("n_annotations"), F.count(F.when(F.col("n") == 0, F.lit(1))).alias("n_negative"),
        F.min(F.when(F.col("n") > 0, F.col("n"))).alias("min_per_image"), F.max("n").alias("max_per_image"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("avg_per_image"),
    )
    size = F.col("w") * F.col("h")
    return a.join(F.broadcast(ann.agg(F.min(size).alias("min_area"), F.max(size).alias("max_area"), F.avg(size).alias("avg_area"))))


def category_stats(ann: DataFrame) -> DataFrame:
    size = F.col("w") * F.col("h")
    return ann.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("n_images"), F.min(size).alias("min_area"), F.max(size).alias("max_area"), F.avg(size).alias("avg_area")
    )


def category_ids(ann: DataFrame) -> DataFrame:
    """Dense ids by name; one row per category."""
    names = ann.select("category").distinct()
    return names.select("category", (F.row_number().over(Window.orderBy("category")) - 1).alias("category_id"))


def merge_datasets(images_a: DataFrame, ann_a: DataFrame, images_b: DataFrame, ann_b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories): the second set's ids move behind the first's; categories unite by name."""
    top = images_a.agg(F.coalesce(F.max("image_id"), F.lit(-1)).alias("_i")).join(F.broadcast(ann_a.agg(F.coalesce(F.max("ann_id"), F.lit(-1)).alias("_a"))))

    def moved(df: DataFrame, cols: dict[str, str]) -> DataFrame:
        out = df.join(F.broadcast(top))
        for c, off in cols.items():
            out = out.withColumn(c, F.col(c) + F.col(off) + 1)
        return out.drop("_i", "_a")

    ann = ann_a.unionByName(moved(ann_b, {"image_id": "_i", "ann_id": "_a"}))
    cats = category_ids(ann)
    return images_a.unionByName(moved(images_b, {"image_id": "_i"})), ann.join(cats, "category"), cats


def remap_categories(ann: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """Keep the named categories under their new ids; the mapping is a parameter."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return ann.withColumn("category_id", F.try_element_at(m, F.col("category"))).filter("category_id is not null")


def filter_area(ann: DataFrame, lo: float, hi: float, per_category: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Annotations within area bounds, with optional bounds per category."""
    low, high = F.lit(float(lo)), F.lit(float(hi))
    for c, (a, b) in (per_category or {}).items():
        low, high = F.when(F.col("category") == c, float(a)).otherwise(low), F.when(F.col("category") == c, float(b)).otherwise(high)
    size = F.col("w") * F.col("h")
    return ann.filter((size >= low) & (size <= high))


def clip_boxes(ann: DataFrame, images: DataFrame) -> DataFrame:
    """Cut boxes to their image; what lies outside is dropped."""
    j = ann.join(images.select("image_id", "width", "height"), "image_id")
    x1, y1 = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    x2, y2 = F.least(F.col("x") + F.col("w"), F.col("width")), F.least(F.col("y") + F.col("h"), F.col("height"))
    j = j.withColumn("_x", x1).withColumn("_y", y1).withColumn("_w", x2 - x1).withColumn("_h", y2 - y1).filter("_w > 0 and _h > 0")
    return j.select(*[c for c in ann.columns if c not in ("x", "y", "w", "h")], F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_w").alias("w"), F.col("_h").alias("h"))


def drop_negatives(images: DataFrame, ann: DataFrame) -> DataFrame:
    return images.join(ann.select("image_id").distinct(), "image_id", "left_semi")


def subsample(images: DataFrame, ann: DataFrame, ratio: int, seed: str | int, category: str | None = None, negatives: bool = False) -> DataFrame:
    """Keep one image in ``ratio`` by hash: of all, of those with a category, or of the negatives."""
    keep = index_draw(F.lit(ratio), seed, "image_id") == 0
    if negatives:
        marked = images.join(ann.select("image_id").distinct().withColumn("_m", F.lit(True)), "image_id", "left").withColumn("_t", F.col("_m").isNull())
    elif category is not None:
        marked = images.join(ann.filter(F.col("category") == category).select("image_id").distinct().withColumn("_t", F.lit(True)), "image_id", "left")
    else:
        return images.filter(keep)
    return marked.filter(~F.coalesce("_t", F.lit(False)) | keep).select(*images.columns)


def upsample(images: DataFrame, ann: DataFrame, ratio: int, category: str | None = None) -> DataFrame:
    """Repeat every image, or those with a category, ``ratio`` times; ``copy`` numbers the repeats."""
    marked = images.withColumn("_t", F.lit(True)) if category is None else images.join(
        ann.filter(F.col("category") == category).select("image_id").distinct().withColumn("_t", F.lit(True)), "image_id", "left"
    )
    times = F.when(F.coalesce("_t", F.lit(False)), ratio).otherwise(1)
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*images.columns, "copy")


def split_train_val(images: DataFrame, rate: float, salt: str) -> DataFrame:
    return images.withColumn("split", F.when(hash_split("image_id", (rate, 1 - rate, 0.0), salt) == "train", "train").otherwise("val"))


def slice_annotations(images: DataFrame, ann: DataFrame, w: int, h: int, overlap: float, min_area_ratio: float = 0.1) -> DataFrame:
    """Boxes cut and shifted into every tile that keeps enough of them."""
    tiles = tile_grid(images, w, h, overlap)
    p = touching_pairs(corners(ann, "x", "y", "w", "h"), tiles)
    left = lambda c: F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}"))
    right = lambda c: F.least(F.col(f"a.{c}"), F.col(f"b.{c}"))
    kept = p.filter(intersection("a", "b") >= min_area_ratio * area("a"))
    return kept.select(
        F.col("a.image_id").alias("image_id"), F.col("b.tile").alias("tile"), F.col("a.ann_id").alias("ann_id"), F.col("a.category").alias("category"),
        (left("x1") - F.col("b.x1")).alias("x"), (left("y1") - F.col("b.y1")).alias("y"), (right("x2") - left("x1")).alias("w"), (right("y2") - left("y1")).alias("h"),
    )


def to_yolo(ann: DataFrame, images: DataFrame, class_id: str = "category_id") -> DataFrame:
    """One label line per box: class, normalised centre and size with eight decimals."""
    j = ann.join(images.select("image_id", "width", "height"), "image_id")
    cx, cy = (F.col("x") + F.col("w") / 2.0) / F.col("width"), (F.col("y") + F.col("h") / 2.0) / F.col("height")
    line = F.format_string("%d %.8f %.8f %.8f %.8f", F.col(class_id).cast("int"), cx, cy, F.col("w") / F.col("width").cast("double"), F.col("h") / F.col("height").cast("double"))
    return j.select("image_id", "ann_id", line.alias("line"))


def drop_invalid_predictions(pred: DataFrame, images: DataFrame) -> DataFrame:
    """Predictions with sane fields inside their image."""
    j = pred.join(images.select("image_id", "width", "height"), "image_id")
    ok = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & F.col("score").between(0, 1)
    ok = ok & (F.col("x") + F.col("w") <= F.col("width")) & (F.col("y") + F.col("h") <= F.col("height"))
    return j.filter(ok).select(*pred.columns)
