"""JSON annotation readers and detection-dataset writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.ranking import rank_in_group
from spanframe.operators.coordinates import OPCODE_MODE, STRIDE_MODES

# Fixed values of the manifest format: keys, names and patterns.
ROOT_KEYS = ("version", "name", "categories", "samples")
CATEGORY_KEYS = ("id", "name")
SAMPLE_KEYS = ("sample_id", "source", "split", "encoding", "width", "annotations", "sha256", "family_id")
ANNOTATION_KEYS = (
    "category_id", "annotation_source", "verified", "start", "end", "bbox_xywh", "annotation_version", "teacher_model", "source_score",
)
SPLITS = ("train", "val", "test")
ANNOTATION_SOURCES = ("bayesian_gradcam", "human_verified", "source_range", "synthetic")
ENCODINGS = (*STRIDE_MODES, OPCODE_MODE)
SAMPLE_ID = "^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
SHA256 = "^[0-9a-f]{64}$"
RESERVED_NAME = "^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.]|$)"
WIDTHS = (1, 8192)
_FLAT = "map<string,string>"


def _odd_keys(m: Column, known: tuple[str, ...], what: str) -> list[Column]:
    keys = F.map_keys(m)
    odd = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known])))
    return [
        F.when(F.size(odd) > 0, F.concat(F.lit(f"unknown {what} key "), F.array_join(odd, ","))),
        F.when(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(f"repeated {what} key")),
    ]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _annotation_rules(a: Column) -> list[Column]:
    has_range = F.map_contains_key(a, F.lit("start")) | F.map_contains_key(a, F.lit("end"))
    has_box = F.map_contains_key(a, F.lit("bbox_xywh"))
    box = F.from_json(a["bbox_xywh"], "array<double>")
    source, verified, score = a["annotation_source"], F.lower(a["verified"]), a["source_score"]
    return [
        *_odd_keys(a, ANNOTATION_KEYS, "annotation"),
        F.when(a["category_id"].try_cast("bigint").isNull(), "category_id is no whole number"),
        F.when(~F.coalesce(source.isin(*ANNOTATION_SOURCES), F.lit(False)), "unknown annotation_source"),
        F.when(verified.isNotNull() & ~verified.isin("true", "false"), "verified is no truth value"),
        F.when((source == "human_verified") & (verified == "false"), "human_verified but not verified"),
        F.when(has_range == has_box, "needs either a range or a box"),
        F.when(has_range & (a["start"].try_cast("bigint").isNull() | a["end"].try_cast("bigint").isNull()), "start and end are no whole numbers"),
        F.when(has_box & (box.isNull() | (F.size(box) != 4) | F.exists(box, lambda x: x.isNull() | F.isnan(x))), "bbox needs four numbers"),
        F.when(score.isNotNull() & ~F.coalesce(score.try_cast("double").between(0, 1), F.lit(False)), "source_score out of range"),
        F.when(a["annotation_version"].isNotNull() & _blank(a["annotation_version"]), "empty annotation_version"),
        F.when(a["teacher_model"].isNotNull() & _blank(a["teacher_model"]), "empty teacher_model"),
        F.when((source == "bayesian_gradcam") & _blank(a["annotation_version"]), "annotation_version is required"),
    ]


def _sample_rules(s: Column) -> list[Column]:
    sid = s["sample_id"]
    return [
        *_odd_keys(s, SAMPLE_KEYS, "sample"),
        F.when(~F.coalesce(sid.rlike(SAMPLE_ID), F.lit(False)), "bad sample_id"),
        F.when(F.upper(sid).rlike(RESERVED_NAME) | sid.endswith("."), "sample_id is no portable name"),
        F.when(_blank(s["source"]), "missing source"),
        F.when(~F.coalesce(s["split"].isin(*SPLITS), F.lit(False)), "unknown split"),
        F.when(~F.coalesce(s["encoding"].isin(*ENCODINGS), F.lit(False)), "unknown encoding"),
        F.when(F.map_contains_key(s, F.lit("width")) & ~F.coalesce(s["width"].try_cast("int").between(*WIDTHS), F.lit(False)), "width out of range"),
        F.when(s["sha256"].isNotNull() & ~F.lower(s["sha256"]).rlike(SHA256), "bad sha256"),
        F.when(s["family_id"].isNotNull() & _blank(s["family_id"]), "empty family_id"),
    ]


def parse_annotation_manifests(docs: DataFrame, content: str, doc_id: str, version: int = 1) -> dict[str, DataFrame]:
    """categories, samples, annotations and violations of versioned JSON manifests, one text per row.

    A manifest with violations is still parsed as far as it goes; every broken rule is a
    row (doc, sample, ann_pos, rule), so a caller refuses what it does not accept.
    """
    d = docs.select(F.col(doc_id).alias("doc"), F.col(content).alias("_t")).withColumn("r", F.from_json("_t", _FLAT))
    d = d.withColumn("cats", F.from_json(F.col("r")["categories"], f"array<{_FLAT}>")).withColumn("raw", F.from_json(F.col("r")["samples"], f"array<{_FLAT}>"))
    ids = F.transform("cats", lambda c: c["id"].try_cast("int"))
    names = F.transform("cats", lambda c: F.lower(c["name"]))
    sids = F.transform("raw", lambda s: F.lower(s["sample_id"]))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    root = [
        F.when(F.col("r").isNull(), "unreadable"), *_odd_keys(F.col("r"), ROOT_KEYS, "root"),
        F.when(F.coalesce(F.col("r")["version"].try_cast("int"), F.lit(-1)) != version, "wrong version"), F.when(_blank(F.col("r")["name"]), "missing name"),
        F.when(count("cats") <= 0, "no categories"), F.when(count("raw") <= 0, "no samples"),
        F.when((count("cats") > 0) & ~F.coalesce(ids == F.sequence(F.lit(1), F.greatest(F.size("cats"), F.lit(1))), F.lit(False)), "category ids do not count from 1"),
        F.when((count("cats") > 0) & (F.size(F.array_distinct(names)) != F.size("cats")), "category names repeat"),
        F.when((count("cats") > 0) & F.exists("cats", lambda c: _blank(c["name"]) | c["name"].rlike("[\\r\\n]")), "bad category name"),
        F.when((count("cats") > 0) & F.exists("cats", lambda c: F.size(F.array_except(F.map_keys(c), F.array(*[F.lit(k) for k in CATEGORY_KEYS]))) > 0), "unknown category key"),
        F.when((count("raw") > 0) & (F.size(F.array_distinct(sids)) != F.size("raw")), "sample_id repeats"),
    ]
    samples = d.select("doc", ids.alias("_ids"), F.posexplode("raw").alias("pos", "s"))
    ann = samples.select("doc", "_ids", F.col("s")["sample_id"].alias("sample_id"), F.posexplode(F.from_json(F.col("s")["annotations"], f"array<{_FLAT}>")).alias("ann_pos", "a"))
    s, a = F.col("s"), F.col("a")
    unknown = F.when(~F.array_contains("_ids", a["category_id"].try_cast("int")), "unknown category")
    none = F.lit(None).cast("int")
    broken = lambda rules: F.explode(F.array_compact(F.array(*rules))).alias("rule")
    violations = (
        d.select("doc", F.lit(None).cast("string").alias("sample"), none.alias("ann_pos"), broken(root))
        .unionByName(samples.select("doc", s["sample_id"].alias("sample"), none.alias("ann_pos"), broken(_sample_rules(s))))
        .unionByName(ann.select("doc", F.col("sample_id").alias("sample"), "ann_pos", broken([*_annotation_rules(a), unknown])))
    )
    return {
        "categories": d.select("doc", F.explode("cats").alias("c")).select("doc", F.col("c")["id"].try_cast("int").alias("id"), F.col("c")["name"].alias("name")),
        "samples": samples.select(
            "doc", "pos", s["sample_id"].alias("sample_id"), s["source"].alias("source"), s["split"].alias("split"), s["encoding"].alias("encoding"),
            F.coalesce(s["width"].try_cast("int"), F.lit(256)).alias("width"), F.lower(s["sha256"]).alias("sha256"), s["family_id"].alias("family_id")),
        "annotations": ann.select(
            "doc", "sample_id", "ann_pos", a["category_id"].try_cast("int").alias("category_id"), a["annotation_source"].alias("annotation_source"),
            F.coalesce(a["verified"].try_cast("boolean"), a["annotation_source"] == "human_verified").alias("verified"), a["start"].try_cast("bigint").alias("start"),
            a["end"].try_cast("bigint").alias("end"), F.from_json(a["bbox_xywh"], "array<double>").alias("bbox"), a["annotation_version"].alias("annotation_version"),
            a["teacher_model"].alias("teacher_model"), a["source_score"].try_cast("double").alias("source_score")),
        "violations": violations,
    }


def read_annotation_manifest(spark: SparkSession, path: str, version: int = 1) -> dict[str, DataFrame]:
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return parse_annotation_manifests(docs, "value", "file", version)


# The keys of box records, with the second name where there are two.
BOX = (
    "struct<bbox:array<double>,bbox_xywh:array<double>,category_id:bigint,class_id:bigint,category_name:string,class_name:string,"
    "score:double,confidence:double,image_id:bigint>"
)
TRUTH = "struct<annotations:array<string>,categories:array<struct<id:bigint,name:string>>,images:array<struct<id:bigint,file_name:string>>,image:string>"


def _base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]+$", 0))


def _boxes(rows: DataFrame, names: Column, scored: bool) -> DataFrame:
    """rows: doc, pos, r (a box record); names: category names by id."""
    box = F.coalesce("r.bbox", "r.bbox_xywh")
    cid = F.coalesce("r.category_id", "r.class_id")
    label = F.trim(F.coalesce("r.category_name", "r.class_name", F.try_element_at(names, cid), F.concat(F.lit("id:"), cid.cast("string"))))
    score = F.coalesce("r.score", "r.confidence") if scored else F.lit(None).cast("double")
    rule = (
        F.when(F.col("r").isNull(), "record is no object")
        .when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda x: x.isNull() | F.isnan(x)), "bbox needs four numbers")
        .when((box[2] <= 0) | (box[3] <= 0), "bbox needs a positive size").when(_blank(label), "missing label")
    )
    if scored:
        rule = rule.when(~F.coalesce(score.between(0, 1), F.lit(False)), "score out of range")
    return rows.select(
        "doc", "pos", cid.alias("category_id"), label.alias("label"), *[box[i].alias(n) for i, n in enumerate(("x", "y", "w", "h"))], score.alias("score"), rule.alias("violation")
    )


def parse_predictions(docs: DataFrame, content: str, doc: str) -> DataFrame:
    """Scored boxes of a JSON array per row; a text that is no array gives one row with a violation."""
    items = F.coalesce(F.from_json(F.when(F.ltrim(F.col(content)).startswith("["), F.col(content)), f"array<{BOX}>"), F.array(F.lit(None).cast(BOX)))
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(items).alias("pos", "r"))
    return _boxes(rows, F.create_map().cast("map<bigint,string>"), True)


def parse_truth(docs: DataFrame, content: str, doc: str, image_name: str | None = None) -> DataFrame:
    """Unscored boxes of one image per row: an object with ``annotations``, names through ``categories``.

    Where there are ``images``, the records of the image are taken whose file name, folded
    and without folders, is that in the column ``image_name``; without it there must be one
    image only. A document that breaks this gives one row with a violation.
    """
    wanted = _base_name(F.col(image_name)) if image_name else F.lit(None).cast("string")
    d = docs.select(F.col(doc).alias("doc"), wanted.alias("_want"), F.from_json(F.col(content), TRUTH).alias("t"))
    fits = F.filter("t.images", lambda i: F.col("_want").isNull() | (_base_name(i["file_name"]) == F.col("_want")))
    no_images = F.col("t.images").isNull()
    fault = (
        F.when(F.col("t.annotations").isNull(), "no annotations").when(~no_images & (F.size(fits) != 1), "no unique image")
        .when(no_images & F.col("_want").isNotNull() & F.col("t.image").isNotNull() & (_base_name(F.col("t.image")) != F.col("_want")), "another image")
    )
    d = d.withColumn("_fault", fault).withColumn("_image", fits[0]["id"]).withColumn("_names", F.map_from_entries(F.coalesce(F.transform("t.categories", lambda c: F.struct(c["id"], c["name"])), F.array().cast("array<struct<id:bigint,name:string>>"))))
    rows = d.filter("_fault is null").select("doc", "_names", "_image", F.posexplode(F.transform("t.annotations", lambda x: F.from_json(x, BOX))).alias("pos", "r"))
    rows = rows.filter(F.col("_image").isNull() | (F.col("r.image_id") == F.col("_image")))
    good = _boxes(rows, F.col("_names"), False)
    bad = d.filter("_fault is not null").select("doc", F.col("_fault").alias("violation"))
    return good.unionByName(bad, allowMissingColumns=True)


def read_roi_annotations(spark: SparkSession, paths: list[str], truth: bool = False) -> DataFrame:
    docs = spark.read.text(paths, wholetext=True).withColumn("file", F.input_file_name())
    return parse_truth(docs, "value", "file") if truth else parse_predictions(docs, "value", "file")


def detection_tables(images: DataFrame, ann: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) with dense ids per split in manifest order, and label lines.

    images: sample_id, split, pos, width, height; ann: sample_id, ann_pos, class_id (1-based), x, y, w, h.
    """
    # splits are a few names, so ranks come back without another shuffle, in the order of the sort
    img = rank_in_group(images, ["split"], [F.col("pos")], "image_id", few_groups=True)
    joined = ann.join(img.select("sample_id", "split", "image_id", "width", "height"), "sample_id")
    num = rank_in_group(joined, ["split"], [F.col("image_id"), F.col("ann_pos")], "annotation_id", few_groups=True)
    cx, cy = (F.col("x") + F.col("w") / 2.0) / F.col("width"), (F.col("y") + F.col("h") / 2.0) / F.col("height")
    line = F.format_string("%d %.8f %.8f %.8f %.8f", (F.col("class_id") - 1).cast("int"), cx, cy, F.col("w") / F.col("width").cast("double"), F.col("h") / F.col("height").cast("double"))
    return img, num.withColumn("line", line)


def document_lines(img: DataFrame, rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(split, section, id, line): in this order the lines of a split are one COCO document.

    img, rows: results of ``detection_tables``; categories: id, name. Sections: opening, images, annotations between
    their brackets, and the categories with the end. Each record is a line of its own, so
    no task and no aggregate holds a document. Missing sizes are nulls.
    """
    def record(df: DataFrame, section: int, key: str, fields: Column) -> DataFrame:
        comma = F.when(F.col(key) == 1, F.lit("")).otherwise(F.lit(","))
        text = F.to_json(fields, {"ignoreNullFields": "false"})
        return df.select("split", F.lit(section).alias("section"), F.col(key).cast("bigint").alias("id"), F.concat(comma, text).alias("line"))

    image = F.struct(F.col("image_id").alias("id"), F.col("sample_id").cast("string").alias("file_name"), "width", "height")
    box = F.struct(F.col("annotation_id").alias("id"), "image_id", F.col("class_id").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))
    names = categories.agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "name")))).alias("_names"))  # one row; a class list
    fixed = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(0).cast("bigint").alias("id"), line.alias("line")) for k, line in (
        (0, F.lit('{"images": [')), (2, F.lit('], "annotations": [')), (4, F.concat(F.lit('], "categories": '), "_names", F.lit("}"))))])
    frame = img.select("split").distinct().join(F.broadcast(names)).select("split", F.explode(fixed).alias("f")).select("split", "f.*")
    return frame.unionByName(record(img, 1, "image_id", image)).unionByName(record(rows, 3, "annotation_id", box))


def write_detection_dataset(images: DataFrame, ann: DataFrame, path: str, categories: list[str] | None = None) -> None:
    """Per split: a COCO document, tables of its records, label lines, provenance and prepared samples.

    ``documents/split=...`` holds one JSON document in text parts, written by many tasks: its
    files one after another, in name order, are the document. ``annotations`` and
    ``images`` hold the same records as JSON lines, gzipped like the other tables; ``labels`` is one table of (image, lines) per
    split, not a folder per image. ``provenance`` has one line per annotation and ``prepared`` one
    per sample; both carry the further columns of ``ann`` and ``images``. Without
    ``categories`` the class ids stand for the names. A split is there if it has an image;
    an image without boxes has no label lines.
    """
    img, rows = detection_tables(images, ann)
    rows = rows.withColumn("area", F.col("w") * F.col("h"))
    rows.select("split", "annotation_id", "image_id", F.col("class_id").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), "area", F.lit(0).alias("iscrowd")).write.mode("overwrite").partitionBy("split").json(f"{path}/annotations", compression="gzip")
    img.write.mode("overwrite").partitionBy("split").json(f"{path}/images", compression="gzip")
    labels = rows.groupBy("split", "sample_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("annotation_id", "line"))), lambda x: x["line"]), "\n").alias("value"))
    labels.write.mode("overwrite").partitionBy("split").json(f"{path}/labels", compression="gzip")
    spark = images.sparkSession
    if categories is not None:
        names = spark.createDataFrame([(i + 1, c) for i, c in enumerate(categories)], "id int, name string")
        names.write.mode("overwrite").json(f"{path}/categories")
    else:
        names = rows.select(F.col("class_id").cast("int").alias("id"), F.col("class_id").cast("string").alias("name")).distinct()
    # the records lie in this order already: sections one after another, each sorted in its own partitions
    lines = document_lines(img, rows, names)
    lines = reduce(DataFrame.unionByName, [lines.filter(F.col("section") == k) for k in range(5)]).sortWithinPartitions("split", "section", "id")
    lines.select("split", "line").write.mode("overwrite").partitionBy("split").text(f"{path}/documents")
    known = {"sample_id", "ann_pos", "class_id", "x", "y", "w", "h", "split", "image_id", "annotation_id", "width", "height", "pos"}
    box = [F.col("ann_pos").alias("source_annotation_index"), F.col("class_id").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox_xywh")]
    more = [F.col(f"`{c}`") for c in ann.columns if c not in known | {"source_annotation_index", "category_id", "bbox_xywh"}]
    rows.select("split", "sample_id", "image_id", "annotation_id", *box, *more).write.mode("overwrite").json(f"{path}/provenance", compression="gzip")
    counts = rows.groupBy("split", "sample_id").agg(F.count(F.lit(1)).alias("n_annotations"))
    prepared = img.join(counts, ["split", "sample_id"], "left").withColumn("n_annotations", F.coalesce("n_annotations", F.lit(0)))
    prepared.write.mode("overwrite").json(f"{path}/prepared", compression="gzip")
