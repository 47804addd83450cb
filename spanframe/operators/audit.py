"""Duplicates, leakage, constraints, profiles and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.functions.hashing import hex_number
from spanframe.functions.ranking import attach_group, first_in_group, linear_quantiles
from spanframe.session import durable


def content_hashes(df: DataFrame, content: str, carry: list[str]) -> DataFrame:
    """Narrow table of keys and content digests, written once to the shared folder.

    The steps after it read this table several times; content itself is read once.
    """
    return durable(df.select(*carry, F.sha2(F.col(content), 256).alias("content_hash")))


def exact_dedup(df: DataFrame, content: str, order: list[str], key: str) -> DataFrame:
    """``duplicate_of`` names the first row of the same content; null for that first row.

    Only keys and digests are shuffled, and a group of copies of any size is split
    over salts.
    """
    hashed = content_hashes(df, content, list(dict.fromkeys([key, *order])))
    first = first_in_group(hashed, ["content_hash"], order, [key]).select("content_hash", F.col(key).alias("_first"), "group_size")
    return attach_group(hashed, first, ["content_hash"], "group_size").select(
        *hashed.columns, F.when(F.col(key) != F.col("_first"), F.col("_first")).alias("duplicate_of"), "group_size"
    )


def dedup_plan(df: DataFrame, content_hash: str, label: str, split: str, path: str, held_out: str = "val") -> DataFrame:
    """Every row with ``action``: keep, drop_duplicate or drop_conflict.

    A group of equal content with one label keeps its held-out copy if it has one, else
    its lowest path; a group with several labels is dropped whole.
    """
    rows = df.select(content_hash, label, split, path)
    rank = F.when(F.col(split) == held_out, 0).otherwise(1)
    facts = rows.groupBy(content_hash).agg(
        F.min(F.struct(rank.alias("r"), F.col(path).alias("p"))).alias("_k"), (F.min(label) != F.max(label)).alias("_conflict"),
        F.count(F.lit(1)).alias("group_size"),
    )
    judged = attach_group(rows, facts, [content_hash], "group_size")
    action = F.when(F.col("_conflict"), "drop_conflict").when(F.col(path) == F.col("_k.p"), "keep").otherwise("drop_duplicate")
    return judged.select(*rows.columns, "group_size", action.alias("action"))


def dedup_report(plan: DataFrame, split: str) -> DataFrame:
    return plan.groupBy(split, "action").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("group_size") > 1, F.lit(1))).alias("n_in_groups"))


def check_group_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Case-folded groups that occur in more than one split."""
    return df.groupBy(F.lower(group).alias("group_key")).agg(
        F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows"), F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits")
    ).filter("n_splits > 1")


def violation(df: DataFrame, rule: str, condition: Column, key: Column) -> DataFrame:
    return df.filter(condition).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def unique_violations(df: DataFrame, rule: str, key: str) -> DataFrame:
    """Keys that repeat once case is folded."""
    dup = df.groupBy(F.lower(F.col(key).cast("string")).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dup.select(F.lit(rule).alias("rule"), F.col("k").alias("key"))


def contiguous_violations(df: DataFrame, rule: str, key: str, first: int = 1) -> DataFrame:
    """One row when the ids are not exactly ``first, first+1, ...``."""
    agg = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count_distinct(key).alias("n"))
    text = F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string"))
    return agg.filter((F.col("lo") != first) | (F.col("hi") - F.col("lo") + 1 != F.col("n"))).select(F.lit(rule).alias("rule"), text.alias("key"))


def reference_violations(child: DataFrame, parent: DataFrame, rule: str, fk: str, pk: str) -> DataFrame:
    """Distinct foreign keys without a parent."""
    keys = child.select(F.col(fk).alias("k")).distinct()
    return keys.join(parent.select(F.col(pk).alias("k")).distinct(), "k", "left_anti").select(F.lit(rule).alias("rule"), F.col("k").cast("string").alias("key"))


def all_violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_geometry(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """First broken rule per box: origin, size, or outside the image.

    boxes: image_id, box_id, x1, y1, w, h; images: image_id, width, height.
    """
    j = boxes.join(images, "image_id", "left")
    rule = (
        F.when(F.col("width").isNull(), "unknown_image").when((F.col("x1") < 0) | (F.col("y1") < 0), "negative_origin")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "empty_size")
        .when((F.col("x1") + F.col("w") > F.col("width")) | (F.col("y1") + F.col("h") > F.col("height")), "outside_image")
    )
    return j.withColumn("rule", rule).filter("rule is not null").select("image_id", "box_id", "rule")


def check_ranges(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ranges that are empty or leave their source. ranges: sample_id, idx, lo, hi; sizes: sample_id, n."""
    j = ranges.join(sizes, "sample_id", "left")
    rule = F.when(F.col("n").isNull(), "unknown_source").when(F.col("hi") <= F.col("lo"), "empty_range").when((F.col("lo") < 0) | (F.col("hi") > F.col("n")), "outside_source")
    return j.withColumn("rule", rule).filter("rule is not null").select("sample_id", "idx", "rule")


def profile_dataset(df: DataFrame, split: str, label: str) -> DataFrame:
    """Counts per split and class with all totals."""
    return df.cube(split, label).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def size_histogram(df: DataFrame, split: str, size: str, step: int) -> DataFrame:
    return df.groupBy(split, (F.floor(F.col(size) / step) * step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_summary(df: DataFrame, content_hash: str, split: str) -> DataFrame:
    """Groups, copies and groups that cross splits."""
    g = df.groupBy(content_hash).agg(F.count(F.lit(1)).alias("n"), (F.min(split) != F.max(split)).alias("cross")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.when(F.col("cross"), F.lit(1))).alias("n_cross_split"))


def dataset_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free digest of a table.

    Row digests are added up in four 60-bit lanes, which combines on the map side and
    needs constant memory; the sums and the row count are hashed once more.
    """
    row = df.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256).alias("h"))
    lanes = [F.sum(hex_number(F.substring("h", 1 + 15 * i, 15), 15).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    agg = row.agg(F.count(F.lit(1)).alias("n"), *lanes)
    return agg.select("n", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s0", "s1", "s2", "s3")]), 256).alias("fingerprint"))


def forbidden_names(schema: T.DataType, forbidden: Sequence[str], prefix: str = "") -> list[str]:
    """Paths of forbidden field names, nested ones too."""
    found: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            if f.name.lower() in {n.lower() for n in forbidden}:
                found.append(path)
            found += forbidden_names(f.dataType, forbidden, path + ".")
    elif isinstance(schema, T.ArrayType):
        found += forbidden_names(schema.elementType, forbidden, prefix)
    elif isinstance(schema, T.MapType):
        found += forbidden_names(schema.valueType, forbidden, prefix)
    return found


def leaking_rows(df: DataFrame) -> DataFrame:
    """Rows that hold a 64-digit hex token in any field, nested ones too."""
    return df.filter(F.to_json(F.struct(*df.columns)).rlike(r"(?i)\b[0-9a-f]{64}\b"))


def assert_no_leak(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """The table itself, or an error when a name or a value would link back to a sample."""
    names = forbidden_names(df.schema, forbidden)
    if names:
        raise ValueError(f"forbidden fields: {sorted(names)}")
    if leaking_rows(df).limit(1).count():
        raise ValueError("a value holds a 64-digit hex token")
    return df


# Secret formats, refused path endings and beginnings, executable magics.
SECRET_RULES = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "fine_grained_token": r"github_pat_[A-Za-z0-9_]{20,}",
    "classic_token": r"ghp_[A-Za-z0-9]{30,}",
    "cloud_key_id": r"AKIA[0-9A-Z]{16}",
}
FORBIDDEN_SUFFIXES = (
    ".7z", ".apk", ".bin", ".bytes", ".com", ".dex", ".dll", ".dylib", ".elf", ".engine", ".exe", ".hex", ".msi",
    ".onnx", ".pt", ".rar", ".scr", ".so", ".sys", ".torchscript", ".zip",
)
FORBIDDEN_PREFIXES = ("data/raw/", "datasets/raw/", "samples/", "quarantine/")
MAGICS = {"executable_mz": "4D5A", "executable_elf": "7F454C46"}


def scan_secrets(df: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """One finding row per (row, rule); rules are a parameter."""
    rules = {**SECRET_RULES, **(rules or {})}
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in rules.items()]))
    magic = F.array_compact(F.array(*[F.when(F.hex(F.substring(F.encode(text, "utf-8"), 1, 4)).startswith(m), F.lit(n)) for n, m in MAGICS.items()]))
    return df.select(key, F.explode(F.concat(hits, magic)).alias("rule"))


def scan_paths(df: DataFrame, key: str, path: str, suffixes=FORBIDDEN_SUFFIXES, prefixes=FORBIDDEN_PREFIXES) -> DataFrame:
    low = F.lower(path)
    rules = F.array_compact(F.array(
        *[F.when(low.endswith(s), F.lit(f"suffix {s}")) for s in suffixes], *[F.when(low.startswith(p), F.lit(f"prefix {p}")) for p in prefixes]
    ))
    return df.select(key, F.explode(rules).alias("rule"))


def shortcut_audit(df: DataFrame, label: str, feature: str, split: str = "split") -> DataFrame:
    """Nearest-centroid accuracy of one feature per split, centroids from train.

    The centroid table has one row per class and is folded into one array.
    """
    centroids = df.filter(F.col(split) == "train").groupBy(label).agg(F.avg(feature).alias("_c"))
    one = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.col("_c").alias("c")))).alias("_cs"))
    near = F.array_min(F.transform("_cs", lambda x: F.struct(F.abs(F.col(feature) - x["c"]).alias("d"), x["label"].alias("label"))))
    scored = df.join(F.broadcast(one)).withColumn("_hit", (near["label"] == F.col(label)).cast("double"))
    return scored.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"), (1.0 / F.max(F.size("_cs"))).alias("chance"),
    )


def split_summary(df: DataFrame, feature: str, split: str = "split") -> DataFrame:
    """Minimum, median, mean and low counts of a fraction per split."""
    med = linear_quantiles(df, [split], feature, {"median": 0.5}).drop("n")
    agg = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.min(feature).alias("minimum"), F.avg(feature).alias("mean"),
        F.count(F.when(F.col(feature) < 0.5, F.lit(1))).alias("below_0_5"), F.count(F.when(F.col(feature) < 0.1, F.lit(1))).alias("below_0_1"),
    )
    return agg.join(med, split)


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Full outer comparison of metric tables; both values are kept."""
    j = expected.select(*keys, F.col("value").alias("expected")).join(actual.select(*keys, F.col("value").alias("actual")), keys, "full_outer")
    status = (
        F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing")
        .when(F.abs(F.col("expected") - F.col("actual")) < tol, "match").otherwise("differs")
    )
    return j.withColumn("status", status)


def significance_changes(runs: DataFrame, published: Column, exact: Column) -> DataFrame:
    """Does a difference stay significant under another critical value?

    runs: key..., n, mean, sd. Both columns give critical values.
    """
    def excludes(t: Column) -> Column:
        return F.abs("mean") > t * F.col("sd") / F.sqrt(F.col("n").cast("double"))

    return runs.withColumn("under_published", excludes(published)).withColumn("under_exact", excludes(exact)).withColumn(
        "changes", F.col("under_published") != F.col("under_exact")
    )


def import_annotations(rois: DataFrame, images: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, violations, categories) from external regions.

    rois: path, label, x, y, w, h; images: path, image_id, split; policy: label, category
    (null category ignores the label). Names join by case-folded base name; a base name
    of several images is ambiguous.
    """
    base = lambda c: F.lower(F.regexp_extract(c, r"[^/\\]+$", 0))
    img = images.withColumn("_b", base("path")).groupBy("_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("image_id").alias("image_id"), F.min("split").alias("split")
    )
    joined = rois.withColumn("_b", base("path")).join(img, "_b", "left").join(
        # one row per label; a join on a few labels would send all rows to as few tasks
        F.broadcast(policy.select(F.lower("label").alias("_l"), "category", F.lit(True).alias("_known"))), F.lower("label") == F.col("_l"), "left"
    )
    rule = (
        F.when(F.col("_n").isNull(), "unknown_image").when(F.col("_n") > 1, "ambiguous_image").when(F.col("split").isNull(), "missing_split")
        .when(F.col("_known").isNull(), "unknown_label")
    )
    judged = joined.withColumn("_rule", rule)
    good = judged.filter(F.col("_rule").isNull() & F.col("category").isNotNull()).select("image_id", "split", "category", "x", "y", "w", "h").dropDuplicates()
    names = good.select("category").distinct()
    # One row per category name.
    cats = names.select("category", F.row_number().over(Window.orderBy(F.lower("category"), "category")).alias("category_id"))
    bad = judged.filter(F.col("_rule").isNotNull()).groupBy(F.col("_rule").alias("rule"), F.col("_b").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return good.join(F.broadcast(cats), "category"), bad, cats
