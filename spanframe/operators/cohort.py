"""Cohort curation: splits, strata, deterministic sampling, replacement and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.hashing import hash_hex, index_draw
from spanframe.functions.ranking import attach_group, order_values, rank_in_group, sorted_rank, top_in_group
from spanframe.session import durable

SPLITS = ("train", "validation", "test")
EFFECTIVE_ROLES = ("primary", "replacement")


def read_candidates(df: DataFrame, required: Sequence[str], predicate: Column, tag_columns: dict[str, str], keep: dict[str, str]) -> DataFrame:
    """Check required columns, filter, and derive tags and counts.

    The filter and the column choice reach the scan; missing columns are an error that
    lists them in order.
    """
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"source lacks required columns: {missing}")
    count = {tag: F.coalesce(F.col(c), F.lit(0)).cast("int") for tag, c in tag_columns.items()}
    tags = F.array_compact(F.array(*[F.when(c > 0, F.lit(t)) for t, c in count.items()]))
    counts = F.create_map(*[x for t, c in count.items() for x in (F.lit(t), c)])
    return df.filter(predicate).select(*[F.col(c).alias(n) for n, c in keep.items()], tags.alias("tags"), counts.alias("tag_counts"))


def temporal_split(ts: Column, cuts: tuple[Column, Column]) -> Column:
    """Strictly before the first cut: train; before the second: validation; else test."""
    return F.when(ts < cuts[0], "train").when(ts < cuts[1], "validation").otherwise("test")


def hash_split(key: str, fractions: Sequence[float], salt: str) -> Column:
    """Split by the first 16 hex digits of the salted hash against cumulative fractions."""
    if len(fractions) != 3 or abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("fractions must be three numbers that sum to 1")
    u = F.conv(F.substring(hash_hex(salt, key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
    return F.when(u < fractions[0], "train").when(u < fractions[0] + fractions[1], "validation").otherwise("test")


def parse_tag_counts(text: Column) -> Column:
    """``a=3;b=1`` as a map; parts without a whole number are skipped, a repeated name keeps its last count."""
    parts = F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.trim(F.substr(p, F.instr(p, F.lit("=")) + 1)).try_cast("int").alias("v"),
        ),
    )
    good = F.filter(parts, lambda e: e["v"].isNotNull())
    last = F.filter(good, lambda e, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def format_tag_counts(counts: Column, order: Sequence[str]) -> Column:
    """Non-zero counts as ``name=count`` in the frozen order."""
    cells = [F.when(counts[t] != 0, F.concat(F.lit(f"{t}="), counts[t].cast("string"))) for t in order]
    return F.concat_ws(";", *cells)


def dominant_tag(counts: Column, order: Sequence[str]) -> Column:
    """Largest positive count; ties go to the earlier tag of the frozen order; none gives null."""
    cells = F.array(*[
        F.struct(F.coalesce(F.try_element_at(counts, F.lit(t)), F.lit(0)).alias("c"), F.lit(-i).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(order)
    ])
    best = F.array_max(cells)
    return F.when(best["c"] > 0, best["t"])


def count_tertiles(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Order statistics at one and two thirds of the pool, one row per group."""
    rows = order_values(df, by, col, {
        "t1": lambda n: F.least(n - 1, F.floor(n / 3)),
        "t2": lambda n: F.least(n - 1, F.floor(2 * n / 3)),
    })
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in ("t1", "t2")], F.max("n").alias("n"))


def count_stratum(value: Column, t1: Column, t2: Column) -> Column:
    return F.when(value <= t1, "low").when(value <= t2, "mid").otherwise("high")


def _first_by_prefix(long: DataFrame, target: int, digits: int = 3) -> DataFrame:
    """Rows whose hash prefix is among the lowest that hold ``target`` members of their stratum.

    Nothing of the first ``target`` in hash order is lost. Counts per prefix are at most 16 ** ``digits``
    rows a stratum; they cut the rows as they are read, so no task sorts a share of the table.
    """
    keys = ["split", "s"]
    cells = long.groupBy(*keys, F.substring("h", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    last = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < target)
    last = last.groupBy(*keys).agg(F.max("_p").alias("_last"))  # one row per split and stratum
    near = F.col("x.split").eqNullSafe(F.col("y.split")) & F.col("x.s").eqNullSafe(F.col("y.s")) & (F.substring("x.h", 1, digits) <= F.col("y._last"))
    return long.alias("x").join(F.broadcast(last).alias("y"), near).select("x.*")


def stratified_round_robin(df: DataFrame, target: int, seed: str, tags: Sequence[str]) -> DataFrame:
    """Round-robin pick over tag, no-tag and tertile strata, then fill in hash order.

    ``df``: sample_id, split, tags, stratum (low/mid/high). A pick of a stratum, and a
    fill, can only lie among its first ``target`` members in hash order, so each split
    sends at most ``(strata + 1) * target`` narrow rows to its greedy step.
    """
    strata = [*tags, "no_tag", "low", "mid", "high"]
    keyed = df.select("sample_id", "split", "tags", "stratum", F.sha2(F.concat(F.lit(seed), F.col("sample_id").cast("string")), 256).alias("h"))
    member = F.concat(
        F.when(F.size("tags") == 0, F.array(F.lit("no_tag"))).otherwise(F.array_intersect("tags", F.array(*[F.lit(t) for t in tags]))),
        F.array(F.col("stratum"), F.lit("any")),
    )
    long = keyed.select("sample_id", "split", "h", F.explode(member).alias("s"))
    short = top_in_group(_first_by_prefix(long, target), ["split", "s"], [F.col("h"), F.col("sample_id")], target)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = {s: iter(g.sort_values(["h", "sample_id"])["sample_id"].tolist()) for s, g in pdf.groupby("s")}
        used: dict = {}

        def head(s: str):
            return next((x for x in waiting.get(s, ()) if x not in used), None)

        # a stratum's next turn is (round, place); the smallest turn picks, an empty stratum leaves
        turns = [(0, k) for k in range(len(strata))]
        while turns and len(used) < target:
            lap, k = heappop(turns)
            sid = head(strata[k])
            if sid is not None:
                used[sid] = strata[k]
                heappush(turns, (lap + 1, k))
        while len(used) < target and (sid := head("any")) is not None:
            used[sid] = "any"
        return pd.DataFrame({"split": pdf["split"].iloc[0], "sample_id": list(used), "slot": range(len(used)), "via": list(used.values())})

    id_type = df.schema["sample_id"].dataType.simpleString()
    return short.groupBy("split").applyInPandas(greedy, f"split string, sample_id {id_type}, slot bigint, via string")


def reserve_pool(df: DataFrame, picked: DataFrame, target: int, seed: str) -> DataFrame:
    """The next fifth of the target per split, unused and in hash order."""
    left = df.select("sample_id", "split").join(picked.select("sample_id"), "sample_id", "left_anti")
    keyed = left.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("sample_id").cast("string")), 256))
    return top_in_group(keyed, ["split"], [F.col("h"), F.col("sample_id")], (target + 4) // 5).drop("h")


def cap_per_group(df: DataFrame, group: str, cap: int, seed: str | int, key: str = "sample_id") -> DataFrame:
    """At most ``cap`` rows per group, lowest hash first."""
    return top_in_group(df.withColumn("_h", hash_hex(seed, key)), [group], [F.col("_h"), F.col(key)], cap).drop("_h")


def stratified_holdout(df: DataFrame, label: str, per_class: int, fraction: float, seed: str | int, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(holdout rows, refused classes): a class that would keep no training row is refused."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "quota", F.least(F.lit(per_class), F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("bigint")))
    )
    first = top_in_group(df.withColumn("_h", hash_hex(seed, key)), [label], [F.col("_h"), F.col(key)], per_class, "_r")
    held = first.join(sizes.filter("n > quota"), label).filter(F.col("_r") <= F.col("quota"))
    return held.drop("_h", "_r", "n", "quota"), sizes.filter("n <= quota")


def effective_rows(df: DataFrame) -> DataFrame:
    """Rows that make up the sample now."""
    return df.filter(F.col("role").isin(*EFFECTIVE_ROLES) & (F.coalesce("exclusion_reason", F.lit("")) == ""))


HEX64 = "[0-9a-f]{64}"


def mask_tokens(text: Column) -> Column:
    """Replace every 64-digit hex token."""
    return F.regexp_replace(text, HEX64, "<sha>")


def error_bucket(error: Column, width: int = 160) -> Column:
    """Token-free, class-prefix-free key for counting failures."""
    masked = mask_tokens(F.when(F.coalesce(error, F.lit("")) == "", "unknown").otherwise(error))
    return F.substring(F.regexp_replace(masked, r"^[A-Za-z_]\w*(?:Error|Exception): ", ""), 1, width)


def bucket_errors(df: DataFrame, error: str) -> DataFrame:
    return df.groupBy(error_bucket(F.col(error)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """Counts by the text before the first colon."""
    return df.groupBy(F.substring_index(F.coalesce(reason, F.lit("unknown")), ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def promote_reserves(manifest: DataFrame, outcomes: DataFrame, stage: str) -> DataFrame:
    """Exclude failed effective rows and promote reserves of the same split in manifest order.

    manifest: sample_id, split, role, pos, exclusion_reason, replaces; outcomes: sample_id, ok, error.
    The n-th failure of a split meets its n-th reserve through an equi join on (split, n);
    splits larger than one task are ranked by a distributed sort.
    """
    clean = F.coalesce("exclusion_reason", F.lit("")) == ""
    joined = manifest.join(outcomes.select("sample_id", F.col("ok").alias("_ok"), F.col("error").alias("_err")), "sample_id", "left")
    failed = joined.filter(F.col("role").isin(*EFFECTIVE_ROLES) & clean & (F.col("_ok") == False)).select("sample_id", "split", "pos", "_err")  # noqa: E712
    spare = manifest.filter((F.col("role") == "reserve") & clean).select("sample_id", "split", "pos")
    f = rank_in_group(failed, ["split"], [F.col("pos")], "_n")
    r = rank_in_group(spare, ["split"], [F.col("pos")], "_n")
    swaps = r.join(f.select("split", "_n", F.col("sample_id").alias("_replaces")), ["split", "_n"]).select("sample_id", "_replaces")
    reasons = failed.select("sample_id", F.concat(F.lit(f"{stage}:"), mask_tokens(F.when(F.coalesce("_err", F.lit("")) == "", "unknown").otherwise(F.col("_err")))).alias("_reason"))
    out = manifest.join(reasons, "sample_id", "left").join(swaps, "sample_id", "left")
    return out.select(
        *[c for c in manifest.columns if c not in ("role", "exclusion_reason", "replaces")],
        F.when(F.col("_replaces").isNotNull(), "replacement").otherwise(F.col("role")).alias("role"),
        F.coalesce("_reason", "exclusion_reason").alias("exclusion_reason"),
        F.coalesce(F.col("_replaces"), F.col("replaces")).alias("replaces"),
    )


def promotion_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per split: excluded, promoted, effective after, reserves left, exhausted."""
    moved = after.alias("a").join(before.select("sample_id", F.col("role").alias("_role0"), F.col("exclusion_reason").alias("_ex0")), "sample_id")
    clean = F.coalesce("exclusion_reason", F.lit("")) == ""
    count = lambda c: F.count(F.when(c, F.lit(1)))
    newly = ~clean & (F.coalesce("_ex0", F.lit("")) == "")
    out = moved.groupBy("split").agg(
        count(newly).alias("excluded"), count((F.col("role") == "replacement") & (F.col("_role0") == "reserve")).alias("promoted"),
        count(F.col("role").isin(*EFFECTIVE_ROLES) & clean).alias("effective_after"), count((F.col("role") == "reserve") & clean).alias("reserve_remaining"),
    )
    return out.withColumn("reserve_exhausted", F.col("excluded") > F.col("promoted"))


def budget_guard(df: DataFrame, size: str, ok: Column, cap: int) -> DataFrame:
    """Total size of the ok rows and whether it is refused."""
    return df.filter(ok).agg(F.coalesce(F.sum(size), F.lit(0)).alias("total")).select("total", (F.col("total") > cap).alias("refused"))


def budget_prefix(df: DataFrame, order: list[str], size: str, cap: int) -> DataFrame:
    """Rows of the longest prefix in ``order`` whose running size fits the cap.

    One range sort; partition sums give each partition its offset.
    """
    rows = durable(df.sort(*order).withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33)))
    sums = rows.groupBy("_part").agg(F.sum(size).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))  # one row per partition
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum(size).over(inside)).join(F.broadcast(offsets), "_part")
    run = run.withColumn("running_total", F.col("_run") + F.col("_off"))
    return run.filter(F.col("running_total") <= cap).drop("_mid", "_part", "_run", "_off")


def label_set(df: DataFrame, label: str, order: Sequence[str], min_support: int, other: str = "other") -> tuple[DataFrame, DataFrame]:
    """(classes, samples): classes with enough train support keep their name, the rest become ``other``.

    The class table has at most one row per name of the frozen order.
    """
    names = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(order)], f"{label} string, _pos int")
    support = df.filter(F.col("split") == "train").groupBy(label).agg(F.count(F.lit(1)).alias("train_support"))
    table = names.join(support, label, "left").na.fill(0, ["train_support"])
    kept = F.col("train_support") >= min_support
    w = Window.orderBy("_pos")  # one row per class name
    classes = table.withColumn("_kept", kept).withColumn(
        "_rank", F.sum(kept.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    )
    whole = Window.partitionBy(F.lit(0))
    needs_other = F.max((~kept & (F.col("train_support") > 0)).cast("int")).over(whole) == 1
    n_kept = F.sum(kept.cast("int")).over(whole)
    classes = classes.select(
        label, "train_support", F.when(F.col("_kept"), F.col(label)).when(needs_other, F.lit(other)).alias("class_name"),
        F.when(F.col("_kept"), F.col("_rank")).when(needs_other, n_kept).cast("int").alias("class_index"),
    )
    return classes, df.join(F.broadcast(classes.select(label, "class_name", "class_index")), label, "left")


def label_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("class_index").alias("trainable"))


def class_weights(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """``total / (C * n_c)``; a class without rows weighs 0. ``classes`` lists the labels."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = classes.select(label).join(n, label, "left").na.fill(0, ["n"])
    w = Window.partitionBy(F.lit(0))  # one row per class
    total, c = F.sum("n").over(w), F.count(F.lit(1)).over(w)
    return t.select(label, "n", F.when(F.col("n") > 0, total / (c * F.when(F.col("n") > 0, F.col("n")))).otherwise(0.0).alias("weight"))


def pseudonymize(df: DataFrame, order: list[str], prefix: str = "case") -> DataFrame:
    """Stable labels ``case-001`` in the given order, numbered by a distributed sort."""
    ranked = sorted_rank(df, [], [F.col(c) for c in order], "_n")
    return ranked.withColumn("case", F.format_string(f"{prefix}-%03d", F.col("_n"))).drop("_n")


def matched_pairs(
    samples: DataFrame, host_edges: DataFrame, donor_edges: DataFrame, length: int, block: int,
    seed: str | int, attempts: int = 32, max_seam: float = 0.3,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejections): per host one cross-group and one same-group donor at the same place.

    samples: sample_id, grp, n. host_edges: sample_id, pos, before, after (entropy of the
    windows that end and start at a block position). donor_edges: sample_id, head, tail
    (window entropies of the donor's middle piece). Donors are drawn by hash into a
    numbered list per group, so hosts meet them by equi join: hosts x attempts rows,
    never all pairs, and content itself is not moved.
    """
    donors = rank_in_group(samples.filter(F.col("n") >= length).select("sample_id", "grp"), ["grp"], [F.col("sample_id")], "_no")
    groups = donors.groupBy("grp").agg(F.max("_no").alias("_size"))
    # Numbered groups; a group list has one row per label.
    groups = groups.withColumn("_g", F.row_number().over(Window.orderBy("grp")) - 1).withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    hosts = samples.filter(F.col("n") >= 3 * length).join(groups, "grp").join(donors.select("sample_id", F.col("_no").alias("_own")), "sample_id", "left")
    tries = hosts.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    limit = F.col("n") - length
    draw = lambda n, what: index_draw(n, seed, F.lit(what), "sample_id", "attempt")
    start = F.least(F.floor(draw(limit + 1, "start") / block) * block, F.floor(limit / block) * block)
    other = draw(F.greatest(F.col("_groups") - 1, F.lit(1)), "group")
    tries = tries.filter("_groups > 1 and _size > 1").withColumn("start", start).withColumn("_og", other + (other >= F.col("_g")).cast("int"))
    mine = draw(F.col("_size") - 1, "native")
    tries = tries.withColumn("_nno", mine + 1 + (mine + 1 >= F.col("_own")).cast("int"))
    foreign = groups.select(F.col("_g").alias("_og"), F.col("grp").alias("donor_grp"), F.col("_size").alias("_osize"))
    tries = tries.join(foreign, "_og").withColumn("_fno", draw(F.col("_osize"), "foreign") + 1)
    d = donors.join(donor_edges, "sample_id")
    cross = d.select(F.col("grp").alias("donor_grp"), F.col("_no").alias("_fno"), F.col("sample_id").alias("cross_id"), F.col("head").alias("_ch"), F.col("tail").alias("_ct"))
    same = d.select("grp", F.col("_no").alias("_nno"), F.col("sample_id").alias("same_id"), F.col("head").alias("_sh"), F.col("tail").alias("_st"))
    left = host_edges.select("sample_id", F.col("pos").alias("start"), F.col("before").alias("_hb"))
    right = host_edges.select("sample_id", F.col("pos").alias("_end"), F.col("after").alias("_ha"))
    t = tries.withColumn("_end", F.col("start") + length).join(cross, ["donor_grp", "_fno"]).join(same, ["grp", "_nno"])
    t = t.join(left, ["sample_id", "start"], "left").join(right, ["sample_id", "_end"], "left")

    def seam(head: str, tail: str) -> Column:
        a = F.when(F.col("start") > 0, F.abs(F.coalesce("_hb", F.lit(0.0)) - F.col(head)))
        b = F.when(F.col("_end") < F.col("n"), F.abs(F.coalesce("_ha", F.lit(0.0)) - F.col(tail)))
        return F.coalesce(F.greatest(a, b), F.lit(0.0))

    t = t.withColumn("cross_seam", seam("_ch", "_ct")).withColumn("same_seam", seam("_sh", "_st"))
    fit = t.filter((F.col("cross_seam") <= max_seam) & (F.col("same_seam") <= max_seam))
    cols = ["attempt", "start", "cross_id", "same_id", "cross_seam", "same_seam"]
    pairs = fit.groupBy("sample_id", "grp").agg(F.min(F.struct(*cols)).alias("_b")).select("sample_id", "grp", *[F.col(f"_b.{c}").alias(c) for c in cols])
    reason = F.when(F.col("n") < 3 * length, "host_too_short").otherwise("no_pair_within_seam_limit")
    rejected = samples.join(pairs.select("sample_id"), "sample_id", "left_anti").select("sample_id", "grp", reason.alias("reason"))
    return pairs, rejected


def pair_representations(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Match two renderings of one set; one row per key with its first mismatch.

    Both sides carry (key, label, split).
    """
    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    reason = (
        F.when(F.col(f"r.{key}").isNull(), "only_left").when(F.col(f"l.{key}").isNull(), "only_right")
        .when(~F.col("l.label").eqNullSafe(F.col("r.label")), "label_mismatch")
        .when(~F.col("l.split").eqNullSafe(F.col("r.split")), "split_mismatch").otherwise("matched")
    )
    return j.select(
        F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), reason.alias("status"),
        F.col("l.label").alias("left_label"), F.col("r.label").alias("right_label"),
        F.col("l.split").alias("left_split"), F.col("r.split").alias("right_split"),
    )
