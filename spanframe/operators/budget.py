"""Spending a fixed review budget on tiles.

The ranked tables here hold the tiles of content rows, so one sample's group is
bounded by the size of one row value; ranks are plain windows keyed by sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.hashing import hash_hex

BUDGETS = (0.02, 0.05, 0.10, 0.20, 0.50)
TILE_UNITS = 49_152


def budget_size(n: Column, budget: float | Column) -> Column:
    """Tiles a budget buys: at least one, never more than all."""
    b = F.lit(float(budget)) if isinstance(budget, (int, float)) else budget
    return F.least(n, F.greatest(F.lit(1), F.ceil(b * n))).cast("bigint")


def rank_by(score: Column, key: str = "sample_id", idx: str = "tile") -> Column:
    """1-based rank by falling score, ties by lower index."""
    return F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), F.col(idx).asc())).cast("bigint")


def select_topk(scores: DataFrame, k: Column, score: str = "score", key: str = "sample_id", idx: str = "tile") -> DataFrame:
    return scores.withColumn("rank", rank_by(F.col(score), key, idx)).filter(F.col("rank") <= k)


def random_order(seed: str | int, key: str = "sample_id", idx: str = "tile") -> Column:
    """A total order that looks random: rank by rising hash."""
    h = hash_hex(seed, key, idx)
    return F.row_number().over(Window.partitionBy(key).orderBy(h.asc(), F.col(idx).asc())).cast("bigint")


def is_uniform(idx: Column, n: Column, k: Column) -> Column:
    """Is ``idx`` one of ``floor(j*n/k)``, j < k? Closed form, no list of picks."""
    n, k, idx = n.cast("bigint"), k.cast("bigint"), idx.cast("bigint")
    j = F.ceil(idx * k / n).cast("bigint")
    return (k >= n) | ((j < k) & (F.floor(j * n / k) == idx))


def uniform_rounded(n: Column, k: Column) -> Column:
    """Array of ``round(linspace(0, n-1, k))`` with repeats collapsed."""
    kk = F.least(k, n).cast("bigint")
    step = F.when(kk > 1, (n - 1) / F.greatest(kk - 1, F.lit(1))).otherwise(F.lit(0.0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), kk - 1), lambda j: F.bround(j * step).cast("bigint")))


SELECTORS = ("random", "uniform", "front_first", "back_first", "entropy", "entropy_boundary", "oracle")


def rank_selectors(tiles: DataFrame, seed: str | int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One rank column per ranking selector, all windows over one partitioning.

    ``tiles`` needs sample_id, tile, entropy, boundary, evidence and any extra score columns.
    """
    out = (
        tiles.withColumn("rank_random", random_order(seed))
        .withColumn("rank_entropy", rank_by(F.col("entropy")))
        .withColumn("rank_entropy_boundary", rank_by(F.col("boundary")))
        .withColumn("rank_oracle", rank_by(F.col("evidence").cast("double")))
    )
    for name in extra:
        out = out.withColumn(f"rank_{name}", rank_by(F.col(name)))
    return out


def is_chosen(selector: str, budget: float) -> Column:
    """Does ``selector`` pick the tile of a ranked row under ``budget``?"""
    n = F.col("n_tiles")
    k = budget_size(n, budget)
    if selector == "uniform":
        return is_uniform(F.col("tile"), n, k)
    if selector == "front_first":
        return F.col("tile") < k
    if selector == "back_first":
        return F.col("tile") >= n - k
    return F.col(f"rank_{selector}") <= k


def choices(ranked: DataFrame, budgets=BUDGETS, selectors=SELECTORS) -> DataFrame:
    """One row per (tile, selector, budget) that is selected; ranks are computed once."""
    cells = F.array(*[
        F.when(is_chosen(s, b), F.struct(F.lit(s).alias("selector"), F.lit(float(b)).alias("budget")))
        for s in selectors for b in budgets
    ])
    return ranked.withColumn("c", F.explode(F.array_compact(cells))).withColumn("selector", F.col("c.selector")).withColumn(
        "budget", F.col("c.budget")
    ).drop("c")


def evidence_tiles(tiles: DataFrame, intervals: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """Tiles with their evidence: bytes, the interval parts inside, and sample totals.

    Tile rows and interval parts travel through one exchange on the sample, after
    which every grouping and ranking of the evaluation is local. ``parts`` fixes the number
    of its partitions, for tables whose tiles hold far more memory than shuffle bytes.
    tiles: sample_id, tile, tile_len, entropy; intervals: canonical sample_id, lo, hi.
    """
    from spanframe.operators.intervals import tile_pieces

    cut = intervals.withColumn("interval_id", F.col("lo")).withColumn("length", F.col("hi") - F.col("lo"))
    pieces = tile_pieces(cut, ["sample_id"], size).select(
        "sample_id", "tile", F.struct("interval_id", "length", "n_bytes", (F.floor(F.col("interval_id") / size) == F.col("tile")).alias("first")).alias("part")
    )
    both = tiles.unionByName(pieces, allowMissingColumns=True)
    both = both.repartition(parts, "sample_id") if parts else both
    one = both.groupBy("sample_id", "tile").agg(
        F.max("tile_len").alias("tile_len"), F.max("entropy").alias("entropy"), F.collect_list("part").alias("parts")
    )
    whole = Window.partitionBy("sample_id")
    one = one.withColumn("evidence", F.aggregate("parts", F.lit(0).cast("bigint"), lambda t, p: t + p["n_bytes"]))
    return (
        one.withColumn("n_tiles", F.max("tile").over(whole) + 1)
        .withColumn("n_units", F.sum("tile_len").over(whole))
        .withColumn("evidence_bytes", F.sum("evidence").over(whole))
        .withColumn("n_intervals", F.sum(F.size(F.filter("parts", lambda p: p["first"]))).over(whole))
    )


def selection_metrics(selected: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, byte IoU, interval recall at one half, hit flag and k per selection.

    ``selected`` holds rows of ``evidence_tiles`` that a selection picked. Each row
    gives one record for the tile and one per interval part, so a first grouping sums
    the parts of an interval and a second one the sample, both on the same partitioning.
    """
    zero = F.lit(0).cast("bigint")
    own = F.struct(
        F.lit(None).cast("bigint").alias("interval_id"), zero.alias("length"), zero.alias("n_bytes"),
        F.col("tile_len").alias("len"), F.col("evidence").alias("got"), F.lit(1).cast("bigint").alias("k"),
    )
    inner = F.transform("parts", lambda p: F.struct(
        p["interval_id"].alias("interval_id"), p["length"].alias("length"), p["n_bytes"].alias("n_bytes"), zero.alias("len"), zero.alias("got"), zero.alias("k")
    ))
    rec = selected.select("sample_id", *by, "evidence_bytes", "n_intervals", F.explode(F.concat(F.array(own), inner)).alias("r"))
    per = rec.groupBy("sample_id", *by, F.col("r.interval_id").alias("interval_id")).agg(
        F.max("evidence_bytes").alias("_total"), F.max("n_intervals").alias("_n"), F.sum("r.n_bytes").alias("_o"), F.max("r.length").alias("_l"),
        F.sum("r.len").alias("_len"), F.sum("r.got").alias("_inter"), F.sum("r.k").alias("k"),
    )
    half = F.col("interval_id").isNotNull() & (F.col("_o") * 2 >= F.col("_l"))
    out = per.groupBy("sample_id", *by).agg(
        F.max("_total").alias("_total"), F.max("_n").alias("n_regions"), F.count(F.when(half, F.lit(1))).alias("_covered"),
        F.sum("_len").alias("_len"), F.sum("_inter").alias("_inter"), F.sum("k").alias("k"),
    )
    return _metrics(out, by)


def _metrics(out: DataFrame, by: list[str]) -> DataFrame:
    total, union = F.col("_total"), F.col("_len") + F.col("_total") - F.col("_inter")
    return out.select(
        "sample_id", *by,
        F.when(total > 0, F.col("_inter") / F.when(total > 0, total)).alias("coverage"),
        F.when(union > 0, F.col("_inter") / F.when(union > 0, union)).otherwise(0.0).alias("byte_iou"),
        F.when(F.col("n_regions") > 0, F.col("_covered") / F.when(F.col("n_regions") > 0, F.col("n_regions"))).alias("interval_recall_50"),
        (F.col("_inter") > 0).alias("evidence_hit"), "k", (total > 0).alias("has_evidence"), "n_regions",
    )


def grid_metrics(ranked: DataFrame, by: list[str], budgets=BUDGETS, selectors=SELECTORS) -> DataFrame:
    """``selection_metrics`` of all ``choices`` by (*by, selector, budget), without a row per choice.

    A tile carries one bit per (selector, budget) that picks it. It gives one record each for its
    length, its evidence and its count, and one per interval part; a group then holds one sum
    per bit, so the table stays as long as tiles and parts and is not multiplied by the grid.
    ``by`` names columns that are constant in a sample.
    """
    grid = [(s, float(b)) for s in selectors for b in budgets]
    if len(grid) > 63:
        raise ValueError("a grid holds at most 63 cells")
    zero = F.lit(0).cast("bigint")
    bits = F.lit(0).cast("bigint")
    for i, (s, b) in enumerate(grid):
        bits = bits.bitwiseOR(F.when(is_chosen(s, b), F.lit(1 << i).cast("bigint")).otherwise(zero))

    def record(what: str, interval: Column, length: Column, value: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), interval.alias("interval_id"), length.alias("length"), value.cast("bigint").alias("value"))

    none = F.lit(None).cast("bigint")
    own = F.array(
        record("len", none, zero, F.col("tile_len")), record("got", none, zero, F.col("evidence")), record("k", none, zero, F.lit(1)),
    )
    inner = F.transform("parts", lambda p: record("part", p["interval_id"], p["length"], p["n_bytes"]))
    rec = ranked.select("sample_id", *by, "evidence_bytes", "n_intervals", bits.alias("_bits"), F.explode(F.concat(own, inner)).alias("r"))
    per = rec.groupBy("sample_id", *by, F.col("r.what").alias("_what"), F.col("r.interval_id").alias("interval_id")).agg(
        F.max("evidence_bytes").alias("_total"), F.max("n_intervals").alias("_n"), F.max("r.length").alias("_l"),
        *[F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.col("r.value")).otherwise(zero)).alias(f"_s{i}") for i in range(len(grid))],
    )
    one = lambda what, i: F.max(F.when(F.col("_what") == what, F.col(f"_s{i}"))).alias(f"_{what}{i}")
    half = lambda i: (F.col("_what") == "part") & (F.col(f"_s{i}") > 0) & (F.col(f"_s{i}") * 2 >= F.col("_l"))
    wide = per.groupBy("sample_id", *by).agg(
        F.max("_total").alias("_total"), F.max("_n").alias("n_regions"),
        *[c for i in range(len(grid)) for c in (one("len", i), one("got", i), one("k", i), F.count(F.when(half(i), F.lit(1))).alias(f"_covered{i}"))],
    )
    cells = F.array(*[
        F.struct(
            F.lit(s).alias("selector"), F.lit(b).alias("budget"), F.col(f"_len{i}").alias("_len"), F.col(f"_got{i}").alias("_inter"),
            F.col(f"_k{i}").alias("k"), F.col(f"_covered{i}").alias("_covered"),
        )
        for i, (s, b) in enumerate(grid)
    ])
    out = wide.select("sample_id", *by, "_total", "n_regions", F.inline(cells)).filter("k > 0")
    return _metrics(out, [*by, "selector", "budget"])


def position_bin(idx: Column, n: Column, bins: int) -> Column:
    return F.least(F.floor((idx + 0.5) / n * bins), F.lit(bins - 1)).cast("bigint")


def fit_position_prior(tiles: DataFrame, bins: int = 20) -> DataFrame:
    """Mean evidence share per normalised position over samples with evidence; an unseen bin is 0.

    ``tiles``: sample_id, tile, n_tiles, evidence of the fitting split only.
    """
    total = F.sum("evidence").over(Window.partitionBy("sample_id"))
    share = tiles.withColumn("_t", total).filter("_t > 0").select(
        position_bin(F.col("tile"), F.col("n_tiles"), bins).alias("bin"), (F.col("evidence") / F.col("_t")).alias("_s")
    )
    fitted = share.groupBy("bin").agg(F.avg("_s").alias("density"))
    grid = tiles.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(fitted, "bin", "left").select("bin", F.coalesce("density", F.lit(0.0)).alias("density"))


def score_position(tiles: DataFrame, prior: DataFrame, bins: int = 20, name: str = "position_only") -> DataFrame:
    """The prior of each tile's position; the prior has ``bins`` rows."""
    return tiles.withColumn("bin", position_bin(F.col("tile"), F.col("n_tiles"), bins)).join(
        F.broadcast(prior.withColumnRenamed("density", name)), "bin"
    ).drop("bin")


def top_mean(df: DataFrame, key: list[str], value: str, fraction: float, tie: list[str]) -> DataFrame:
    """Mean of the top ``ceil(n*fraction)`` values per group."""
    w = Window.partitionBy(*key)
    ranked = df.withColumn("_n", F.count(value).over(w)).withColumn(
        "_r", F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), *tie))
    )
    top = ranked.filter(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction)))
    return top.groupBy(*key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("top_mean"))


def combine_scores(p: Column, e: Column, wp: float, we: float) -> Column:
    """Weighted mean clipped to [0, 1]; NaN counts as 0, infinity as 1."""
    if wp < 0 or we < 0 or wp + we <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    mixed = (p * wp + e * we) / (wp + we)
    return F.when(F.isnan(mixed), 0.0).otherwise(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)))


def binary_entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    h = -(q * F.log2(q) + (1 - q) * F.log2(1 - q))
    return F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))


def max_over_levels(df: DataFrame, key: list[str], score: str) -> DataFrame:
    """Largest score over classes and levels."""
    return df.groupBy(*key).agg(F.max(score).alias("probability"))


def normalize_scores(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Divide by the group's 99th percentile and clip to [0, 1]; a flat-zero group stays 0."""
    from spanframe.functions.ranking import linear_quantiles

    v = F.col(value)
    clean = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    base = df.withColumn("_v", clean)
    high = linear_quantiles(base, by, "_v", {"_p99": 0.99}).drop("n")
    joined = base.join(high, by) if by else base.join(F.broadcast(high))
    scaled = F.least(F.greatest(F.col("_v") / F.when(F.col("_p99") > 1e-8, F.col("_p99")), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn("normalized", F.coalesce(scaled, F.lit(0.0))).drop("_v", "_p99")


def routing_cost(n_tiles: Column, k: Column, router: str) -> Column:
    """Passes spent: probes plus a baseline, and a full coarse sweep for the coarse router."""
    probes = k + 1
    return probes + n_tiles + 1 if router == "coarse" else probes


def call_reduction(selected: Column, full: Column) -> Column:
    return 1.0 - selected / F.when(full != 0, full)
