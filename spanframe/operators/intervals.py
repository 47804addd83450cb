"""Half-open interval algebra on long tables ``(key..., lo, hi)``.

Everything rests on one sweep. Positions are cut into fixed-width buckets, each
interval becomes a +1/-1 event pair per bucket it touches, events are summed per
position (combined before the shuffle), and a running sum yields elementary
segments with the depth of each set. A window group therefore holds at most
``width`` positions however many intervals one key owns. Results are merged
inside the bucket, and only the pieces that touch a bucket edge are merged again
per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _bucket(c: Column, width: int) -> Column:
    """Floor of a whole-number division; doubles are inexact above 2^53."""
    return _floor_div(c, width)


def _floor_div(c: Column, width: int) -> Column:
    c = c.cast("bigint")
    return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))


def cut_to_buckets(iv: DataFrame, keys: list[str], carry: list[str] = (), width: int = WIDTH) -> DataFrame:
    """Pieces of each interval, one per bucket; empty intervals vanish."""
    lo, hi = F.col("lo").cast("bigint"), F.col("hi").cast("bigint")
    pieces = iv.filter(F.col("hi") > F.col("lo")).select(
        *keys, *carry, lo.alias("lo"), hi.alias("hi"),
        F.explode(F.sequence(_bucket(lo, width), _bucket(hi - 1, width))).alias("bucket"),
    )
    return pieces.select(
        *keys, *carry, "bucket",
        F.greatest("lo", F.col("bucket") * width).alias("lo"),
        F.least("hi", (F.col("bucket") + 1) * width).alias("hi"),
    )


def sweep(sets: dict[str, DataFrame], keys: list[str], width: int = WIDTH) -> DataFrame:
    """Elementary segments ``(keys, bucket, lo, hi, depth_<name>...)`` with positive total depth."""
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(*keys, "lo", "hi", F.lit(name).alias("_set")) for name, df in sets.items()],
    )
    return _sweep_pieces(cut_to_buckets(tagged, keys, ["_set"], width), list(sets), keys)


def _sweep_pieces(pieces: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The segments of pieces that lie in their bucket; ``_set`` names the set of each."""
    events = pieces.select(
        *keys, "bucket", "_set",
        F.explode(F.array(
            F.struct(F.col("lo").alias("pos"), F.lit(1).alias("d")),
            F.struct(F.col("hi").alias("pos"), F.lit(-1).alias("d")),
        )).alias("e"),
    )
    steps = events.groupBy(*keys, "bucket", F.col("e.pos").alias("pos")).agg(
        *[F.sum(F.when(F.col("_set") == n, F.col("e.d")).otherwise(0)).alias(f"d_{n}") for n in names]
    )
    w = Window.partitionBy(*keys, "bucket").orderBy("pos")
    segs = steps.select(
        *keys, "bucket", F.col("pos").alias("lo"), F.lead("pos").over(w).alias("hi"),
        *[F.sum(f"d_{n}").over(w).alias(f"depth_{n}") for n in names],
    )
    alive = reduce(lambda a, b: a | b, [F.col(f"depth_{n}") > 0 for n in names])
    return segs.filter(F.col("hi").isNotNull() & alive)


def merge_touching(df: DataFrame, group: list[str], carry_group: list[str] = ()) -> DataFrame:
    """Merge sorted, non-overlapping pieces that touch, inside each group."""
    w = Window.partitionBy(*group, *carry_group).orderBy("lo")
    start = F.coalesce((F.lag("hi").over(w) < F.col("lo")).cast("int"), F.lit(1))
    marked = df.withColumn("_new", start).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*group, *carry_group, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def collect_islands(segs: DataFrame, keys: list[str], condition: Column, width: int = WIDTH) -> DataFrame:
    """Canonical intervals of the segments that meet ``condition``."""
    inside = merge_touching(segs.filter(condition).select(*keys, "bucket", "lo", "hi"), keys + ["bucket"])
    at_edge = (F.pmod("lo", F.lit(width)) == 0) | (F.pmod("hi", F.lit(width)) == 0)
    # Pieces away from a bucket edge are final; they keep their bucket as a group of their own.
    routed = inside.withColumn("_route", F.when(at_edge, F.lit(None).cast("bigint")).otherwise(F.col("bucket"))).drop("bucket")
    return merge_touching(routed, keys, ["_route"]).select(*keys, "lo", "hi")


def normalize(iv: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Sorted, disjoint intervals; overlapping and touching ones are merged."""
    return collect_islands(sweep({"a": iv}, keys, width), keys, F.col("depth_a") > 0, width)


def normalize_pieces(pieces: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``normalize`` of intervals that each lie in their ``bucket``; a partitioning on keys and bucket is kept."""
    return collect_islands(_sweep_pieces(pieces.withColumn("_set", F.lit("a")), ["a"], keys), keys, F.col("depth_a") > 0, width)


def merge_bounded(iv: DataFrame, keys: list[str]) -> DataFrame:
    """``normalize`` in one window per key.

    Only for groups bounded by construction, such as the spans of one content row:
    it keeps a partitioning on the keys, so the steps around it need no shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((before < F.col("lo")).cast("int"), F.lit(1))
    marked = iv.filter(F.col("hi") > F.col("lo")).select(*keys, "lo", "hi").withColumn("_new", fresh)
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def union(a: DataFrame, b: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    return normalize(a.select(*keys, "lo", "hi").unionByName(b.select(*keys, "lo", "hi")), keys, width)


def intersect(a: DataFrame, b: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    return collect_islands(sweep({"a": a, "b": b}, keys, width), keys, (F.col("depth_a") > 0) & (F.col("depth_b") > 0), width)


def difference(a: DataFrame, b: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    return collect_islands(sweep({"a": a, "b": b}, keys, width), keys, (F.col("depth_a") > 0) & (F.col("depth_b") == 0), width)


def clamp(iv: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Cut to a window; an empty cut gives no row."""
    cut = iv.withColumn("lo", F.greatest(F.col("lo"), lo)).withColumn("hi", F.least(F.col("hi"), hi))
    return cut.filter(F.col("hi") > F.col("lo"))


def overlap_sums(a: DataFrame, b: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``inter_len`` and ``union_len`` per key that has any interval."""
    size = F.col("hi") - F.col("lo")
    both = (F.col("depth_a") > 0) & (F.col("depth_b") > 0)
    return sweep({"a": a, "b": b}, keys, width).groupBy(*keys).agg(
        F.sum(F.when(both, size).otherwise(0)).alias("inter_len"), F.sum(size).alias("union_len")
    )


def _ratio(a, b, keys, universe, empty_value: float, name: str, width: int) -> DataFrame:
    sums = overlap_sums(a, b, keys, width)
    if universe is not None:
        sums = universe.select(*keys).distinct().join(sums, keys, "left")
    inter, uni = F.coalesce("inter_len", F.lit(0)), F.coalesce("union_len", F.lit(0))
    return sums.select(
        *keys, inter.alias("inter_len"), uni.alias("union_len"), (inter > 0).alias("overlaps"),
        F.when(uni == 0, F.lit(empty_value)).otherwise(inter / F.greatest(uni, F.lit(1))).alias(name),
    )


def jaccard(a, b, keys, universe: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Intersection over union; two empty sets are identical, hence 1.0."""
    return _ratio(a, b, keys, universe, 1.0, "jaccard", width)


def byte_iou(pred, truth, keys, universe: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Intersection over union of a prediction; two empty sets score 0.0."""
    return _ratio(pred, truth, keys, universe, 0.0, "byte_iou", width)


def total_length(iv: DataFrame, keys: list[str]) -> DataFrame:
    """Interval count, summed length and hull of canonical intervals."""
    return iv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("total_len"),
        F.min("lo").alias("span_lo"), F.max("hi").alias("span_hi"),
    )


def points_in(points: DataFrame, iv: DataFrame, keys: list[str], pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Flag each point ``inside`` a canonical interval set (half-open).

    Distinct positions are looked up by carrying the last interval end forward
    inside a bucket, then joined back to the points.
    """
    starts = cut_to_buckets(iv, keys, [], width).select(*keys, "bucket", F.col("lo").alias("_p"), F.col("hi").alias("_end"))
    spots = points.select(*keys, F.col(pos).cast("bigint").alias("_p")).distinct()
    spots = spots.select(*keys, _bucket(F.col("_p"), width).alias("bucket"), "_p", F.lit(None).cast("bigint").alias("_end"))
    w = Window.partitionBy(*keys, "bucket").orderBy("_p").rangeBetween(Window.unboundedPreceding, 0)
    marks = starts.unionByName(spots.withColumn("_q", F.lit(True)), allowMissingColumns=True).withColumn(
        "_cover", F.max("_end").over(w)
    )
    found = marks.filter("_q").select(*keys, F.col("_p").alias(pos), F.coalesce(F.col("_cover") > F.col("_p"), F.lit(False)).alias("inside"))
    return points.join(found, keys + [pos])


def to_positions(iv: DataFrame, keys: list[str], limit: Column | None = None) -> DataFrame:
    """Covered positions of canonical intervals; positions outside ``[0, limit)`` are dropped."""
    lo = F.greatest(F.col("lo"), F.lit(0))
    hi = F.col("hi") if limit is None else F.least(F.col("hi"), limit)
    return iv.filter(hi > lo).select(*keys, F.explode(F.sequence(lo, hi - 1)).alias("pos"))


def from_positions(df: DataFrame, keys: list[str], pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Runs of consecutive positions as intervals."""
    return normalize(df.select(*keys, F.col(pos).cast("bigint").alias("lo"), (F.col(pos) + 1).cast("bigint").alias("hi")), keys, width)


def tile_rows(samples: DataFrame, size: int, n_col: str = "n_units", at_least_one: bool = True, name: str = "tile") -> DataFrame:
    """Fixed-size tiles ``[i*size, min((i+1)*size, n))`` of each sample."""
    n_tiles = F.ceil(F.col(n_col) / F.lit(float(size))).cast("bigint")
    n_tiles = F.greatest(F.lit(1).cast("bigint"), n_tiles) if at_least_one else n_tiles
    out = samples.withColumn("_n", n_tiles).filter(F.col("_n") > 0).withColumn(
        name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    )
    return out.withColumn("lo", F.col(name) * size).withColumn("hi", F.least((F.col(name) + 1) * size, F.col(n_col))).drop("_n")


def tile_pieces(iv: DataFrame, keys: list[str], size: int, name: str = "tile") -> DataFrame:
    """One row per (interval, tile touched) with the bytes they share."""
    first, last = _floor_div(F.col("lo"), size), _floor_div(F.col("hi") - 1, size)
    exploded = iv.filter(F.col("hi") > F.col("lo")).withColumn(name, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    share = F.least(F.col("hi"), (F.col(name) + 1) * size) - F.greatest(F.col("lo"), F.col(name) * size)
    return exploded.withColumn("n_bytes", share)


def tiles_touched(iv: DataFrame, keys: list[str], size: int) -> DataFrame:
    return tile_pieces(iv, keys, size).select(*keys, "tile").distinct()


def tile_overlap(iv: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Evidence bytes and intervals per tile; un-merged overlaps count twice."""
    return tile_pieces(iv, keys, size).groupBy(*keys, "tile").agg(
        F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_intervals")
    )


def merge_blocks(selected: DataFrame, keys: list[str], size: int, n_col: str = "n_units", block: str = "tile") -> DataFrame:
    """Byte ranges of the chosen blocks; neighbours are merged."""
    iv = selected.select(
        *keys, (F.col(block) * size).alias("lo"), F.least((F.col(block) + 1) * size, F.col(n_col)).alias("hi")
    )
    return normalize(iv, keys)
