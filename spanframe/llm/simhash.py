"""SimHash near-duplicates through pivot distance tables.

Fingerprints: a bit is 1 if it is set in over half of the hashes of a text's word
shingles. Two fingerprints link at ``radius`` or fewer differing bits; a component is
all that can be reached over links.

Links are found over the distinct fingerprints only:

1. The pivot table holds the Hamming distance of each fingerprint to 16 reference
   fingerprints, eight distances packed in a long. By the triangle inequality two
   fingerprints within the radius differ by at most the radius in every coordinate.
2. Fingerprints of random texts are spread evenly, so no set of pivots alone tells far
   pairs from near ones without comparing all (every pivot keeps over half of all
   pairs). Pairs to compare therefore come from equal bits: of seven blocks of bits,
   four differing bits leave three blocks equal, and each of the 35 choices of three
   blocks is a join key. This loses no link.
3. In the join condition, pairs whose largest coordinate difference exceeds the radius
   are discarded; survivors are verified bit by bit.

A key with over ``dense`` fingerprints (a crowd of near copies) is not paired. Its
members link through midpoints: two fingerprints differ by four or fewer bits exactly
if some value is two or fewer bits from both, so each member is sent to all values that
near, and members that meet there are linked to the smallest. That is linear in the
members and gives the same components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import bounded_batches, partitions, slot_marks
from spanframe.llm.near_copies import similar_components
from spanframe.llm.registry import query, table
from spanframe.operators.components import connected_components
from spanframe.session import durable

BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
PIVOTS = 16
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def pivot_values(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, fixed by their number, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}".encode())).astype(np.int64)) for i in range(n)]


def fingerprint(text: str | None, words: int = 4, step: int = 1 << 18) -> int:
    """Signed 64-bit fingerprint of a text; 0 without words. Hashes are taken ``step`` at a time."""
    data = b" ".join((text or "").encode().lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), step):
        pairs = zip(starts[i : i + step].tolist(), ends[i : i + step].tolist())
        # big-endian digests: byte 0 holds the top bits
        h = np.frombuffer(b"".join([digest(data[a:b], 42) for a, b in pairs]), np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * (7 - byte) : 8 * (8 - byte)] += np.bincount(h[:, byte], minlength=256) @ _BITS_OF_BYTE
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    """(id, fp) of every row; whole texts, null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the pivots, eight to a long."""
    d = [hamming(fp, F.lit(p)).cast("long") for p in pivot_values()]
    packed = []
    for k in range(0, PIVOTS, 8):
        word = d[k]
        for j in range(1, 8):
            word = word.bitwiseOR(F.shiftleft(d[k + j], 8 * j))
        packed.append(word.alias(f"p{k // 8}"))
    return packed


def within_pivots(radius: int) -> Column:
    """Is no coordinate of ``a`` and ``b`` further apart than the radius?"""
    ok = F.lit(True)
    for k in range(PIVOTS // 8):
        for j in range(8):
            lane = [F.shiftright(F.col(f"{s}.p{k}"), 8 * j).bitwiseAND(F.lit(255)) for s in "ab"]
            ok = ok & (F.abs(lane[0] - lane[1]) <= radius)
    return ok


def block_keys(fp: Column, radius: int) -> list[Column]:
    """One key per choice of the blocks that must agree within the radius."""
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in BLOCKS]
    keys = []
    for n, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i][1]).bitwiseOR(part[i])
        keys.append(key)
    return keys


def midpoint_masks(reach: int = 2) -> list[int]:
    masks = [sum(1 << i for i in bits) for n in range(reach + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 4, dense: int = 4096) -> DataFrame:
    """Links (a, b) between distinct values of ``fp``; same components as all links within the radius.

    Pairs of keys with up to ``dense`` members are all there; denser crowds are linked
    through midpoints (for a radius of four or less)."""
    if not 0 < radius <= 4:
        raise ValueError("radius must be 1 to 4")
    # an explicit number: each fingerprint makes 35 rows, too many for coalesced partitions
    nodes = prints.select("fp").repartition(partitions(prints.sparkSession), "fp").distinct()
    rows = nodes.select("fp", *pivot_table(F.col("fp")), F.explode(F.array(*block_keys(F.col("fp"), radius))).alias("key"))
    met = durable(rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1"))
    few = met.filter(F.col("n") <= dense)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & within_pivots(radius))
    near = pairs.filter(hamming(F.col("a.fp"), F.col("b.fp")) <= radius).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowd = met.filter(F.col("n") > dense).select("fp").distinct()
    half = radius // 2
    if radius % 2 == 0:
        spots = crowd.select("fp", F.explode(F.array(*[F.lit(m) for m in midpoint_masks(half)])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
        low = spots.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("z", "a")
        crowded = spots.join(low, "z").filter("fp <> a").select("a", F.col("fp").alias("b"))
    else:
        # an odd radius: one side reaches a bit further
        spots = crowd.select("fp", F.explode(F.array(*[F.lit(m) for m in midpoint_masks(half + 1)])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
        ends = crowd.select(F.col("fp").alias("other"), F.explode(F.array(*[F.lit(m) for m in midpoint_masks(half)])).alias("m")).select("other", F.col("other").bitwiseXOR(F.col("m")).alias("z"))
        crowded = spots.join(ends, "z").filter("fp < other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return near.unionByName(crowded).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, dense: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    The component is named by its smallest id. Null and empty texts have fingerprint zero,
    which links like any other. A null id belongs to its component but never names it
    unless all ids there are null; rows that repeat an id get a row each. An empty table
    gives no rows; other columns are not read, so their names do not matter.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    links = fingerprint_links(prints, radius, dense)
    comps = connected_components(links).withColumnRenamed("id", "fp")
    named = nodes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_print = named.select("fp", "component").join(low, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: the smallest by (id, place in the table).

    Rows link if the Jaccard similarity of their shingles reaches the threshold, by the exact
    join of ``near_copies``: fingerprints within a few bits miss most pairs near 0.8. A null id
    is the smallest; rows may repeat; all columns stay. The input must give the same rows
    when read again: a table or a checkpoint. Only rows that may go are shuffled.
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = placed.select(F.col(id_col).alias("id"), F.col("_row").alias("row"), F.col(text_col).alias("text"))
    found = similar_components(rows, words, threshold)
    return _without(docs, placed, found.filter(F.col("row") != F.col("low.row")).select(F.col("row").alias("_row")))


def without_simhash_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component of ``simhash_components``: the smallest by (id, place in the table).

    A null id is the smallest; rows may repeat; all columns stay. Null and empty texts are one
    component. The input must give the same rows when read again: a table or a checkpoint.
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    place = F.struct(F.col(id_col).alias("id"), F.when(F.col("_row") >= 0, F.col("_row")).alias("row"))
    with bounded_batches(docs.sparkSession):
        found = simhash_components(placed.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", words, radius)
        return _without(docs, placed, found.filter(F.col("place.row") != F.col("component_id.row")).select(F.col("place.row").alias("_row")))


def _without(docs: DataFrame, placed: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of ``docs`` in the rows of ``placed`` that ``gone`` does not name by ``_row``."""
    gone = durable(gone)
    marked = slot_marks(placed, "_row", gone, "_row")
    likely = marked.filter("_marked").join(gone, "_row", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return likely.select(*columns).unionByName(marked.filter("not _marked").select(*columns))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))
