"""Components of texts with similar word shingles, by an exact set-similarity join.

A text is the set of its shingles of ``words`` words; two texts link if the Jaccard
similarity of their sets reaches the threshold. No link is lost to sampling or sketches:

1. Shingles are ordered by rarity (counts of 2^20 slots over all rows, then the hash), and
   a text gives the rarest of its shingles that two similar texts cannot both lack.
2. Texts of one set collapse onto the first. Of the others, those that share a shingle of
   the prefixes meet under length and position filters, and are linked if their true
   sets, read from the texts again, reach the threshold.
3. Only components are wanted, so texts of a shingle first meet its most central member
   (the one with the fewest rarer shingles), one for each text and round; the last round
   compares all pairs of a shingle that are not yet in one component.

Sets hold 64-bit hashes of shingles. The input must give the same rows when read again.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.ranking import attach_group
from spanframe.llm.common import bounded_batches, may_match, written
from spanframe.operators.components import connected_components
from spanframe.session import durable

SLOT_BITS = 20
REST = np.uint64(64 - SLOT_BITS)
LOW = np.uint64((1 << (64 - SLOT_BITS)) - 1)
MEMO_WORDS = 100_000
BLOCK = 1 << 18
ROUNDS = 2
HOT = 2000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(k: np.ndarray, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    z = k + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, words: int, memo: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x2545F4914F6CDD1D) + h[k : len(h) - size + 1 + k]
    return np.unique(_mixed(total))


def slot_ranks(rows: DataFrame, words: int) -> np.ndarray:
    """Rank of each slot of shingles by the number of texts that hold one of them, counted over all rows.

    The ranks only order the shingles, which decides speed: the join is exact in any order.
    """

    def count(batches):
        total, memo, held, size = np.zeros(1 << SLOT_BITS, np.int64), _Words(), [np.zeros(0, np.uint64)], 0

        def pour():
            total[:] += np.bincount((np.concatenate(held) >> REST).astype(np.int64), minlength=len(total))

        for b in batches:
            for text in b.column(0):
                held.append(shingle_set(text.as_py(), words, memo))
                size += len(held[-1])
                if size > BLOCK:
                    pour()
                    held, size = [np.zeros(0, np.uint64)], 0
        pour()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    found = rows.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^20 rows
    n = np.zeros(1 << SLOT_BITS, np.int64)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    ranks = np.empty(len(n), np.int32)
    ranks[np.argsort(n, kind="stable")] = np.arange(len(n), dtype=np.int32)
    return ranks


def _parts(batches, rows: int = 1000):
    """Batches of fewer rows, so that their sets do not all wait in memory."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def signed_texts(rows: DataFrame, ranks: np.ndarray, words: int, t: Fraction) -> DataFrame:
    """(id, row, n, digest, prefix) of each row; the digest tells the set."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        memo = _Words()
        for b in _parts(batches):
            sizes, digests, prefixes = [], [], []
            for text in b.column(2):
                h = shingle_set(text.as_py(), words, memo)
                keys = np.sort((ranks[(h >> REST).astype(np.int64)].astype(np.uint64) << REST) | (h & LOW))
                n = len(keys)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                prefixes.append(keys[: n + (-n * t.numerator // t.denominator) + 1 if n else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["id", "row", "n", "digest", "prefix"])

    return rows.select("id", "row", "text").mapInArrow(run, f"id {kind}, row bigint, n int, digest binary, prefix array<bigint>")


def _may_link(nx: Column, px: Column, ny: Column, py: Column, t: Fraction) -> Column:
    """Length and position filters of two sets that share a shingle at these positions."""
    p, q = t.numerator, t.denominator
    fits = (ny * q >= nx * p) & (nx * q >= ny * p)
    return fits & (F.least(nx - px, ny - py) * (p + q) >= (nx + ny) * p)


def linked(rows: DataFrame, pairs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of rows whose true sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()

    def read(batches):
        memo = _Words()
        for b in _parts(batches):
            sets = [shingle_set(x.as_py(), words, memo).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "own"])

    sets = may_match(rows.select("row", "text"), "row", wanted, "row").select("row", "text").mapInArrow(read, "row bigint, own array<bigint>")
    sets = written(sets, "near-sets")

    def with_set(df: DataFrame, side: str) -> DataFrame:
        uses = df.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))
        facts = sets.withColumnRenamed("row", side).join(uses, side)
        return attach_group(df, facts.withColumnRenamed("own", f"own_{side}"), [side], "_n", HOT).drop("_n")

    # pair by pair in the JVM: two sets of very long texts never wait in a batch with others
    both = F.size(F.array_intersect("own_a", "own_b")) * (t.numerator + t.denominator)
    pairs = with_set(with_set(pairs, "a"), "b")
    return pairs.filter(both >= t.numerator * (F.size("own_a") + F.size("own_b"))).select("a", "b")


def similar_components(rows: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(row, low) of each row of (id, row, text): low is the smallest (id, row) of its component.

    Texts without words, null ones too, have equal sets and are one component."""
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    with bounded_batches(rows.sparkSession):
        return _components(rows.select("id", "row", F.col("text").cast("string").alias("text")), words, t)


def _components(rows: DataFrame, words: int, t: Fraction) -> DataFrame:
    signed = written(signed_texts(rows, slot_ranks(rows, words), words, t), "near-signed")
    place = F.struct("id", "row")
    # the aggregate carries no arrays; the prefix is that of the row which stands for its set
    nodes = written(signed.groupBy("digest").agg(F.min(place).alias("low")), "near-nodes")
    stands = nodes.select(F.col("low.row").alias("row"))
    entries = signed.select("row", "n", "prefix").join(stands, "row").select(F.col("row").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "near-shared")
    likely = may_match(entries, "token", shared, "token").select("token", "node", "n", "pos")
    met = written(attach_group(likely, shared, ["token"], "k", HOT), "near-met")
    labels, links, tested = None, None, None
    turns = ["central"] * ROUNDS + ["all"]
    while turns:
        turn = turns.pop(0)
        open_ = met if labels is None else met.join(labels, F.col("node") == F.col("id"), "left").drop("id")
        open_ = open_.withColumn("label", F.col("node") if labels is None else F.coalesce("component", "node")).drop("component")
        groups = open_.groupBy("token").agg(
            F.min(F.struct("pos", "node", "n", "label")).alias("hub"), (F.min("label") != F.max("label")).alias("_open"), F.count(F.lit(1)).alias("_n")
        ).filter("_open").drop("_open")
        left = attach_group(open_.drop("k"), groups, ["token"], "_n", HOT)
        if turn == "central":
            near = left.filter((F.col("label") != F.col("hub.label")) & _may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), t))
            pairs = near.groupBy("node").agg(F.min(F.struct("hub.pos", "hub.node")).alias("best")).select("node", F.col("best.node").alias("other"))
        else:
            x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
            left = written(left.drop("hub", "_n"), "near-left")
            on = (x("token") == y("token")) & (x("node") < y("node")) & (x("label") != y("label")) & _may_link(x("n"), x("pos"), y("n"), y("pos"), t)
            pairs = left.alias("x").join(left.alias("y"), on).select(x("node").alias("node"), y("node").alias("other"))
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = durable(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            turns = turns[-1:] if turn == "central" else []
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = durable(linked(rows, pairs, words, t))
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = durable(connected_components(links))
    firsts = nodes.select("digest", "low")
    if labels is not None:
        known = firsts.join(labels, F.col("low.row") == F.col("id"), "left").select("digest", "low", F.coalesce("component", "low.row").alias("component"))
        lowest = known.groupBy("component").agg(F.min("low").alias("_low"))
        firsts = known.join(lowest, "component").select("digest", F.col("_low").alias("low"))
    uses = signed.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
    return attach_group(signed.select("row", "digest"), firsts.join(uses, "digest"), ["digest"], "_n", HOT).select("row", "low")
