"""Best-two-fit packing of documents into sequences.

How many pieces there are of each length is all that packing depends on, so the plan is
made from a histogram of at most ``capacity`` rows and covers any number of documents:
one *run* is a bin pattern and how often it is repeated. A bin is filled greedily, the
largest piece that fits first; then its smallest piece is replaced by two unpacked ones
whenever some pair fits the expanded gap more tightly. A run repeats until one of its
lengths has too few pieces left for another bin, so there are at most capacity x
log2(capacity) runs, which bounds the broadcast plan. Pieces are numbered within their
length by two-level counting (length, hash bucket), so a length that a third of all
pieces share is spread over all tasks, and find their sequence and offset through the
plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.bytebpe import open_bpe
from spanframe.llm.registry import query, table
from spanframe.session import durable

CAPACITY = 1024
END_ID = 2
BUCKETS = 1024


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = end_id.to_bytes(4, "little")

    def run(batches):
        bpe = open_bpe(folder, literal=False)
        for b in batches:
            at, out = [], ([], [], [], [], [])
            for row, text in enumerate(b.column(1)):
                ids = bpe.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(row)
                    for column, v in zip(out, (k, start, length, zlib.crc32(part), part)):
                        column.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [b.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array(v, t) for v, t in zip(out[: 4 + with_ids], types)]
            yield pa.RecordBatch.from_arrays(columns, names=arrow_names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


class _Stock:
    """Pieces left per length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.count)

    def largest(self, limit: int) -> int:
        i = bisect_right(self.lengths, limit)
        return self.lengths[i - 1] if i else 0

    def add(self, length: int, n: int) -> None:
        left = self.count.get(length, 0) + n
        if left and length not in self.count:
            insort(self.lengths, length)
        if left:
            self.count[length] = left
        elif length in self.count:
            del self.count[length]
            self.lengths.remove(length)

    def best_pair(self, limit: int, over: int) -> tuple[int, int] | None:
        """Two pieces left with the largest sum in (over, limit]."""
        best, pair, lengths = over, None, self.lengths
        lo, hi = 0, bisect_right(lengths, limit) - 1
        while lo <= hi:
            a, b = lengths[lo], lengths[hi]
            if a + b > limit:
                hi -= 1
                continue
            if lo == hi and self.count[a] < 2:
                break
            if a + b > best:
                best, pair = a + b, (b, a)
                if best == limit:
                    break
            lo += 1
        return pair


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, repetitions)] by best-two-fit."""
    stock, runs = _Stock(counts), []
    while stock.lengths:
        bin_, gap = [], capacity
        while take := stock.largest(gap):
            bin_.append(take)
            stock.add(take, -1)
            gap -= take
        while gap and len(bin_) > 1 and (pair := stock.best_pair(bin_[-1] + gap, bin_[-1])):
            smallest = bin_.pop()
            gap += smallest - sum(pair)
            stock.add(smallest, 1)
            for x in pair:
                stock.add(x, -1)
            bin_ = sorted(bin_ + list(pair), reverse=True)
        uses = {x: bin_.count(x) for x in bin_}
        more = min(stock.count.get(x, 0) // n for x, n in uses.items())
        for x, n in uses.items():
            stock.add(x, -n * more)
        runs.append((bin_, more + 1))
    return runs


def plan_rows(runs: list[tuple[list[int], int]]) -> list[tuple]:
    """(length, first rank, end rank, first sequence, uses per bin, first offset) of each run and length."""
    rows, used, sequence = [], {}, 0
    for bin_, times in runs:
        offset = 0
        for x in sorted(set(bin_), reverse=True):
            n = bin_.count(x)
            lo = used.get(x, 0)
            used[x] = lo + n * times
            rows.append((x, lo, used[x], sequence, n, offset))
            offset += n * x
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to (id, piece, start, length, ids_crc32, ...).

    Every row gets a place; rows that are alike in all columns are interchangeable. Null
    ids are packed like others, an empty table gives no rows.
    """
    spark = pieces.sparkSession
    pieces = durable(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("piece lengths must be 1 to capacity")
    plan = spark.createDataFrame(
        plan_rows(plan_runs(counts, capacity)), "length bigint, lo bigint, hi bigint, first bigint, uses bigint, place bigint"
    )
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    cells = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("_r", F.row_number().over(inside) - 1).join(cells, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    placed = ranked.alias("r").join(
        F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi"))
    )
    turn = F.col("_r") - F.col("lo")
    return placed.select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("first") + F.expr("(_r - lo) div uses")).alias("sequence_id"),
        (F.col("place") + F.pmod(turn, F.col("uses")) * F.col("r.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its ids and ``end_id``; an empty or null text is the end id alone. Only
    documents over the capacity are cut. Extra columns are not read.
    """
    out = pack(token_pieces(docs, id_col, text_col, capacity, end_id, folder, with_ids), capacity)
    return out.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces with ids; a sequence holds at most `capacity` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))
