"""Embedded executable headers in content that arrives in pieces.

A piece is read once, by the task that holds it. A header that lies in one piece with all
its fields is judged there; of one that reaches further only the missing fields are read,
by joining their few ranges with the pieces they fall in. Valid headers are then taken
from left to right, each after the end of the one before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.intervals import normalize
from spanframe.session import durable

# Fixed values of the file format.
MARK = b"MZ"
SIGNATURE = "50450000"  # hex of PE and two zero bytes
POINTER_AT = 0x3C  # where the offset of the second header stands, four bytes
FIELDS = 26  # bytes of the second header that are read: up to and with the optional magic
MAX_SECTIONS = 96
OPTIONAL_MAGICS = (0x10B, 0x20B)

SPAN_CAP = 65_536


def little_endian(data: Column, at: int, n: int) -> Column:
    """Unsigned number of ``n`` bytes of a binary column from 0-based ``at``; null where they are not all there."""
    digits = F.concat(*[F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(n))])
    return F.when(F.length(data) >= at + n, F.conv(digits, 16, 10).cast("bigint"))


def _marks(batches):
    """(sample_id, piece, at, content) -> places of the mark with as much of the pointer as the piece
    holds, and one row with the piece's ends."""
    for batch in batches:
        ids, pieces, lo, pointer = [], [], [], []
        for sid, piece, at, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            i = data.find(MARK)
            while i >= 0:
                ids.append(sid), pieces.append(piece), lo.append(at + i), pointer.append(data[i + POINTER_AT : i + POINTER_AT + 4])
                i = data.find(MARK, i + 2)
            if data[-1:] == MARK[:1]:  # the mark may end in the next piece
                ids.append(sid), pieces.append(piece), lo.append(at + len(data) - 1), pointer.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field(0).type), pa.array(lo, pa.int64()), pa.array(pointer, pa.binary())], names=["sample_id", "lo", "pointer"])


def read_ranges(pieces: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """``wanted`` (sample_id, at, n) with ``data``, the bytes of the range as far as they exist.

    ``pieces`` are (sample_id, piece, content) of ``size`` bytes each but the last of a
    sample. Pieces that no range touches are dropped before the join.
    """
    touched = wanted.distinct().withColumn("piece", F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + n - 1) div {size}"))))
    parts = touched.join(pieces.select("sample_id", F.col("piece").cast("bigint").alias("piece"), "content"), ["sample_id", "piece"])
    first = F.greatest(F.col("at") - F.col("piece") * size, F.lit(0))
    last = F.least(F.col("at") + F.col("n") - F.col("piece") * size, F.lit(size))
    cut = parts.select("sample_id", "at", "n", "piece", F.expr("content").substr((first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    joined = cut.groupBy("sample_id", "at", "n").agg(F.sort_array(F.collect_list(F.struct("piece", "part")))["part"].alias("parts"))
    return joined.select("sample_id", "at", "n", F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b)).alias("data"))


def leftmost_disjoint(spans: DataFrame, widest: int) -> DataFrame:
    """Spans that a scan from left to right takes: the first, then always the next one at or after its end.

    spans: sample_id, lo, hi, distinct ``lo`` per sample, none wider than ``widest``. Where
    spans overlap, the first of the island is taken for certain; its followers are found by
    pointer doubling, so a chain of n overlapping spans costs log n rounds and no group
    meets in one task: what follows a span in its island starts within ``widest`` of its end.
    """
    spans = durable(spans.select("sample_id", "lo", "hi"))
    heads = normalize(spans, ["sample_id"]).select("sample_id", "lo")
    taken = durable(spans.join(heads, ["sample_id", "lo"], "left_semi"))
    # per bucket, the first start at or after each end, else the first start of the next bucket
    at = lambda c: F.expr(f"{c} div {widest}")
    starts = spans.select("sample_id", at("lo").alias("b"), F.col("lo").alias("pos"), F.lit(1).alias("kind"), F.col("lo").alias("start"), F.lit(None).cast("bigint").alias("own"))
    ends = spans.select("sample_id", at("hi").alias("b"), F.col("hi").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("start"), F.col("lo").alias("own"))
    w = Window.partitionBy("sample_id", "b").orderBy("pos", "kind").rowsBetween(0, Window.unboundedFollowing)
    here = starts.unionByName(ends).withColumn("next", F.first("start", ignorenulls=True).over(w)).filter("kind = 0")
    firsts = starts.groupBy("sample_id", (F.col("b") - 1).alias("b")).agg(F.min("start").alias("later"))
    jump = here.join(firsts, ["sample_id", "b"], "left").select("sample_id", F.col("own").alias("lo"), F.coalesce("next", "later").alias("to")).filter("`to` is not null")
    # a head is taken in any case, so no jump needs to lead there
    jump = durable(jump.join(heads.withColumnRenamed("lo", "to"), ["sample_id", "to"], "left_anti").select("sample_id", "lo", "to"))
    found = taken.select("sample_id", "lo")
    while not jump.isEmpty():
        new = found.join(jump, ["sample_id", "lo"]).select("sample_id", F.col("to").alias("lo"))
        found = durable(found.unionByName(new).distinct())
        far = jump.select("sample_id", F.col("lo").alias("to"), F.col("to").alias("far"))
        jump = durable(jump.join(far, ["sample_id", "to"]).select("sample_id", "lo", F.col("far").alias("to")))
    return spans.join(found, ["sample_id", "lo"], "left_semi")


def scan_headers(pieces: DataFrame, size: int, span_cap: int = SPAN_CAP) -> DataFrame:
    """(sample_id, lo, hi): the header region of every executable embedded after offset 0.

    pieces: sample_id, piece (from 0), content of ``size`` bytes each but the last of a
    sample, as ``inflate_samples`` gives them. A mark counts with a whole pointer, the
    signature where it points, 1 to 96 sections and a known optional magic; the region ends
    with the section table, at most ``span_cap`` bytes on and inside the sample. A mark
    inside the region of a valid header before it is passed over. Samples without content
    give no rows; a null content counts as empty.
    """
    pieces = pieces.select("sample_id", F.col("piece").cast("bigint").alias("piece"), F.coalesce("content", F.lit(b"")).alias("content"))
    sid = dict(pieces.dtypes)["sample_id"]
    marks = pieces.select("sample_id", "piece", (F.col("piece") * size).alias("at"), "content").mapInArrow(_marks, f"sample_id {sid}, lo bigint, pointer binary").filter("lo > 0")
    marks = durable(marks)
    sizes = pieces.groupBy("sample_id").agg(F.sum(F.length("content")).cast("bigint").alias("total"))
    # what the piece does not hold: the mark's second byte, or the end of the pointer
    open_ = marks.filter("pointer is null or length(pointer) < 4").select("sample_id", F.col("lo").alias("at"), F.lit(POINTER_AT + 4).cast("bigint").alias("n"))
    late = read_ranges(pieces, size, open_).filter(F.col("data").startswith(F.lit(MARK)) & (F.length("data") == POINTER_AT + 4))
    known = marks.filter("length(pointer) = 4").select("sample_id", "lo", little_endian(F.col("pointer"), 0, 4).alias("jump"))
    known = known.unionByName(late.select("sample_id", F.col("at").alias("lo"), little_endian(F.col("data"), POINTER_AT, 4).alias("jump")))
    known = known.filter("jump > 0").join(sizes, "sample_id").filter(f"lo + {POINTER_AT + 4} <= total and lo + jump + {FIELDS} <= total")
    asked = known.select("sample_id", (F.col("lo") + F.col("jump")).alias("at"), F.lit(FIELDS).cast("bigint").alias("n"))
    fields = read_ranges(pieces, size, asked).select("sample_id", "at", "data")
    seen = known.withColumn("at", F.col("lo") + F.col("jump")).join(fields, ["sample_id", "at"])
    d = F.col("data")
    sections = little_endian(d, 6, 2)
    valid = seen.filter((F.hex(F.substring(d, 1, 4)) == SIGNATURE) & sections.between(1, MAX_SECTIONS) & little_endian(d, 24, 2).isin(*OPTIONAL_MAGICS))
    long = F.least(F.col("jump") + 24 + little_endian(d, 20, 2) + 40 * sections, F.lit(span_cap), F.col("total") - F.col("lo"))
    return leftmost_disjoint(valid.select("sample_id", "lo", (F.col("lo") + F.greatest(long, F.lit(1))).alias("hi")), span_cap)
