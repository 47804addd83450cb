"""Byte, pixel and rectangle arithmetic of row-major encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.intervals import _bucket, normalize, normalize_pieces

# Encodings whose pixels carry file bytes.
STRIDE_MODES = ("raw-rgb", "word16-rgb", "existing-image")
OPCODE_MODE = "opcode-3gram-rgb"
# Bytes of a bucket of rectangles: a few hundred rows of an image, so that an image spreads over tasks.
BOX_WIDTH = 1 << 18


def bytes_to_pixels(iv: DataFrame, enc: DataFrame) -> DataFrame:
    """Pixels that carry the bytes; partial pixels widen to whole ones. enc: sample_id, mode, stride, window, n_source, n_pixels."""
    j = iv.join(enc, "sample_id")
    lo, hi = F.greatest(F.lit(0), F.col("lo")), F.least(F.col("hi"), F.col("n_source"))
    strided = F.col("mode").isin(*STRIDE_MODES)
    p0 = F.when(strided, F.floor(lo / F.col("stride"))).when(F.col("mode") == OPCODE_MODE, F.greatest(F.lit(0), lo - F.col("window") + 1))
    p1 = F.when(strided, F.ceil(hi / F.col("stride"))).when(F.col("mode") == OPCODE_MODE, F.least(hi, F.col("n_pixels")))
    out = j.filter((lo < hi) & p0.isNotNull()).select("sample_id", p0.cast("bigint").alias("lo"), p1.cast("bigint").alias("hi"))
    return normalize(out, ["sample_id"])


def refused_modes(enc: DataFrame) -> DataFrame:
    """Encodings without a byte correspondence."""
    return enc.filter(~F.col("mode").isin(*STRIDE_MODES, OPCODE_MODE)).select("sample_id", "mode")


def pixels_to_bytes(px: DataFrame, enc: DataFrame) -> DataFrame:
    """Bytes of the pixels; padding pixels and channel padding are left out."""
    j = px.join(enc, "sample_id").filter(F.col("mode").isin(*STRIDE_MODES))
    lo, hi = F.greatest(F.lit(0), F.col("lo")), F.least(F.col("hi"), F.col("n_pixels"))
    b0, b1 = lo * F.col("stride"), F.least(hi * F.col("stride"), F.col("n_source"))
    out = j.filter((lo < hi) & (b0 < b1)).select("sample_id", b0.cast("bigint").alias("lo"), b1.cast("bigint").alias("hi"))
    return normalize(out, ["sample_id"])


def byte_to_pixel_channel(pos: Column, stride: Column) -> Column:
    return F.struct(F.floor(pos / stride).alias("pixel"), (pos % stride).alias("channel"))


def pixel_to_byte_span(pixel: Column, stride: Column, n_pixels: Column, n_source: Column) -> Column:
    """Byte span of one pixel; null for a padding pixel."""
    lo, hi = pixel * stride, F.least((pixel + 1) * stride, n_source)
    return F.when((pixel < n_pixels) & (lo < hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def interval_to_boxes(px: DataFrame, width: Column) -> DataFrame:
    """Exact rectangles of a row-major pixel interval: first part row, full rows, last part row."""
    p = px.withColumn("_w", width.cast("bigint"))
    w = F.col("_w")
    r0, c0 = F.floor(F.col("lo") / w), F.col("lo") % w
    r1, c1 = F.floor((F.col("hi") - 1) / w), (F.col("hi") - 1) % w
    box = lambda x, y, bw, bh: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), bw.cast("bigint").alias("w"), bh.cast("bigint").alias("h"))
    one, zero = F.lit(1), F.lit(0)
    top, bottom = r0 + (c0 > 0).cast("int"), r1 + 1 - (c1 != w - 1).cast("int")
    many = F.array_compact(F.array(
        F.when(c0 > 0, box(c0, r0, w - c0, one)), F.when(top < bottom, box(zero, top, w, bottom - top)), F.when(c1 != w - 1, box(zero, r1, c1 + 1, one))
    ))
    boxes = F.when(r0 == r1, F.array(box(c0, r0, c1 - c0 + 1, one))).otherwise(many)
    return p.withColumn("_b", F.explode(boxes)).select(*px.columns, "_b.x", "_b.y", "_b.w", "_b.h")


def interval_to_row_boxes(px: DataFrame, width: Column) -> DataFrame:
    """One rectangle per image row touched."""
    p = px.withColumn("_w", width.cast("bigint"))
    w = F.col("_w")
    rows = p.withColumn("y", F.explode(F.sequence(F.floor(F.col("lo") / w), F.floor((F.col("hi") - 1) / w))))
    a, b = F.greatest(F.col("lo"), F.col("y") * w), F.least(F.col("hi"), (F.col("y") + 1) * w)
    return rows.select(*px.columns, (a - F.col("y") * w).alias("x"), "y", (b - a).alias("w"), F.lit(1).cast("bigint").alias("h"))


def bbox_to_pixels(boxes: DataFrame, width: Column) -> DataFrame:
    """Row-by-row pixel intervals of rectangles. boxes: sample_id, x, y, w, h."""
    row = boxes.filter("w > 0 and h > 0").withColumn("_r", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    start = (F.col("_r") * width + F.col("x")).cast("bigint")
    return row.select("sample_id", start.alias("lo"), (start + F.col("w")).cast("bigint").alias("hi"))


def bbox_to_bytes(boxes: DataFrame, enc: DataFrame, width: int, parts: int | None = None) -> DataFrame:
    """``pixels_to_bytes`` of the rectangles' rows, at the exchange of one row per rectangle and bucket.

    Rectangles are dealt by sample and bucket over ``parts`` tasks; equal ones are one. Their rows, many
    times as many, are made and merged by the task that holds the bucket.
    """
    x, y, w, h, stride = (F.col(c) for c in ("x", "y", "w", "h", "stride"))
    last = y + h - 1

    def spot(row: Column) -> tuple[Column, Column]:
        """Bytes of a row of the rectangle; a missing ``x`` is the whole image."""
        start = (row * F.lit(width) + x).cast("bigint")
        lo, hi = F.greatest(F.lit(0), start), F.least((start + w).cast("bigint"), F.col("n_pixels"))
        return (lo * stride).cast("bigint"), F.least(hi * stride, F.col("n_source")).cast("bigint")

    used = enc.filter(F.col("mode").isin(*STRIDE_MODES)).select("sample_id", "stride", "n_pixels", "n_source")
    j = boxes.filter("w > 0 and h > 0 and y is not null").select("sample_id", "x", "y", "w", "h").join(used, "sample_id")
    # bytes rise from row to row, so the first and the last row bound all others
    j = j.withColumn("_b0", spot(y)[0]).withColumn("_b1", spot(last)[1]).filter("_b0 < _b1")
    j = j.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("_b0"), BOX_WIDTH), _bucket(F.col("_b1") - 1, BOX_WIDTH)))).drop("_b0", "_b1")
    j = j.repartition(parts, "sample_id", "bucket") if parts else j.repartition("sample_id", "bucket")
    j = j.distinct()
    # rows that may touch the bucket, one to spare on either side
    edge = F.col("bucket") * BOX_WIDTH
    pixel = lambda b: F.call_function("div", b, F.greatest(stride, F.lit(1)).cast("bigint"))
    row = lambda p: F.call_function("div", p.cast("bigint"), F.lit(width).cast("bigint"))
    first = F.greatest(y, F.coalesce(row(pixel(edge) - x - w) - 1, y))
    final = F.least(last, F.coalesce(row(pixel(edge + BOX_WIDTH) - x) + 1, last))
    rows = j.withColumn("_r0", first.cast("bigint")).withColumn("_r1", final.cast("bigint")).filter("_r0 <= _r1")
    rows = rows.withColumn("_r", F.explode(F.sequence("_r0", "_r1")))
    b0, b1 = spot(F.col("_r"))
    cut = rows.filter(b0 < b1).select("sample_id", "bucket", F.greatest(b0, edge).alias("lo"), F.least(b1, edge + BOX_WIDTH).alias("hi")).filter("lo < hi")
    return normalize_pieces(cut, ["sample_id"], BOX_WIDTH)


def mask_to_bytes(mask: DataFrame, enc: DataFrame) -> DataFrame:
    """mask: sample_id, pos of the selected pixels."""
    from spanframe.operators.intervals import from_positions

    return pixels_to_bytes(from_positions(mask, ["sample_id"]), enc)


def project_to_regions(boxes: DataFrame, enc: DataFrame, layouts: DataFrame, width: int) -> DataFrame:
    """Rectangles to bytes to region-classified segments."""
    from spanframe.operators.regions import map_intervals

    spans = pixels_to_bytes(bbox_to_pixels(boxes, F.lit(width)), enc)
    return map_intervals(spans.withColumn("component_id", F.col("lo")), layouts, "offset")
