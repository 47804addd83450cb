"""Coordinate mapping between a source space and a target space.

A layout is one row per sample: sizes plus an array of regions. The format allows at
most 96 regions, so the array stays small and a coordinate is resolved on its own row by a
kernel that works off a batch at once. Points and intervals meet their layout by one equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import layout_kernels
from spanframe.operators.intervals import normalize

MAX_REGIONS = 96
OK_STATUSES = ("ok", "headers")


def is_ok(status: Column) -> Column:
    return status.isin(*OK_STATUSES)


def build_layouts(sizes: DataFrame, regions: DataFrame) -> DataFrame:
    """sizes: sample_id, file_size, header_len, overlay_offset, cert_lo, cert_hi (null = none);
    regions: sample_id, idx, raw_lo, raw_size, rva, vsize.
    """
    raw = (F.col("raw_size") > 0) & (F.col("raw_lo") > 0)
    shaped = regions.withColumn("mapped", F.when(raw, F.greatest(F.lit(0), F.least("raw_size", "vsize"))).otherwise(0))
    cells = [F.col(c).cast("bigint").alias(c) for c in ("idx", "raw_lo", "raw_size", "rva", "vsize", "mapped")]
    arrays = shaped.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("regions"))
    return sizes.join(arrays, "sample_id", "left").withColumn(
        "regions", F.coalesce("regions", F.array().cast("array<struct<idx:bigint,raw_lo:bigint,raw_size:bigint,rva:bigint,vsize:bigint,mapped:bigint>>"))
    )


def _has_raw(r: Column) -> Column:
    return (r["raw_size"] > 0) & (r["raw_lo"] > 0)


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so later steps reuse the value instead of its expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _unfolded(df: DataFrame, keep: list[str], kernel: Column) -> DataFrame:
    """The rows of the structs that a kernel gives, at least one. It has a projection of its own: called inside
    the generator it may cost other columns. The outer form infers no filter, which would call it twice."""
    return df.withColumn("_found", kernel).select(*keep, F.inline_outer("_found"))


def _resolve(df: DataFrame, pos: str, direction: str) -> DataFrame:
    """Adds ``status`` and ``value``; an answer holds only if the way back returns the same point."""
    return _unfolded(df, df.columns, F.array(layout_kernels.points(direction, F.col(pos))))


LAYOUT_COLS = layout_kernels.LAYOUT


def map_points(points: DataFrame, layouts: DataFrame, direction: str = "offset", pos: str = "pos") -> DataFrame:
    """Status and mapped coordinate per point; ``direction`` names the space of ``pos``."""
    j = points.join(layouts.select("sample_id", *LAYOUT_COLS), "sample_id")
    return _resolve(j, pos, direction).select(*points.columns, "status", "value")


def map_addresses(points: DataFrame, layouts: DataFrame, pos: str = "va") -> DataFrame:
    """Absolute addresses to source offsets; below the image base nothing is mapped."""
    j = points.join(layouts.select("sample_id", "image_base", *LAYOUT_COLS), "sample_id")
    below = F.col(pos) < F.col("image_base")
    rel = j.withColumn("_rva", F.when(below, None).otherwise((F.col(pos) - F.col("image_base")).cast("bigint")))
    out = _resolve(rel, "_rva", "rva")
    return out.select(
        *points.columns, F.when(below, "unmapped").otherwise(F.col("status")).alias("status"), F.when(~below, F.col("value")).alias("value")
    )


def map_intervals(iv: DataFrame, layouts: DataFrame, direction: str = "offset") -> DataFrame:
    """Segments of each interval, cut at the boundaries of both spaces; failures are kept.

    iv: sample_id, component_id, lo, hi. Every piece is homogeneous, so its first point decides it.
    """
    j = iv.filter("hi > lo").join(layouts.select("sample_id", *LAYOUT_COLS), "sample_id")
    found = _unfolded(j, iv.columns, layout_kernels.pieces(direction))
    size = F.col("src_hi") - F.col("src_lo")
    return found.select(*iv.columns, "src_lo", "src_hi", "status", F.col("value").alias("dst_lo"), (F.col("value") + size).alias("dst_hi"))


def component_rollup(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged target intervals per component, per-component mapped and unmapped length)."""
    ok = is_ok(F.col("status"))
    key = ["sample_id", "component_id"]
    merged = normalize(segments.filter(ok).select(*key, F.col("dst_lo").alias("lo"), F.col("dst_hi").alias("hi")), key)
    size = F.col("src_hi") - F.col("src_lo")
    facts = segments.groupBy(*key).agg(
        F.sum(size).alias("source_length"), F.sum(F.when(ok, 0).otherwise(size)).alias("unmapped_length"), F.bool_and(ok).alias("fully_mapped")
    )
    return merged, facts


def coverage_histogram(segments: DataFrame) -> DataFrame:
    """Bytes per sample and status."""
    return segments.groupBy("sample_id", "status").agg(F.sum(F.col("src_hi") - F.col("src_lo")).alias("n_bytes"))


def coverage_facts(segments: DataFrame, layouts: DataFrame, dominant: float = 0.5) -> DataFrame:
    """Mapped share, overlay bytes and share, and stratum per sample."""
    size = F.col("src_hi") - F.col("src_lo")
    cov = segments.groupBy("sample_id").agg(F.sum(size).alias("total_bytes"), F.sum(F.when(is_ok(F.col("status")), size).otherwise(0)).alias("ok_bytes"))
    return _shares(cov.join(layouts.select("sample_id", "file_size", "overlay_offset"), "sample_id"), [], dominant)


def _shares(df: DataFrame, carry: list[str], dominant: float) -> DataFrame:
    overlay = F.greatest(F.lit(0), F.col("file_size") - F.col("overlay_offset"))
    share = overlay / F.when(F.col("file_size") > 0, F.col("file_size"))
    return df.select(
        "sample_id", "total_bytes", "ok_bytes", (F.col("ok_bytes") / F.when(F.col("total_bytes") > 0, F.col("total_bytes"))).alias("coverage"),
        overlay.alias("overlay_bytes"), share.alias("overlay_share"), F.when(share > dominant, "overlay_dominant").otherwise("non_dominant").alias("stratum"), *carry,
    )


def whole_file_facts(layouts: DataFrame, dominant: float = 0.5) -> DataFrame:
    """``coverage_facts`` and ``round_trip_check`` of whole files, from one pass over the layouts: no segment leaves its row."""
    whole = layouts.filter("file_size > 0").withColumn("lo", F.lit(0)).withColumn("hi", F.col("file_size"))
    return _shares(_unfolded(whole, ["sample_id", "file_size", "overlay_offset"], F.array(layout_kernels.coverage())), ["points", "errors"], dominant)


def _sample_points(lo: str, hi: str) -> Column:
    a, b = F.col(lo), F.col(hi)
    return F.array_distinct(F.array(a, a + F.floor((b - a) / 2), b - 1))


def round_trip_check(segments: DataFrame, layouts: DataFrame) -> DataFrame:
    """Points and errors per sample: start, middle and end of each mapped segment must return."""
    j = segments.filter(is_ok(F.col("status"))).select("sample_id", "src_lo", "src_hi").join(layouts.select("sample_id", *LAYOUT_COLS), "sample_id")
    found = _unfolded(j, ["sample_id"], F.array(layout_kernels.round_trips()))
    return found.groupBy("sample_id").agg(F.sum("points").alias("points"), F.sum("errors").alias("errors"))


def pixel_round_trip(segments: DataFrame, layouts: DataFrame, strides: tuple[int, ...] = (3, 2)) -> DataFrame:
    """Offset to pixel and back for each stride; points and errors per sample."""
    own = segments.select("sample_id", F.explode(_sample_points("src_lo", "src_hi")).alias("pos"))
    ends = layouts.filter("file_size > 0").select("sample_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("file_size") - 1)).alias("pos"))
    pts = own.unionByName(ends).distinct().join(layouts.select("sample_id", "file_size"), "sample_id")
    pts = pts.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides])))
    pixel = F.floor(F.col("pos") / F.col("stride"))
    lo, hi = pixel * F.col("stride"), F.least((pixel + 1) * F.col("stride"), F.col("file_size"))
    good = (F.col("pos") >= lo) & (F.col("pos") < hi)
    return pts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(~good, F.lit(1))).alias("errors"))


def overlapping_regions(layouts: DataFrame) -> DataFrame:
    """Pairs of a sample's own regions that overlap in either space (at most 96 regions each)."""
    def clash(a: Column, b: Column) -> Column:
        raw = _has_raw(a) & _has_raw(b) & (a["raw_lo"] < b["raw_lo"] + b["raw_size"]) & (b["raw_lo"] < a["raw_lo"] + a["raw_size"])
        vir = (a["vsize"] > 0) & (b["vsize"] > 0) & (a["rva"] < b["rva"] + b["vsize"]) & (b["rva"] < a["rva"] + a["vsize"])
        return F.array_compact(F.array(F.when(raw, F.lit("raw")), F.when(vir, F.lit("virtual"))))

    pairs = F.flatten(F.transform("regions", lambda a: F.transform(
        F.filter("regions", lambda b: (b["idx"] > a["idx"]) & (F.size(clash(a, b)) > 0)),
        lambda b: F.struct(a["idx"].alias("a"), b["idx"].alias("b"), clash(a, b).alias("spaces")),
    )))
    return layouts.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.explode("p.spaces").alias("space"))


def component_spans(matches: DataFrame, layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence intervals in source space, counts) from function extents in target space.

    matches: sample_id, rule, lo, hi; a function found by several rules counts once.
    """
    distinct = matches.select("sample_id", "lo", "hi").distinct().withColumn("component_id", F.col("lo"))
    segs = map_intervals(distinct, layouts, "rva").filter(is_ok(F.col("status")))
    spans = normalize(segs.select("sample_id", F.col("dst_lo").alias("lo"), F.col("dst_hi").alias("hi")), ["sample_id"])
    counts = matches.groupBy("sample_id").agg(F.count_distinct(F.struct("lo", "hi")).alias("n_functions"), F.count_distinct("rule").alias("n_rules"))
    size = spans.groupBy("sample_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("mapped_bytes"))
    return spans, counts.join(size, "sample_id", "left").na.fill(0, ["mapped_bytes"])


def compare_layouts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Field-by-field and raw-set agreement of two parses; one row per sample.

    Both: sample_id, idx, rva, raw_lo, raw_size. A sample has at most 96 regions.
    """
    def packed(df: DataFrame, side: str) -> DataFrame:
        full = F.sort_array(F.collect_list(F.struct("idx", "rva", "raw_lo", "raw_size")))
        raw = F.sort_array(F.collect_set(F.when((F.col("raw_size") > 0) & (F.col("raw_lo") > 0), F.struct("raw_lo", "raw_size"))))
        return df.groupBy("sample_id").agg(full.alias(f"{side}_full"), raw.alias(f"{side}_raw"), F.count(F.lit(1)).alias(f"{side}_n"))

    j = packed(left, "l").join(packed(right, "r"), "sample_id", "full_outer")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["rva"], s["raw_lo"], s["raw_size"]))
    n_l, n_r = F.coalesce("l_n", F.lit(0)), F.coalesce("r_n", F.lit(0))
    differing = F.filter(F.arrays_zip(bare("l_full").alias("a"), bare("r_full").alias("b")), lambda z, i: z["a"] != z["b"])
    status = F.when(n_l != n_r, "section_count").when(F.size(differing) > 0, "section_fields").otherwise("ok")
    return j.select(
        "sample_id", n_l.alias("n_left"), n_r.alias("n_right"), status.alias("status"),
        F.coalesce(F.col("l_raw") == F.col("r_raw"), F.lit(False)).alias("raw_agreement"),
    )


def segment_alignment(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dump offset, range and alignment flags of named segments.

    segments: sample_id, name, lo, real; sizes: sample_id, base, n.
    """
    off = F.col("lo") - F.col("base")
    return segments.join(sizes, "sample_id").select(
        "sample_id", "name", "real", off.alias("dump_offset"), ((off >= 0) & (off < F.col("n"))).alias("in_range"),
        (off % 512 == 0).alias("aligned_512"), (off % 4096 == 0).alias("aligned_4096"),
    )


def alignment_verdict(rows: DataFrame) -> DataFrame:
    """Counts over real in-range segments and over the other labels."""
    real, other = F.col("real") & F.col("in_range"), ~F.col("real")
    n = lambda c: F.count(F.when(c, F.lit(1)))
    per = rows.groupBy("sample_id").agg(
        n(real).alias("a"), n(real & F.col("aligned_512")).alias("b"), n(real & F.col("aligned_4096")).alias("c"), n(other).alias("d"),
        n(other & F.col("aligned_512")).alias("e"), F.bool_or("in_range").alias("any"),
    )
    return per.agg(
        F.sum("a").alias("n_real"), F.sum("b").alias("real_aligned_512"), F.sum("c").alias("real_aligned_4096"),
        F.sum("d").alias("n_other"), F.sum("e").alias("other_aligned_512"), F.bool_and("any").alias("coordinates_match"),
    )


# ---------------------------------------------------------------- binary headers

# Header magics and field places of the executable format.
PE32, PE32_PLUS = 0x10B, 0x20B


def parse_layouts(df: DataFrame, content: str = "content") -> DataFrame:
    """Header fields and regions from binary content, or the reason it cannot be read.

    Fields are little-endian slices of the content column. df: sample_id, content.
    """
    def le(at: Column, width: int) -> Column:
        return F.conv(_swap(F.hex(F.col(content).substr((at + 1).cast("int"), F.lit(width))), width), 16, 10).cast("decimal(20,0)")

    i = lambda at, w: le(at, w).cast("bigint")
    size, lf, opt, end, dirs = (F.col(c) for c in ("file_size", "_lf", "_opt", "_end", "_dirs"))
    # Each stage sits behind a generator, so a later field reads the earlier value, not its expression.
    step = _once(df.select("sample_id", content), file_size=F.length(content).cast("bigint"), _mz=F.hex(F.col(content).substr(1, 2)))
    step = _once(step, _lf=F.when((size >= 0x40) & (F.col("_mz") == "4D5A"), i(F.lit(0x3C), 4)))
    step = _once(step, _opt=lf + 24, _sig=F.when(lf + 24 <= size, F.hex(F.col(content).substr((lf + 1).cast("int"), F.lit(4)))))
    good = F.col("_sig") == "50450000"
    step = _once(step, n_sections=F.when(good, i(lf + 6, 2)), _opt_size=F.when(good, i(lf + 20, 2)))
    step = _once(step, _end=opt + F.col("_opt_size"))
    step = _once(step, _magic=F.when(good & (F.col("_opt_size") >= 2) & (end <= size), i(opt, 2)))
    plus, known = F.col("_magic") == PE32_PLUS, F.col("_magic").isin(PE32, PE32_PLUS)
    step = _once(step, _dirs=F.when(known, opt + F.when(plus, 112).otherwise(96)))
    fits = dirs <= end
    step = _once(
        step, _ndirs=F.when(fits, i(dirs - 4, 4)), image_base=F.when(fits, F.when(plus, le(opt + 24, 8)).otherwise(le(opt + 28, 4))),
        section_alignment=F.when(fits, i(opt + 32, 4)), file_alignment=F.when(fits, i(opt + 36, 4)), header_len=F.when(fits, i(opt + 60, 4)),
    )
    reason = (
        F.when(size < 0x40, "file too small").when(F.col("_mz") != "4D5A", "missing first signature").when(lf + 24 > size, "header past end of file")
        .when(~good, "missing second signature").when(F.col("n_sections") > MAX_REGIONS, "too many sections")
        .when((F.col("_opt_size") < 2) | (end > size), "optional header truncated").when(~known, "unknown magic")
        .when(dirs > end, "optional header too small").when(dirs + F.col("_ndirs") * 8 > end, "data directories exceed header")
        .when(end + F.col("n_sections") * 40 > size, "section table truncated")
    )
    step = _once(step, error=reason)
    ok = F.col("error").isNull()
    step = _once(step, _clo=F.when(ok & (F.col("_ndirs") > 4), i(dirs + 32, 4)), _cn=F.when(ok & (F.col("_ndirs") > 4), i(dirs + 36, 4)))
    has_cert = (F.col("_clo") > 0) & (F.col("_cn") > 0)

    def fields(k: Column) -> Column:
        at = end + k * 40
        name = F.regexp_replace(F.decode(F.col(content).substr((at + 1).cast("int"), F.lit(8)), "ISO-8859-1"), "\\x00.*$", "")
        vsize, rva, rsize, rlo = (i(at + o, 4) for o in (8, 12, 16, 20))
        return F.struct(k.alias("idx"), rlo.alias("raw_lo"), rsize.alias("raw_size"), rva.alias("rva"), vsize.alias("vsize"), name.alias("name"))

    indexes = F.when(ok & (F.col("n_sections") > 0), F.sequence(F.lit(0).cast("bigint"), F.col("n_sections") - 1)).otherwise(F.array().cast("array<bigint>"))
    step = _once(step, _raw=F.transform(indexes, fields))
    mapped = lambda r: F.when(_has_raw(r), F.least(r["raw_size"], r["vsize"])).otherwise(F.lit(0).cast("bigint"))
    step = _once(step, regions=F.transform("_raw", lambda r: F.struct(
        r["idx"].alias("idx"), r["raw_lo"].alias("raw_lo"), r["raw_size"].alias("raw_size"), r["rva"].alias("rva"), r["vsize"].alias("vsize"), mapped(r).alias("mapped"), r["name"].alias("name"))))
    raw_end = F.aggregate(
        "regions", F.col("header_len"), lambda m, r: F.when(_has_raw(r), F.greatest(m, F.least(r["raw_lo"] + r["raw_size"], F.col("file_size")))).otherwise(m),
    )
    return step.select(
        "sample_id", "file_size", F.when(ok, plus).alias("is_plus"), "image_base", "section_alignment", "file_alignment", "header_len", "n_sections", "regions",
        F.when(ok, F.least(raw_end, size)).alias("overlay_offset"), F.when(has_cert, F.col("_clo")).alias("cert_lo"), F.when(has_cert, F.col("_clo") + F.col("_cn")).alias("cert_hi"), "error",
    )


def _swap(hex_col: Column, width: int) -> Column:
    return F.concat(*[F.substring(hex_col, 2 * (width - 1 - j) + 1, 2) for j in range(width)])


def truncated_regions(layouts: DataFrame) -> DataFrame:
    """Regions whose raw data runs past the end of the file."""
    r = layouts.select("sample_id", "file_size", F.explode("regions").alias("r")).filter(_has_raw(F.col("r")) & (F.col("r.raw_lo") + F.col("r.raw_size") > F.col("file_size")))
    return r.select("sample_id", F.col("r.idx").alias("idx"))
