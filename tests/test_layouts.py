"""Positions, segments and round trips of layouts against plain loops, on odd layouts."""

import random

from pyspark.sql import functions as F

from spanframe.operators import regions
from spanframe.plans import catalog

OK = ("ok", "headers")


def _samples():
    """Layouts with overlaps, gaps, regions without source bytes, missing sizes and certificates, and 96 regions."""
    rng = random.Random(3)
    out = []
    for s in range(60):
        n = 96 if s == 7 else rng.randrange(6)
        reg = [(k, rng.choice([0, rng.randrange(1, 40)]), rng.choice([0, rng.randrange(1, 20)]), rng.randrange(60), rng.choice([0, rng.randrange(1, 20)])) for k in range(n)]
        cert = rng.choice([(None, None), (30, 34)])
        out.append((s, rng.choice([None, 0, 45, 60]) if s % 5 else 50, rng.choice([None, 0, 4]) if s % 3 else 4, rng.choice([None, 20, 40]), *cert, reg))
    return out


def _layouts(spark, samples):
    sizes = spark.createDataFrame([x[:6] for x in samples], "sample_id long, file_size long, header_len long, overlay_offset long, cert_lo long, cert_hi long")
    rows = [(x[0], *r) for x in samples for r in x[6]]
    return regions.build_layouts(sizes, spark.createDataFrame(rows, "sample_id long, idx long, raw_lo long, raw_size long, rva long, vsize long"))


def _go(x, p, space):
    """Candidate status and value; comparisons with a missing size are false."""
    _, size, head, over, c0, c1, reg = x
    raw = [r for r in reg if r[1] > 0 and r[2] > 0]
    mapped = lambda r: min(r[2], r[4]) if r[1] > 0 and r[2] > 0 else 0
    own = [r for r in raw if r[1] <= p < r[1] + r[2]] if space == "offset" else [r for r in reg if r[4] > 0 and r[3] <= p < r[3] + r[4]]
    header, past = head is not None and p < head, size is not None and p >= size
    cert = space == "offset" and c0 is not None and c0 <= p < c1
    if head is not None and len(own) + header + cert > 1:
        return "overlapping", None
    if space == "rva":
        if own:
            back = own[0][1] + p - own[0][3]
            if p - own[0][3] >= mapped(own[0]):
                return "virtual_only", None
            return ("truncated", None) if size is not None and back >= size else ("ok", back)
        if header:
            return ("truncated", None) if past else ("headers", p)
        return "unmapped", None
    if header:
        return ("truncated", None) if past else ("headers", p)
    if own:
        if past:
            return "truncated", None
        return ("ok", own[0][3] + p - own[0][1]) if p - own[0][1] < mapped(own[0]) else ("padding", None)
    if cert:
        return ("truncated", None) if past else ("certificate", None)
    if over is not None and p >= over:
        return ("unmapped" if past else "overlay"), None
    return "padding", None


def _want(x, p, space):
    status, value = _go(x, p, space)
    if status in OK:
        again = _go(x, value, "rva" if space == "offset" else "offset")
        if again[0] not in OK or again[1] != p:
            return "overlapping", None
    return status, value


def test_points_of_odd_layouts(spark):
    samples = _samples()
    lay = _layouts(spark, samples).persist()
    pts = spark.createDataFrame([(x[0], p) for x in samples for p in range(-2, 66)], "sample_id long, pos long")
    for space in ("offset", "rva"):
        got = {(r.sample_id, r.pos): (r.status, r.value) for r in regions.map_points(pts, lay, space).collect()}
        assert got == {(x[0], p): _want(x, p, space) for x in samples for p in range(-2, 66)}
    lost = spark.createDataFrame([(1, None)], "sample_id long, pos long")
    assert [tuple(r) for r in regions.map_points(lost, lay, "rva").collect()] == [(1, None, "unmapped", None)]


def test_segments_of_odd_layouts(spark):
    """Every position of a segment maps like its first, segments cover the interval, whole files agree with their segments."""
    samples = _samples()
    lay = _layouts(spark, samples).persist()
    by = {x[0]: x for x in samples}
    iv = spark.createDataFrame([(x[0], k, lo, hi) for x in samples for k, (lo, hi) in enumerate([(-3, 70), (5, 6), (9, 9), (10, 44)])], "sample_id long, component_id int, lo long, hi long")
    for space in ("offset", "rva"):
        covered = {}
        for r in regions.map_intervals(iv, lay, space).collect():
            for p in range(r.src_lo, r.src_hi):
                value = None if r.dst_lo is None else r.dst_lo + p - r.src_lo
                # without a header size, or below zero, boundaries are not known on both sides
                if by[r.sample_id][2] is not None and p >= 0:
                    assert (r.status, value) == _want(by[r.sample_id], p, space)
                covered.setdefault((r.sample_id, r.component_id, r.lo, r.hi), []).append(p)
        assert {k: sorted(v) for k, v in covered.items()} == {(s, k, lo, hi): list(range(lo, hi)) for s, k, lo, hi in map(tuple, iv.collect()) if hi > lo}
    whole = lay.select("sample_id", F.lit(0).alias("component_id"), F.lit(0).cast("bigint").alias("lo"), F.col("file_size").alias("hi"))
    segs = regions.map_intervals(whole, lay)
    facts = regions.coverage_facts(segs, lay).join(regions.round_trip_check(segs, lay), "sample_id", "left").na.fill(0, ["points", "errors"])
    a, b = ({r.sample_id: r.asDict() for r in df.collect()} for df in (facts, regions.whole_file_facts(lay)))
    assert a == b and len(a) == sum(bool(x[1]) for x in samples)


def _plans(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution()
    return plan.optimizedPlan().toString(), plan.executedPlan().toString()


def test_segments_are_resolved_once_and_without_lambdas(spark, sf):
    """A lambda per region and position took most of the time."""
    logical, physical = _plans(spark, sf, "d12_map_intervals_back")
    assert "lambdafunction" not in logical and physical.count("ArrowEvalPython") == 1


def test_summary_reads_its_layouts_once(spark, sf):
    """Segments were cut twice, and each of their points met its layout again."""
    logical, physical = _plans(spark, sf, "i13_cohort_summary")
    assert "lambdafunction" not in logical and physical.count("ArrowEvalPython") == 1 and logical.count("Relation") == 2
