"""Rectangles become byte intervals bucket by bucket."""

import random

from spanframe.operators import coordinates

MODES = {1: ("raw-rgb", 3), 2: ("word16-rgb", 2), 3: ("opcode-3gram-rgb", 1)}


def _tables(spark, boxes, encs):
    b = spark.createDataFrame(boxes, "sample_id long, x long, y long, w long, h long")
    return b, spark.createDataFrame(encs, "sample_id long, mode string, stride long, n_source long, n_pixels long")


def _runs(taken):
    out = []
    for p in sorted(taken):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(r) for r in out]


def test_boxes_over_bucket_edges_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    width, n = 13, {1: 911, 2: 700, 3: 500}
    boxes = [(s, rng.randrange(-3, 12), rng.randrange(-2, 30), rng.randrange(0, 9), rng.randrange(0, 12)) for s in (1, 2, 3) for _ in range(12)]
    boxes += boxes[:5] + [(2, 3, None, 2, 2), (2, 3, 1, None, 2), (9, 0, 0, 1, 1)]
    encs = [(s, *MODES[s], n[s], -(-n[s] // MODES[s][1])) for s in n]
    want = {s: set() for s in n}
    for s, x, y, w, h in boxes:
        if s == 9 or None in (x, y, w, h) or s == 3:
            continue
        stride, source = MODES[s][1], n[s]
        for r in range(y, y + h):
            lo, hi = max(0, r * width + x), min(r * width + x + w, -(-source // stride))
            want[s].update(range(lo * stride, min(hi * stride, source)))
    for size in (7, 64, 1 << 18):
        monkeypatch.setattr(coordinates, "BOX_WIDTH", size)
        b, e = _tables(spark, boxes, encs)
        got = sorted((r.sample_id, r.lo, r.hi) for r in coordinates.bbox_to_bytes(b, e, width, 4).collect())
        assert got == sorted((s, *r) for s in want for r in _runs(want[s])), size


def test_a_box_without_x_is_the_whole_image(spark):
    b, e = _tables(spark, [(1, None, 4, 2, 3)], [(1, "raw-rgb", 3, 100, 34)])
    assert [tuple(r) for r in coordinates.bbox_to_bytes(b, e, 13).collect()] == [(1, 0, 100)]


def test_rows_of_boxes_are_not_shuffled(spark):
    """Five boxes of a thousand rows each move as five records."""
    b, e = _tables(spark, [(1, 0, 0, 3, 1000 + i) for i in range(5)], [(1, "raw-rgb", 3, 10**5, 33334)])
    plan = coordinates.bbox_to_bytes(b, e, 13, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(_r0") < plan.index("REPARTITION_BY_NUM")
