"""Interval algebra against an exhaustive set model: all subset pairs in one job."""

from itertools import chain, combinations

from spanframe.operators import intervals as iv

POOL = [(0, 3), (2, 5), (5, 6), (7, 12), (9, 11)]


def _runs(points):
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return {tuple(r) for r in out}


def _cases():
    subsets = list(chain.from_iterable(combinations(POOL, n) for n in range(len(POOL) + 1)))
    return [(i * len(subsets) + j, a, b) for i, a in enumerate(subsets) for j, b in enumerate(subsets)]


def _check(spark, op, model, width):
    cases = _cases()
    rows_a = [(k, lo, hi) for k, a, _ in cases for lo, hi in a]
    rows_b = [(k, lo, hi) for k, _, b in cases for lo, hi in b]
    schema = "key bigint, lo bigint, hi bigint"
    a, b = spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema)
    got = {}
    for r in op(a, b, ["key"], width).collect():
        got.setdefault(r.key, set()).add((r.lo, r.hi))
    for k, x, y in cases:
        px = {p for lo, hi in x for p in range(lo, hi)}
        py = {p for lo, hi in y for p in range(lo, hi)}
        assert got.get(k, set()) == _runs(model(px, py)), (k, x, y)


def test_union_all_pairs_small_buckets(spark):
    _check(spark, iv.union, lambda a, b: a | b, 4)


def test_intersect_all_pairs_small_buckets(spark):
    _check(spark, iv.intersect, lambda a, b: a & b, 3)


def test_difference_all_pairs(spark):
    _check(spark, iv.difference, lambda a, b: a - b, iv.WIDTH)


def test_negative_positions_and_long_interval(spark):
    df = spark.createDataFrame([(1, -10, 25), (1, 25, 30), (1, 40, 41)], "key bigint, lo bigint, hi bigint")
    assert sorted((r.lo, r.hi) for r in iv.normalize(df, ["key"], 8).collect()) == [(-10, 30), (40, 41)]
    assert sorted((r.lo, r.hi) for r in iv.merge_bounded(df, ["key"]).collect()) == [(-10, 30), (40, 41)]


def test_empty_conventions_differ(spark):
    none = spark.createDataFrame([], "key bigint, lo bigint, hi bigint")
    keys = spark.createDataFrame([(1,)], "key bigint")
    assert iv.jaccard(none, none, ["key"], keys).first().jaccard == 1.0
    assert iv.byte_iou(none, none, ["key"], keys).first().byte_iou == 0.0
