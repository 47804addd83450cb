"""Round-robin selection, matching and merging against direct loops on small inputs."""

import hashlib
import random

from pyspark.sql import functions as F

from spanframe.operators import boxes, cohort, controls, intervals


def test_round_robin_matches_direct_loop(spark):
    rnd = random.Random(3)
    tags, target, seed = ["a", "b"], 12, "s"
    rows = [(i, "train", [t for t in tags if rnd.random() < 0.3], rnd.choice(["low", "mid", "high"])) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id bigint, split string, tags array<string>, stratum string")
    got = [r.sample_id for r in cohort.stratified_round_robin(df, target, seed, tags).orderBy("slot").collect()]
    order = sorted(rows, key=lambda r: hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest())
    member = {"a": lambda r: "a" in r[2], "b": lambda r: "b" in r[2], "no_tag": lambda r: not r[2]}
    for s in ("low", "mid", "high"):
        member[s] = lambda r, s=s: r[3] == s
    want, moved = [], True
    while moved and len(want) < target:
        moved = False
        for s in ("a", "b", "no_tag", "low", "mid", "high"):
            hit = next((r[0] for r in order if r[0] not in want and member[s](r)), None)
            if hit is not None and len(want) < target:
                want.append(hit)
                moved = True
    assert got == want


def test_promotion_chain(spark):
    m = spark.createDataFrame(
        [(1, "train", "primary", 1), (2, "train", "primary", 2), (3, "train", "reserve", 3), (4, "test", "primary", 4)], "sample_id bigint, split string, role string, pos bigint"
    ).withColumn("exclusion_reason", F.lit(None).cast("string")).withColumn("replaces", F.lit(None).cast("bigint"))
    bad = spark.createDataFrame([(1, False, "HTTPError: x"), (4, False, None)], "sample_id bigint, ok boolean, error string")
    first = cohort.promote_reserves(m, bad, "preflight")
    rows = {r.sample_id: r for r in first.collect()}
    assert rows[3].role == "replacement" and rows[3].replaces == 1
    assert rows[4].exclusion_reason == "preflight:unknown"
    again = spark.createDataFrame([(3, False, "gone")], "sample_id bigint, ok boolean, error string")
    after = {r.sample_id: r for r in cohort.promote_reserves(first, again, "static").collect()}
    assert after[3].exclusion_reason == "static:gone" and after[2].role == "primary"


def _iou(a, b):
    dx = min(a[2], b[2]) - max(a[0], b[0])
    dy = min(a[3], b[3]) - max(a[1], b[1])
    i = max(dx, 0) * max(dy, 0)
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def test_match_detections_against_direct_loop(spark):
    rnd = random.Random(5)

    def box():
        x, y = rnd.randint(0, 60), rnd.randint(0, 60)
        return (x, y, x + rnd.randint(20, 50), y + rnd.randint(20, 50))

    pred = [(1, i, rnd.choice("AB"), round(rnd.random(), 3), *map(float, box())) for i in range(25)]
    truth = [(1, i, rnd.choice("ab"), *map(float, box())) for i in range(25)]
    p = spark.createDataFrame(pred, "image_id bigint, box_id bigint, label string, score double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(truth, "image_id bigint, box_id bigint, label string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.pred_id, r.truth_id, r.status) for r in boxes.match_detections(p, t, 0.3).collect()}
    free, want, used = set(range(25)), set(), set()
    for q in sorted(pred, key=lambda q: (-q[3], q[1])):
        same = [g for g in truth if g[1] in free and g[2].lower() == q[2].lower()]
        if same:
            best = max(same, key=lambda g: (_iou(q[4:], g[3:]), -g[1]))
            if _iou(q[4:], best[3:]) >= 0.3:
                free.discard(best[1])
                used.add(q[1])
                want.add((q[1], best[1], "true_positive"))
    want |= {(q[1], None, "false_positive") for q in pred if q[1] not in used} | {(None, g, "false_negative") for g in free}
    left = set(free)
    for q in pred:
        if q[1] in used or not left:
            continue
        best = max((g for g in truth if g[1] in left), key=lambda g: (_iou(q[4:], g[3:]), -g[1]))
        if _iou(q[4:], best[3:]) >= 0.3 and best[2].lower() != q[2].lower():
            want.add((q[1], best[1], "class_mismatch"))
            left.discard(best[1])
    assert got == want


def test_controls_stay_clear(spark):
    ev = spark.createDataFrame([(1, 0, 10), (1, 50, 60), (2, 0, 99)], "sample_id bigint, lo bigint, hi bigint")
    n = spark.createDataFrame([(1, 200), (2, 100)], "sample_id bigint, n bigint")
    placed, missing = controls.matched_controls(ev, n, "t")
    assert placed.filter("sample_id = 1").count() == 2
    assert [r.sample_id for r in missing.collect()] == [2]
    assert intervals.intersect(ev, placed, ["sample_id"]).count() == 0


def test_round_robin_cuts_strata_before_any_sort(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("train").alias("split"), F.lit("low").alias("s"),
        F.sha2(F.col("id").cast("string"), 256).alias("h"))
    for target in (1, 12, 300, 10**6):
        cut = cohort._first_by_prefix(rows, target)
        first = lambda d: {r.sample_id for r in d.filter("split is null").orderBy("h").limit(target).collect()}
        assert first(cut) == first(rows)
        assert target > 300 or cut.count() < 2 * target + 60
