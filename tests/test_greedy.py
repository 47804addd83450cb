"""Rounds of greedy choices, pointer jumps and rank statistics against plain loops, on one large group."""

import math
import random

from pyspark.sql import functions as F

from spanframe.operators import boxes, headers, stats
from spanframe.operators.greedy import greedy_owners, greedy_pairs


def test_pairs_of_one_large_group(spark):
    rng = random.Random(1)
    rows = list({(1, rng.randrange(700), rng.randrange(700)): rng.random() for _ in range(6000)}.items())
    rows = [(*k, round(v, 3)) for k, v in rows] + [(2, 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "g int, p int, t int, score double")
    got = {tuple(r) for r in greedy_pairs(df, "g", "p", "t", [-F.col("score"), F.col("p"), F.col("t")]).collect()}
    used, want = set(), set()
    for g, p, t, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (g, "p", p) not in used and (g, "t", t) not in used:
            used |= {(g, "p", p), (g, "t", t)}
            want.add((g, p, t, s))
    assert got == want
    assert greedy_pairs(df.limit(0), "g", "p", "t", [F.col("p"), F.col("t")]).count() == 0


def test_pairs_of_small_groups_are_those_of_rounds(spark):
    """Few pairs are walked in one row, more go by rounds; a mixed table gives the same either way."""
    rng = random.Random(8)
    rows = [(f"g{g}", rng.randrange(6), rng.randrange(6), k, rng.randrange(3)) for g in range(50) for k in range(1 + g % 20)]
    df = spark.createDataFrame(rows, "g string, p long, t long, k int, score int")
    order = [-F.col("score"), F.col("k")]
    a, b, c = [sorted(map(tuple, greedy_pairs(df, "g", "p", "t", order, small).collect())) for small in (0, 7, 64)]
    assert a == b == c and {r[0] for r in a} == {f"g{g}" for g in range(50)}


def test_owners_of_one_large_group(spark):
    rng = random.Random(2)
    n = 1500
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(4000)}
    order = list(range(n))
    rng.shuffle(order)
    place = {v: k for k, v in enumerate(order)}
    before = [(1, a, b, place[b]) if place[b] < place[a] else (1, b, a, place[a]) for a, b in edges]
    nodes = spark.createDataFrame([(1, v) for v in range(n)], "g int, v int")
    got = {r.v: r.owner for r in greedy_owners(nodes, spark.createDataFrame(before, "g int, v int, rival int, key int"), "g", "v").collect()}
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want, free = {}, set(range(n))
    for v in order:
        if v in free:
            for w in {v} | (near[v] & free):
                want[w] = v
            free -= {v} | near[v]
    assert got == want


def _boxes(rng, n):
    out = []
    for i in range(n):
        x, y = rng.randrange(900), rng.randrange(900)
        out.append((1, i, rng.choice("AB"), round(rng.random(), 2), float(x), float(y), float(x + rng.randrange(20, 60)), float(y + rng.randrange(20, 60))))
    return out


def test_merge_of_a_crowded_image(spark):
    rows = _boxes(random.Random(3), 900)
    df = spark.createDataFrame(rows, "image_id bigint, box_id bigint, label string, score double, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.label, r.score, round(r.x1, 6), r.n_merged) for r in boxes.merge_boxes(df, 0.4).collect())

    def ios(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        return max(w, 0) * max(h, 0) / min((a[6] - a[4]) * (a[7] - a[5]), (b[6] - b[4]) * (b[7] - b[5]))

    order, gone, want = sorted(rows, key=lambda r: (-r[3], r[2], *r[4:], r[1])), set(), []
    for a in order:
        if a[1] in gone:
            continue
        own = [b for b in order if b[1] not in gone and (b is a or b[2] == a[2] and ios(a, b) >= 0.4)]
        gone |= {b[1] for b in own}
        w = [max(b[3], 1e-8) for b in own]
        want.append((a[2], max(b[3] for b in own), round(sum(b[4] * v for b, v in zip(own, w)) / sum(w), 6), len(own)))
    assert got == sorted(want) and max(x[3] for x in want) > 3


def test_matching_of_a_crowded_image(spark):
    rng = random.Random(4)
    pred, truth = _boxes(rng, 500), [(b[0], b[1] + 9, rng.choice("ab"), *b[4:]) for b in _boxes(rng, 500)]
    truth += [(1, 2000 + p[1], p[2].lower(), *(v + 2 for v in p[4:])) for p in pred[:300]] + [(1, 4000 + p[1], "a", *(v + 3 for v in p[4:])) for p in pred[:200]]
    cols = "x1 double, y1 double, x2 double, y2 double"
    out = boxes.match_detections(
        spark.createDataFrame(pred, f"image_id bigint, box_id bigint, label string, score double, {cols}"), spark.createDataFrame(truth, f"image_id bigint, box_id bigint, label string, {cols}"), 0.3)
    got = {(r.pred_id, r.truth_id, r.status) for r in out.collect() if r.status in ("true_positive", "class_mismatch")}

    def iou(a, b):
        w, h = min(a[6], b[5]) - max(a[4], b[3]), min(a[7], b[6]) - max(a[5], b[4])
        i = max(w, 0.0) * max(h, 0.0)
        return i / ((a[6] - a[4]) * (a[7] - a[5]) + (b[5] - b[3]) * (b[6] - b[4]) - i)

    pairs = [(p, t, v) for p in pred for t in truth if (v := iou(p, t)) >= 0.3]
    used_p, used_t, want = set(), set(), set()
    for status, key, same in (("true_positive", lambda r: (-r[0][3], r[0][1], -r[2], r[1][1]), True), ("class_mismatch", lambda r: (r[0][1], -r[2], r[1][1]), False)):
        for p, t, _ in sorted(pairs, key=key):
            if (p[2].lower() == t[2].lower()) == same and p[1] not in used_p and t[1] not in used_t:
                used_p.add(p[1]), used_t.add(t[1])
                want.add((p[1], t[1], status))
    assert got == want and {s for *_, s in want} == {"true_positive", "class_mismatch"}


def test_guarded_tiles_of_images_of_many_sizes(spark):
    """Images of one batch are chosen for together, as one by one; equal scores go to the smaller tile."""
    rng = random.Random(3)
    rows = [(i, t, rng.randrange(4) / 4, rng.random() < 0.3, float(t % 5), float(t // 5)) for i in range(40) for t in range(1 + i % 13)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id long, tile long, score double, guarded boolean, x1 double, y1 double")
    df = df.selectExpr("*", "x1 + 1 as x2", "y1 + 1 as y2", "5 as width", "5 as height")
    got = {(r.image_id, r.tile) for r in boxes.select_guarded(df, 0.5, 0.4).collect()}
    want = set()
    for i in range(40):
        cells = sorted((r[1:] for r in rows if r[0] == i), key=lambda c: (-c[1], c[0]))
        k = max(1, math.ceil(len(cells) * 0.5))
        at = {c[0]: ((c[3] + 0.5) / 5, (c[4] + 0.5) / 5) for c in cells}
        taken = [c[0] for c in cells if c[2]][:k]
        for _ in range(min(k - len(taken), math.ceil(k * 0.4))):
            far = lambda t: min([(at[t][0] - at[u][0]) ** 2 + (at[t][1] - at[u][1]) ** 2 for u in taken], default=0)
            taken.append(max((c[0] for c in cells if c[0] not in taken), key=far))
        taken += [c[0] for c in cells if c[0] not in taken][: k - len(taken)]
        want |= {(i, t) for t in taken}
    assert got == want


def test_guarding_moves_no_tiles(spark, sf):
    """Tiles lie by image; marking them moves the cells that meet and one row per hit image."""
    from spanframe.plans import catalog

    plan = catalog.queries()["f12_select_guarded"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in moved if "tile#" in line] and "_hit" in plan


def test_kendall_of_one_group_with_ties(spark):
    rng = random.Random(5)
    rows = [(1, float(rng.randrange(40)), float(rng.randrange(25))) for _ in range(400)] + [(2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, 1.0), (1, None, 1.0)]
    got = {r.g: (r.n, r.kendall_tau) for r in stats.kendall_tau_b(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    pts, sign = [r[1:] for r in rows[:400]], lambda v: (v > 0) - (v < 0)
    pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(pts) for b in pts[:i]]
    tau = sum(x * y for x, y in pairs) / (sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs)) ** 0.5
    assert got[1][0] == 400 and abs(got[1][1] - tau) < 1e-12 and got[2] == (2, None) and got[3] == (1, None)


def test_kendall_of_small_groups_is_that_of_levels(spark):
    """Many small groups take no sort over the cluster; both ways give the same numbers."""
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(6)), float(rng.randrange(5))) for g in range(60) for _ in range(rng.randrange(1, 30))] + [(None, 1.0, 2.0), (0, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    ways = [stats.kendall_tau_b(df, ["g"], "x", "y", small) for small in (0, 8, 64)]
    a, b, c = [{r.g: (r.n, r.kendall_tau and round(r.kendall_tau, 12)) for r in w.collect()} for w in ways]
    assert a == b == c and len(a) == 60
    plans = [w._jdf.queryExecution().optimizedPlan().toString() for w in ways]
    assert "Window" in plans[0] and "Window" not in plans[2] and "Join" not in plans[2]


def test_chains_of_overlapping_spans(spark):
    rng = random.Random(6)
    spans = {(1, i): i + rng.randrange(1, 50) for i in range(0, 3000, 2)} | {(2, 5): 9, (2, 9): 12, (2, 10): 11}
    rows = [(s, lo, hi) for (s, lo), hi in spans.items()]
    got = sorted(tuple(r) for r in headers.leftmost_disjoint(spark.createDataFrame(rows, "sample_id bigint, lo bigint, hi bigint"), 50).collect())
    want, end = [], {}
    for s, lo, hi in sorted(rows):
        if lo >= end.get(s, 0):
            want.append((s, lo, hi))
            end[s] = hi
    assert got == want


def _header(jump=64, sections=2, optional=96, magic=0x10B):
    return b"MZ" + bytes(58) + jump.to_bytes(4, "little") + bytes(jump - 64) + b"PE\0\0" + bytes(2) + sections.to_bytes(2, "little") + bytes(12) + optional.to_bytes(2, "little") + bytes(2) + magic.to_bytes(2, "little") + bytes(optional - 2)


def brute_scan(data, cap):
    out, i = [], data.find(b"MZ", 1)
    while i >= 0:
        hi, jump = None, int.from_bytes(data[i + 60 : i + 64], "little")
        at = i + jump
        if i + 64 <= len(data) and jump > 0 and at + 26 <= len(data) and data[at : at + 4] == b"PE\0\0":
            n, opt, magic = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (6, 20, 24))
            if 1 <= n <= 96 and magic in (0x10B, 0x20B):
                hi = i + max(1, min(jump + 24 + opt + 40 * n, cap, len(data) - i))
                out.append((i, hi))
        i = data.find(b"MZ", hi or i + 2)
    return out


def test_headers_across_pieces(spark):
    rng = random.Random(7)
    samples = {0: b"", 1: b"MZ", 2: _header(), 3: b"MMZMZ" + _header()[:70], 4: b"x" + _header(sections=0) + _header(magic=0x20B) + b"MZ" * 9 + _header(jump=300), 5: b"M" + _header(sections=97) + _header(jump=4000)}
    for k in range(6, 30):
        samples[k] = b"".join(rng.choice([b"MZ", b"M", b"Z", bytes(rng.randrange(90)), _header(rng.randrange(64, 200), rng.randrange(1, 4)), _header()[: rng.randrange(64, 90)]]) for _ in range(12))
    for size in (7, 64, 1000):
        rows = [(k, i // size, data[i : i + size]) for k, data in samples.items() for i in range(0, max(1, len(data)), size)]
        got = sorted(tuple(r) for r in headers.scan_headers(spark.createDataFrame(rows, "sample_id bigint, piece int, content binary"), size, 500).collect())
        assert got == [(k, *s) for k, data in samples.items() for s in brute_scan(data, 500)] and len(got) > 20


def test_unfolded_tiles_are_not_broadcast(spark, sf):
    """Every image has nine tiles of four cells, which the optimizer takes for one row."""
    from spanframe.plans import catalog

    plan = catalog.queries()["k8_slice_annotations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
