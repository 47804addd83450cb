"""Observed deletion curves against a byte-by-byte count."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanframe.operators.evidence import observed_deletion_curve


def test_one_sample_of_many_steps_equals_counting_bytes(spark):
    rng = random.Random(5)
    rows = [("hot", k, lo, lo + rng.randrange(1, 60), k / 10) for k, lo in enumerate((rng.choice([0, 0, rng.randrange(900)]) for _ in range(700)), 1)]
    rows += [("one", 1, 4, 9, 2.0), ("two", 1, 0, 3, 1.0), ("two", 2, 0, 3, 1.5)]
    steps = spark.createDataFrame(rows, "sample_id string, step int, lo long, hi long, nll double").repartition(7)
    base = spark.createDataFrame([("hot", 1000, 0.5), ("one", 10, 1.0), ("two", 6, 1.0), ("none", 4, 2.0)], "sample_id string, n long, nll double")
    want, seen = {("hot", 0): (0.0, 0.0), ("one", 0): (0.0, 0.0), ("two", 0): (0.0, 0.0), ("none", 0): (0.0, 0.0)}, {}
    size, start = {"hot": 1000, "one": 10, "two": 6}, {"hot": 0.5, "one": 1.0, "two": 1.0}
    for s, k, lo, hi, nll in sorted(rows):
        seen.setdefault(s, set()).update(range(lo, hi))
        want[s, k] = (len(seen[s]) / size[s], nll - start[s])
    got = {(r.sample_id, r.step): (r.fraction, r.delta_nll) for r in observed_deletion_curve(steps, base).collect()}
    assert got == want


def test_no_steps_leave_the_starts(spark):
    steps = spark.createDataFrame([], "sample_id string, step int, lo long, hi long, nll double")
    base = spark.createDataFrame([("a", 4, 2.0)], "sample_id string, n long, nll double")
    assert [(r.sample_id, r.step, r.nll, r.fraction) for r in observed_deletion_curve(steps, base).collect()] == [("a", 0, 2.0, 0.0)]
    assert observed_deletion_curve(steps, base).filter(F.col("step") > 0).isEmpty()
