"""Probabilities of masked samples read the content once."""

from spanframe.operators import sequence
from spanframe.plans import catalog


def test_probabilities_from_a_histogram_that_keeps_empty_samples(spark):
    df = spark.createDataFrame([(1, bytearray(b"aab")), (2, bytearray(b"")), (3, None), (4, bytearray(b"a")), (4, bytearray(b""))], "id long, c binary")
    p = {}
    for r in sequence.symbol_probabilities(sequence.symbol_histogram(df, "id", "c", keep_empty=True)).collect():
        p.setdefault(r.sample_id, {})[r.code] = r.p
    even = {i: 1 / 256 for i in range(256)}
    assert p == {1: {97: 2 / 3, 98: 1 / 3}, 2: even, 3: even, 4: {97: 1.0}}


def test_masked_probabilities_put_dumps_together_once(spark, sf):
    plan = catalog.queries()["e1_masked_probabilities"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the dump, its histogram
