"""Operators that read content: plans without content shuffles, values against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from spanframe.operators import classify, controls, intervals, sequence, spans
from spanframe.sources import dumps


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_above_a_content_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.encode("text", "utf-8").alias("raw"))
    for df in (
        sequence.symbol_histogram(docs, "doc_id", "text"), sequence.tile_entropy(docs, "doc_id", "text", 64), sequence.bigram_counts(docs, "doc_id", "raw"),
        spans.literal_spans(docs, "doc_id", "text", ["the "]), spans.regex_spans(docs, "doc_id", "text", {"w": "[0-9]+"}),
    ):
        assert "Exchange" not in plan(df)


def test_row_statistics(spark):
    raw = [b"", bytes(range(10)), b"\x00" * 5 + b"\x07" * 11, None]
    df = spark.createDataFrame(list(enumerate(raw)), "id bigint, content binary")
    got = {(r.sample_id, r.row): r for r in sequence.row_statistics(df, "id", "content", 8).collect()}
    for i, data in enumerate(raw):
        data = data or b""
        for k in range(max(1, -(-len(data) // 8))):
            row = data[8 * k : 8 * k + 8].ljust(8, b"\x00")
            share = [row.count(c) / 8 for c in set(row)]
            r = got.pop((i, k))
            assert r["mean"] == pytest.approx(sum(row) / 8 / 255) and r.distinct == len(set(row)) / 256
            assert r.entropy == pytest.approx(-sum(p * math.log2(p) for p in share) / 8)
    assert not got


def test_empty_content_keeps_its_features(spark):
    df = spark.createDataFrame([(1, b""), (2, b"ab")], "id bigint, content binary")
    rows = sequence.hashed_bigram_features(df, "id", "content").collect()
    assert sum(r.value for r in rows if r.sample_id == 1) == pytest.approx(1.0) and {r["index"] for r in rows if r.sample_id == 1} == set(range(256))


def test_literals_do_not_overlap(spark):
    df = spark.createDataFrame([(1, "aaaa.b"), (2, None)], "id bigint, t string")
    assert [(r.lo, r.hi) for r in spans.literal_spans(df, "id", "t", ["aa"]).orderBy("lo").collect()] == [(0, 2), (2, 4)]
    assert spans.literal_spans(df, "id", "t", ["."]).first().lo == 4


def test_large_positions(spark):
    big = (1 << 52) + 1
    df = spark.createDataFrame([(1, big * 1024 - 1, big * 1024 + 1)], "k bigint, lo bigint, hi bigint")
    assert {r.tile for r in intervals.tile_pieces(df, ["k"], 1024).collect()} == {big - 1, big}


def test_addresses_of_any_width(spark):
    text = "401000 4d 5A\n00401002 01\n0000000000401003 02\nx y"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a\u0000b"), (4, "zz")], "sample_id bigint, t string")
    assert [r.addr for r in dumps.parse_hex_dumps(df, "t").orderBy("line_no").collect()] == [0x401000, 0x401002, 0x401003]
    assert {(r.sample_id, r.reason) for r in dumps.refused_dumps(df, "t").collect()} == {(2, "empty"), (3, "binary"), (4, "no_address_line")}
    seg = spark.createDataFrame([(1, "a:401000 x\na:0000000000401008 y\nb:12345 short")], "sample_id bigint, t string")
    assert [(r.name, r.lo, r.hi) for r in dumps.parse_segment_listing(seg, "t").collect()] == [("a", 0x401000, 0x401008)]


def test_exact_scores_are_not_merged(spark):
    rows = [(0, 0.5 + i * 1e-9, i % 2 == 0) for i in range(10)]
    r = classify.ranking_curves(spark.createDataFrame(rows, "g int, s double, pos boolean"), ["g"], "s", "pos").first()
    wins = sum((a[1] > b[1]) for a in rows for b in rows if a[2] and not b[2])
    assert r.roc_auc == pytest.approx(wins / 25)


def test_controls_keep_apart(spark):
    iv = spark.createDataFrame([(1, i * 100, i * 100 + 20) for i in range(40)], "sample_id bigint, lo bigint, hi bigint")
    placed, missing = controls.matched_controls(iv, spark.createDataFrame([(1, 4000)], "sample_id bigint, n bigint"), "s")
    spans_ = sorted((r.lo, r.hi) for r in placed.collect()) + sorted((r.lo, r.hi) for r in iv.collect())
    spans_.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans_, spans_[1:])) and placed.count() + missing.count() == 40


def test_text_model_vectors_are_the_sparse_features(spark):
    from pyspark.ml.functions import vector_to_array

    from spanframe.operators import textmodel

    texts = [b"", None, b"a", b"abab", bytes(range(256)) * 3, "z\u00e4h".encode()] * 120
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "sample_id bigint, content binary, quality int")
    want = {}
    for r in sequence.hashed_bigram_features(df, "sample_id", "content", textmodel.BUCKETS).collect():
        want.setdefault(r.sample_id, {})[r["index"]] = r["value"]
    out = textmodel.feature_vectors(df, "content", ["quality"])
    got = {r.sample_id: ({i: v for i, v in enumerate(r.v) if v}, r.quality) for r in out.select("sample_id", vector_to_array("features").alias("v"), "quality").collect()}
    assert got == {i: (want[i], i % 2) for i in range(len(texts))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
