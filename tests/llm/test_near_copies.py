"""Near copies planted at known similarities, and random ones against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.llm import near_copies, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(words, at):
    return " ".join(f"new{k}" if k in at else w for k, w in enumerate(words))


def test_planted_pairs_at_each_similarity(spark):
    """One, two, three or four changed words far apart: 0.95 to 0.8 of the shingles are shared."""
    rng, rows, levels = random.Random(11), [], set()
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, changed(words, range(20, 20 + 50 * (i % 4 + 1) - 1, 50)) if i % 8 < 7 else changed(words, (20, 70, 120, 170, 100))))
        levels.add((round(jaccard(*(shingles(t) for _, t in rows[-2:])), 2)))
    assert {0.95, 0.9, 0.86, 0.82} <= levels
    want = {i for i, t in rows if i % 2 == 0 or jaccard(shingles(t), shingles(rows[i - 1][1])) < 0.8}
    kept = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == want and len(want) == 45


@pytest.mark.parametrize("rounds", [2, 0])
def test_components_are_those_of_brute_force(spark, rounds, monkeypatch):
    """Crowds and chains of copies; hot groups are split at two rows."""
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "HOT", 2)
    rng, texts = random.Random(5), ["", None, "  ", "One two", "one TWO", "one"]
    for size in (25, 12, 2, 2):
        crowd = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 120))]]
        for _ in range(size):
            words = list(rng.choice(crowd))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            crowd.append(words)
        texts += [" ".join(w) for w in crowd]
    rng.shuffle(texts)
    sets, part = [shingles(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("row", F.col("id").cast("bigint"))
    got = {r.row: r.low.id for r in near_copies.similar_components(df).collect()}
    assert got == dict(enumerate(part)) and 4 < len(set(part)) < len(part) - 10


def test_pipeline_keeps_one_document_of_each_simhash_component(spark, sf):
    """The stage drops what the SimHash operator links, whatever else is alike; repeated and null ids too."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lows = {r.component_id for r in simhash.simhash_components(docs, words=5).collect()}
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == lows and kept.columns == docs.columns and kept.count() == len(lows) < docs.count()
    rows = [(3, "a b c d e f"), (None, "A b c d e f"), (2, None), (2, ""), (5, "x")]
    own = simhash.without_simhash_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in own.collect()) == [(0, "A b c d e f"), (2, None), (5, "x")]


def test_order_counts_every_row(spark):
    """More rows than the sample once held: each slot is ranked by its count over all of them."""
    import numpy as np
    import xxhash

    from spanframe.llm import line_dedup

    df = spark.range(45_000).selectExpr("id as uid", "id as row", "concat('w', floor(sqrt(id))) as text")
    words = [f"w{k}".encode() for k in range(213)]
    counts = np.bincount(np.floor(np.sqrt(np.arange(45_000))).astype(int))
    for ranks, hashes in ((line_dedup.slot_ranks(df), [xxhash.xxh64_intdigest(w) for w in words]), (near_copies.slot_ranks(df, 5), [int(near_copies.shingle_set(w.decode(), 5, near_copies._Words())[0]) for w in words])):
        n = np.zeros(1 << 20, np.int64)
        np.add.at(n, [h >> 44 for h in hashes], counts)
        want = np.empty(1 << 20, np.int32)
        want[np.argsort(n, kind="stable")] = np.arange(1 << 20, dtype=np.int32)
        assert (ranks == want).all()
