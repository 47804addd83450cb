"""Whole small tables against brute force, SQL twins and round trips."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
import corpus_pipeline
from spanframe.llm import queries, simhash

NAMES = {
    "op1_sentencepiece", "op2_license_scan", "op3_exact_dedup", "op4_html_extraction", "op5_simhash", "op6_nearest_neighbours", "op7_line_dedup",
    "op8_best_fit_packing", "op9_quality_classifier", "op10_chat_formatting", "op11_divergence_rules", "op12_ranked_search", "op13_collocations", "pipeline",
}


def test_registered():
    assert set(queries.queries()) == NAMES <= set(contract.queries())
    assert set(queries.oracle_sql()) <= NAMES


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == cols and Counter(tuple(r[c] for c in cols) for r in df.collect()) == want


def brute_print(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """Smallest index reachable, over all pairs."""
    u = np.array(prints, dtype=np.uint64)
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= radius).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(u))]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("dense", [4096, 1])
def test_simhash_components(spark, sf, documents, dense):
    """``dense=1`` sends every crowd through midpoints."""
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(spark.read.parquet(f"{sf}/documents.parquet"), dense=dense).collect()}
    prints = [brute_print(t, 4) for _, t in documents]
    parts = brute_components(prints)
    assert got == {d: (f"{p:016x}", documents[c][0]) for (d, _), p, c in zip(documents, prints, parts)}


def test_pivots_and_keys_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.int64)
    rows = []
    for x in base.tolist():
        y = x
        for b in rng.choice(63, rng.integers(1, 6), replace=False).tolist():
            y ^= 1 << b
        rows += [(x,), (y,)]
    values = sorted({r[0] for r in rows})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4}
    got = {(r.a, r.b) for r in simhash.fingerprint_links(spark.createDataFrame(rows, "fp bigint")).collect()}
    assert got == want and len(want) > 100


def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = queries.queries()["op6_nearest_neighbours"](spark, sf).collect()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit += len(want & {r.vec_id for r in found if r.query_id == q})
        total += len(want)
    assert hit / total >= 0.9


def brute_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        keep = []
        for line in (text or "").split("\n"):
            own = set(line.split())
            if not own or not any(len(own & s) * 5 >= 4 * len(own | s) for s in seen):
                keep.append(line)
            if own and own not in seen:
                seen.append(own)
        out[i] = "\n".join(keep)
    return out


def test_pipeline_by_stage(spark, sf, tmp_path):
    docs, states = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        states.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    accepted, lined, single, packed = ({r.doc_id: r for r in s.collect()} for s in states)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [d for d in labels if d in accepted or labels[d] == 0]
    assert sum(labels[d] == int(d in accepted) for d in labels) >= 0.9 * len(labels) and known
    want = brute_lines([(d, r.text) for d, r in accepted.items()])
    assert {d: r.text for d, r in lined.items()} == want and all(r.n_chars == len(r.text) for r in lined.values())
    ids = sorted(lined)
    parts = brute_components([brute_print(lined[d].text, 5) for d in ids])
    assert set(single) == {ids[c] for c in parts}
    assert set(packed) == set(single)
    assert Counter(r.sequence_id for r in states[-1].collect()).total() == states[-1].count()
    assert states[-1].groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0
