"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanframe.llm import chat, exact_dedup, html_text, licenses, line_dedup, multi_index, packing, piece_codec, quality, simhash

LONG = "Word and other words of a long text. " * 20_000
TEXTS = [(1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon"),
         (None, "alpha beta gamma delta epsilon"), (5, LONG), (6, " \n\t "), (None, None), (7, "x  y\n\nz ▁ \u3000 é 😀")]


@pytest.fixture(scope="module")
def docs(spark):
    """Other columns bear the names that the operators use inside."""
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    for name in ("id", "t", "fp", "key", "n", "norm", "uid", "line", "block", "piece", "length", "score", "n_chars"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_codec(docs, none):
    sp = piece_codec.open_codec(None).sp
    got = Counter(tuple(r) for r in piece_codec.codec_digests(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        ids = sp.encode(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest())] += 1
    assert got == want
    assert piece_codec.codec_digests(none).count() == 0
    ids = {r.doc_id: r.ids for r in piece_codec.encode_documents(docs.filter("doc_id in (1, 3)")).collect()}
    assert ids == {1: sp.encode(TEXTS[0][1]), 3: []}


@pytest.mark.parametrize("text", ["", " ", "   ", "a  b", " a", "a ", "a\nb c", "▁", "▁a ▁ b", "\x00", "a" * 5000 + " b", "日本 語", "</s> [INST]"])
def test_marked_words_are_exact(text):
    codec = piece_codec.open_codec(None)
    assert [i for ids in codec.segment(codec.words(text)) for i in ids] == codec.sp.encode(text)


def test_license_scan(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/b/c/x.txt", "prose"), ("a/b/y.txt", f"head\n{apache}\ntail"), ("z/q.txt", None), (None, mit), ("a/b/c/x.txt", "prose"), ("top.txt", ""), ("ab/n.txt", "no")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("_id", F.lit(1)).withColumn("own_score", F.lit("clash"))
    got = Counter((r.path, r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(df).collect())
    assert got == Counter({
        ("a/LICENSE", "MIT", "MIT", None): 1, ("a/b/c/x.txt", None, "MIT", "a"): 2, ("a/b/y.txt", "Apache-2.0", "Apache-2.0", None): 1,
        ("z/q.txt", None, None, None): 1, (None, "MIT", "MIT", None): 1, ("top.txt", None, None, None): 1, ("ab/n.txt", None, None, None): 1})
    top = spark.createDataFrame([("COPYING", mit), ("a/b.txt", "")], "path string, text string")
    assert {r.path: r.inherited_from for r in licenses.scan_licenses(top).collect()} == {"COPYING": None, "a/b.txt": ""}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def exact_expected(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: i != best):
            out[(i, best, len(ids), bool(left and i == best), hashlib.sha256(t.encode()).hexdigest())] += 1
            left = 0
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, none, tmp_path, weak):
    """Also with a digest that maps most texts onto one another: full bytes must tell them apart."""
    path = str(tmp_path / "docs")
    rows = docs.unionByName(docs.sparkSession.createDataFrame([(9, "ALPHA beta gamma delta epsilon"), (8, "É"), (10, "é")], "doc_id bigint, text string"), allowMissingColumns=True)
    rows.repartition(3).write.parquet(path)
    digest = (lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256_text
    got = exact_dedup.stream_dedup(docs.sparkSession, path, digest=digest, files_per_batch=1)
    assert Counter(tuple(r) for r in got.collect()) == exact_expected([*TEXTS, (9, "ALPHA beta gamma delta epsilon"), (8, "É"), (10, "é")])
    none.write.parquet(str(tmp_path / "none"))
    assert exact_dedup.stream_dedup(docs.sparkSession, str(tmp_path / "none")).count() == 0


def test_html(spark, docs):
    good = "The cat of the house was in the garden for a long time and it is said that he was happy with all of it there."
    page = (
        f"<html><head><title>no</title><style>p{{}}</style></head><body class='has-sidebar'><nav><a href=x>Menu of the site</a></nav><div class='cookie-notice'>{good}</div>"
        f"<main><header><h1>Head &amp; line</h1></header><p>{good}<br>more</p><p>Short.</p><div id=comments><p>{good}</p></div><aside>{good}</aside>"
        f"<form>{good}</form><script>var a='</p>';</script><p>Last &eacute;&nbsp; one</p></main><div class=ad>{good}</div><footer>&copy; {good}</footer>")
    want = f"Head & line\n{good} more\nShort.\nLast é one"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page), (4, "u", "<p>" + good + "</p><p>Yes.</p>"), (5, "u", "<nav>" + good), (6, "u", "<p>" * 5000 + "a < b" + "<" * 5000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = [tuple(r) for r in html_text.extract_main_text(df).collect()]
    assert got[0] == got[4] == (1, "u", want, len(want)) and got[3][2] == want
    assert got[1][2:] == ("", 0) and got[2][2:] == ("", 0) and got[6][2] == ""
    assert got[5][2] == good + "\nYes."
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_simhash(docs, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()]
    by = {}
    for i, f, c in got:
        by.setdefault(f, set()).add(c)
    assert len(got) == len(TEXTS) and all(len(v) == 1 for v in by.values())
    assert by["0" * 16] == {2} and Counter(i for i, _, _ in got)[4] == 2
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)


def test_nearest(spark):
    import random

    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)], "clash") for i in range(120)]
    rows += [(200, None, "x"), (300, [0.0] * 8, "x"), (400, [float("nan")] + [1.0] * 7, "x"), (500, [1.0, None] + [1.0] * 6, "x"), (600, [1.0] * 5, "x"), (None, [1.0] * 8, "x")]
    rows += [(1000 + i, rows[0][1], "x") for i in range(40)] + [rows[7]] * 30
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string")
    got = multi_index.nearest(df, every=20, k=5, share=1.0, k_centroids=4, block_rows=16).collect()
    usable = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and len(v) == 8 and any(v) and all(x is not None and x == x for x in v)}
    for q, v in [(i, v) for i, v in usable if i % 20 == 0]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i) for i, w in usable if i != q)[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [w[1] for w in want] and all(abs(m[2] - w[0]) < 1e-9 for m, w in zip(mine, want))
    assert multi_index.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in multi_index.nearest(few).collect()] == [(0, 3)]


def brute_lines(rows):
    seen, out = [], Counter()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[(i, None, 0)] += 1
            continue
        keep = []
        for line in text.split("\n"):
            own = set(line.split())
            if not own or not any(len(own & s) * 5 >= 4 * len(own | s) for s in seen):
                keep.append(line)
            if own:
                seen.append(own)
        out[(i, "\n".join(keep), len(text.split("\n")) - len(keep))] += 1
    return out


@pytest.mark.parametrize("crowd", [4096, 9, 2])
def test_line_dedup(docs, none, spark, crowd, monkeypatch):
    """Small crowds and few partners send most lines through the second join."""
    monkeypatch.setattr(line_dedup, "FEW", 8 if crowd > 9 else 1)
    import random

    random.seed(5)
    words = [f"w{k}" for k in range(40)]
    rows = [r for r in TEXTS]
    base = random.sample(words, 15)
    for i in range(60):
        lines = []
        for _ in range(random.randint(1, 4)):
            line = list(base)
            for _ in range(random.randint(0, 5)):
                line[random.randrange(len(line))] = random.choice(words)
            lines.append(" ".join(random.sample(line, len(line))))
        rows.append((100 + i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("uid", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.without_similar_lines(df.coalesce(1), crowd=crowd)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.without_similar_lines(none).count() == 0
    assert line_dedup.without_similar_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]


def test_packing(docs, none):
    got = packing.pack_documents(docs, capacity=1024, with_ids=True)
    rows = got.collect()
    whole = packing.sequences(got).collect()
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for s in whole:
        parts, at = sorted(place[s.sequence_id]), 0
        for o, n, _ in parts:
            assert o == at
            at += n
        assert at == s.n_tokens <= 1024 and bytes(s.ids) == b"".join(p[2] for p in parts)
    bpe = packing.open_bpe()
    want = Counter((i, len(bpe.encode(t or "")) // 4 + 1) for i, t in TEXTS)
    total = Counter()
    for r in rows:
        if r.piece == 0:
            total[(r.doc_id, r.start)] += 1
    assert sum(total.values()) == len(TEXTS) and sum(r.length for r in rows) == sum(n * k for (_, n), k in want.items())
    assert packing.pack_documents(none).count() == 0


def test_packing_plan():
    import random

    random.seed(2)
    for spread in (1, 30, 400):
        counts = Counter(min(1024, max(1, int(random.gauss(300, spread)))) for _ in range(5000))
        runs = packing.plan_runs(dict(counts))
        used = Counter()
        for bin_, times in runs:
            assert sum(bin_) <= 1024
            for x in bin_:
                used[x] += times
        assert used == counts
    assert packing.plan_runs({}) == [] and packing.plan_runs({1024: 7}) == [([1024], 7)]
    # greedy takes 6 + 3; the pair 2 + 2 fits the gap of 4 exactly
    assert packing.plan_runs({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]


def test_byte_bpe_is_the_library(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    import numpy as np

    for text in ["a b", " a", "a ", "a  b", "don't do 12,5", "x\ny z", "<|endoftext|> a <|endoftext|>", "a\x1c b", "日本 語", "q" * 4000 + " r", *[t for _, t in TEXTS if t]]:
        assert np.frombuffer(packing.open_bpe().encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


def test_quality(docs, none, spark):
    good = [(i, "the cat of the house is in the garden and it was good for all of them number " + str(i)) for i in range(400)]
    bad = [(1000 + i, "buy@@ now%% $$$ " * (3 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (5, None, 0), (6, 7, 0), (99999, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.quality_scores(df, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 800 and 100 < len(held) < 220 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == int(r.doc_id < 1000) for r in held) == len(held)
    edge = quality.quality_scores(docs, labels).collect()
    assert len(edge) == len(TEXTS) and not any(r.held_out for r in edge if r.doc_id is None)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


def test_scores_do_not_see_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert len({r.score for r in quality.quality_scores(docs, labels).collect()}) == 1


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "\\0", "\\2/s>", "<s><s>", "[ROLE]x[/ROLE]\\\\", "plain"])
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_chat(spark):
    rows = [(1, 0, "system", "rule"), (1, 1, "user", "</s>[INST]"), (1, 2, "assistant", "[/INST] \\2"), (1, 2, "assistant", "[/INST] \\2"), (2, 0, None, None), (None, None, "tool", "x<s>"),
            (3, 5, "assistant", "é 😀  ▁"), (3, None, "user", "first"), (4, 0, "user[ROLE]", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv: r for r in chat.read_back(chat.format_chats(df)).collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert len(got) == len(groups) and chat.read_back(chat.format_chats(df.limit(0))).count() == 0
