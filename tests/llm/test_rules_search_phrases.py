"""op11, op12 and op13 on small inputs against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanframe.llm import collocations as co
from spanframe.llm import divergence as dv
from spanframe.llm import lexical as lx

SCHEMA = "doc_id bigint, lang string, text string, w0 string, words string, rest string, doc string, n bigint, route int, times string"


def docs(spark, rows):
    """Extra columns carry names that the operators use themselves."""
    return spark.createDataFrame([(i, lang, t, "x", "x", "x", "x", 1, 1, "x") for i, lang, t in rows], SCHEMA)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [
    (1, "en", None), (2, "en", ""), (3, None, " \t\n\x0b\x0c\r "), (4, "en", "a b c a b c a"), (4, "en", "a b c a b c a"), (None, "en", "x y"), (5, "en", "a a a a a"),
    (6, "en", "one|two ## $\nsame line\nsame line\n same line\n\n"), (7, "de", "é ü ß é ü ß é"), (8, "en", "w " * 3000 + "end"), (9, "xx", "A b\x0bC d\x85e"),
]


def test_counts_of_rules(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in dv.divergence_rules(docs(spark, ODD)).collect())
    want = Counter()
    for i, _, t in ODD:
        c = counts_of(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert dv.divergence_rules(docs(spark, [])).count() == 0


def test_divergence_tells_languages_apart(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice(["the", "of", *(f"w{rng.randrange(10**6)}" for _ in range(3))]) for _ in range(120)) + "." for _ in range(60)]
    odd = [" ".join("#%&*" + str(rng.randrange(10**6)) for _ in range(120))]
    short = ["#%&* " * 5]
    rows = [(i, "en", t) for i, t in enumerate(prose + odd + short)]
    out = {r.doc_id: r for r in dv.divergence_rules(docs(spark, rows)).collect()}
    assert all(out[i].kept for i in range(60)) and not out[60].kept and not out[60].base_failed
    assert out[61].class_distance is None and out[61].word_distance is None and out[61].base_failed

    def js(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
        return math.sqrt((part(p) + part(q)) / 2)

    totals = Counter(w for _, _, t in rows for w in t.split())
    common = sorted(totals, key=lambda w: (-totals[w], w))[: dv.COMMON]
    hist = lambda c: np.array([*(c[w] for w in common), sum(c.values()) - sum(c[w] for w in common)]) / sum(c.values())
    assert out[0].word_distance == pytest.approx(js(hist(Counter(prose[0].split())), hist(totals)))


def test_language_with_little_text_has_no_reference(spark):
    rows = [(i, "en", "the of and " * 400) for i in range(4)] + [(9, "tiny", "a " * 60)]
    out = {r.doc_id: r for r in dv.divergence_rules(docs(spark, rows), share=10).collect()}
    assert out[9].word_distance is None and out[9].class_distance is None and out[1].word_distance is not None


def brute_search(rows, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    bags = [(i, terms(t)) for i, _, t in rows]
    bags = [(i, len(b), Counter(b)) for i, b in bags if b]
    n_docs, total, out = len(bags), sum(n for _, n, _ in bags), []
    df = Counter(t for _, _, c in bags for t in c)
    for item, text in items:
        scored = []
        for i, n, c in bags:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("block_terms", [1 << 14, 7])
def test_ranked_search(spark, block_terms):
    """A block of seven terms holds one item or two, so the table is read several times."""
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "The", "of", "é1", f"q{rng.randrange(40)}"])
    rows = [(i, "en", " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(5, "en", rows[5][2]), (None, "en", rows[6][2]), (None, "en", None), (200, "en", ""), (201, "en", "!? ..."), (202, "en", "the " * 4000)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(12)] + [(90, None), (91, "..."), (92, "unseen"), (93, "the the THE of")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter(tuple(r) for r in lx.ranked_search(docs(spark, rows), table, block_terms=block_terms).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(rows, items)
    assert lx.ranked_search(docs(spark, []), table).count() == 0 == lx.ranked_search(docs(spark, rows), table.limit(0)).count()


def test_sharing_graph_sums_every_item():
    rng = random.Random(3)
    bags = [dict(Counter(rng.randrange(30) for _ in range(rng.randrange(0, 25)))) for _ in range(60)]
    dag = lx.SharingDag(bags, 30)
    x = np.random.default_rng(4).integers(0, 1000, (30, 7))
    sums = dag.partial_sums(x)
    for i, bag in enumerate(bags):
        assert (dag.item_sums(sums, i) == sum((m * x[t] for t, m in bag.items()), np.zeros(7, np.int64))).all()
    assert dag.joins and sum(map(len, dag.items)) + len(dag.joins) < sum(map(len, bags))  # fewer additions than without sharing


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in (1, 2, 3):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block_words,top", [(1 << 21, 2000), (16, 5)])
def test_collocations(spark, block_words, top):
    """Small blocks send one phrase from many places."""
    rng = random.Random(5)
    word = lambda: rng.choice(["of", "The", "a", "é", "\x00", "z ", f"v{rng.randrange(12)}"])
    text = lambda k: "".join(word() + rng.choice([" ", " ", "\t ", ", ", ".", "\r\n", "\x0b"]) for _ in range(k))
    rows = [(i, rng.choice(["en", "en", "de", None]), text(rng.randrange(0, 60))) for i in range(150)]
    rows += [(1, "en", None), (None, "en", ""), (2, "xx", " .,; \n"), (3, "und", "new york city new york " * 300), (3, "und", "new york city new york " * 300)]
    out = co.collocations(docs(spark, rows), least=3, top=top, block_words=block_words)
    assert sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, 3, top)
    assert co.collocations(docs(spark, [])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12
    row = spark.createDataFrame([(big, big + 7, big + 1)], "a bigint, l bigint, r bigint").select(co.exact_score(*(dv.F.col(c) for c in "alr")).alias("s")).first()
    assert row.s == 10**6 * big * big // ((big + 7) * (big + 1))


def test_three_way_sort_counts_parts():
    rng = np.random.default_rng(6)
    keys, weights = [rng.integers(0, 9, 4000) for _ in range(3)], rng.integers(1, 4, 4000)
    want = Counter()
    for row, w in zip(zip(*(k.tolist() for k in keys)), weights.tolist()):
        for d in (1, 2, 3):
            want[row[:d]] += w
    got = {}
    for depth, rows, weight in co.three_way(keys, weights, 25):
        for i, w in zip(rows.tolist(), weight.tolist()):
            got[tuple(int(k[i]) for k in keys[:depth])] = w
    assert got == {p: w for p, w in want.items() if w >= 25}
    assert list(co.three_way([np.zeros(0, np.int64)] * 2, np.zeros(0, np.int64), 1)) == []
