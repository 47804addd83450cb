"""Phrase collocations by three-way sorting of suffixes.

Every word is the start of a suffix, and a phrase's count is the number of suffixes that
begin with it. Suffixes are cut to the depth that is asked for, equal ones of a block of
text are added up, and the sums are routed by their leading words, so that all of a
phrase meet in one task and no phrase sends more than one row per block. There a
multikey three-way quicksort orders pointers to them: it splits by the word at one depth
into smaller, equal and larger, goes deeper in the equal part, and the size of the equal
part is the count of the phrase. Parts below the least count are abandoned.

Two rounds: the first to depth two counts words and pairs; the second to depth three
reads the texts again and takes only suffixes whose two pairs may both be frequent, by
a bitmap of fixed size (a longer phrase is never more frequent than its parts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.ranking import rank_in_group
from spanframe.llm.common import partitions, written
from spanframe.llm.registry import query, table

LEAST, TOP = 10, 2000
#: Words of a block that is added up before it is routed.
BLOCK_WORDS = 1 << 21
#: Bits of the bitmap of frequent pairs: 1 MB whatever the corpus; a full bitmap only lets more through.
FILTER_BITS = 23
#: Routes per shuffle partition.
ROUTES = 4
#: Ends a piece. No byte of UTF-8 has this value.
END = b"\xff"
PLAIN = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of two hashes; the same words hash alike in every task."""
    x = (first ^ (second + MIX)) * MIX
    return (x ^ (x >> np.uint64(29))) * MIX


def three_way(keys: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to rows of ``keys``.

    Yields (depth, one row of each equal part, its weight) for the parts of at least
    ``least``; smaller parts are left unsorted. All open parts of a round are split
    together, by the median of three of each, so a round is a few array operations.
    """
    rows = np.arange(len(weights))
    starts = np.zeros(1 if len(rows) else 0, np.int64)
    depth = np.zeros(len(starts), np.int64)
    table_ = np.stack(keys) if len(rows) else np.zeros((len(keys), 0), np.int64)
    while len(starts):
        ends = np.append(starts[1:], len(rows))
        sizes = ends - starts
        part = np.repeat(np.arange(len(starts)), sizes)
        at = depth[part]
        key = table_[at, rows]
        three = np.sort(np.stack([key[starts], key[starts + sizes // 2], key[ends - 1]]), axis=0)
        side = np.sign(key - three[1][part]) + 1  # 0 smaller, 1 equal, 2 larger
        own = part * 3 + side
        order = np.argsort(own, kind="stable")
        rows, own = rows[order], own[order]
        weight = np.bincount(own, weights[rows], minlength=3 * len(starts)).astype(np.int64)
        count = np.bincount(own, minlength=3 * len(starts))
        first = np.cumsum(count) - count
        level = np.repeat(depth, 3)
        open_ = weight >= least
        equal = open_ & (np.arange(len(weight)) % 3 == 1)
        for d in range(len(keys)):
            done = equal & (level == d)
            if done.any():
                yield d + 1, rows[first[done]], weight[done]
        level = level + equal
        open_ &= (level < len(keys)) & (count > 0)
        rows = rows[open_[own]]
        depth = level[open_]
        starts = np.cumsum(count[open_]) - count[open_]


class Block:
    """Words of some texts of one language as numbers, -1 at the end of a piece."""

    def __init__(self, texts: list[bytes]):
        words = END.join(texts).translate(PLAIN).replace(END, b" " + END + b" ").split()
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.words = np.array(coded.dictionary.to_pylist(), dtype=object)
        codes = coded.indices.to_numpy().astype(np.int64)
        ends = np.flatnonzero(self.words == END)
        self.codes = np.where(codes == ends[0], -1, codes) if len(ends) else codes
        self.codes = np.concatenate([self.codes, [-1, -1, -1]])
        self.hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in self.words], np.uint64)

    def suffixes(self, depth: int, wanted: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct suffixes cut to ``depth``: their words (-1: none), how often, and their route hash.

        At depth two a suffix also counts its single word; at depth three only suffixes of
        three words count, of which both pairs are ``wanted``.
        """
        c = self.codes
        a, b = c[:-2], c[1:-1]
        pair = (a >= 0) & (b >= 0)
        n = len(self.words)
        if depth == 2:
            singles = np.bincount(a[a >= 0], minlength=n)
            one = np.flatnonzero(singles)
            both, times = np.unique(a[pair] * n + b[pair], return_counts=True)
            two = [both // n, both % n]
            words = [np.concatenate([one, two[0]]), np.concatenate([np.full(len(one), -1), two[1]])]
            return words, np.concatenate([singles[one], times]), np.concatenate([self.hashes[one], chain(self.hashes[two[0]], self.hashes[two[1]])])
        slot = np.zeros(len(a), np.int64)
        slot[pair] = (chain(self.hashes[a[pair]], self.hashes[b[pair]]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        likely = pair & ((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(likely[:-1] & likely[1:])
        both, which = np.unique(a[at] * n + b[at], return_inverse=True)
        three, times = np.unique(which * n + c[at + 2], return_counts=True)
        words = [both[three // n] // n, both[three // n] % n, three % n]
        h = chain(chain(self.hashes[words[0]], self.hashes[words[1]]), self.hashes[words[2]])
        return words, times, h


def route_kernel(depth: int, routes: int, wanted: np.ndarray | None = None, block_words: int = BLOCK_WORDS):
    """(lang, text) -> (lang, route, words, w1, w2, ..., times): the summed suffixes of a block."""

    def flush(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        block = Block(texts)
        words, times, h = block.suffixes(depth, wanted)
        route = (h % np.uint64(routes)).astype(np.int64)
        order = np.argsort(route, kind="stable")
        cuts = np.flatnonzero(np.diff(route[order], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            mine = order[lo:hi]
            used, local = np.unique(np.concatenate([w[mine] for w in words]), return_inverse=True)
            none = int(len(used) and used[0] == -1)  # numbers of the words sent along, -1 stays
            spelled = b" ".join(block.words[used[none:]].tolist()).decode()
            parts = (local - none).reshape(depth, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([int(route[mine[0]])], pa.int32()), pa.array([spelled])]
                + [pa.array([p], pa.list_(pa.int32())) for p in (*parts, times[mine])],
                names=["lang", "route", "words", *[f"w{d}" for d in range(depth)], "times"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                texts, size = held.setdefault(lang, ([], 0))
                texts.append(text)
                held[lang] = (texts, size + len(text))
                if size + len(text) >= 6 * block_words or sum(s for _, s in held.values()) >= 12 * block_words:
                    largest = max(held, key=lambda k: held[k][1])
                    yield from flush(largest, held.pop(largest)[0])
        for lang, (texts, _) in held.items():
            yield from flush(lang, texts)

    return run


def count_kernel(depth: int, least: int):
    """All rows of one (lang, route) -> (lang, depth, w1, ..., f, slot): phrases of at least ``least``.

    In the first round also (lang, 0, f): all occurrences of the words of this route.
    """

    def run(group: pa.Table) -> pa.Table:
        lang = group["lang"][0].as_py()
        lists = [w.encode().split(b" ") for w in group["words"].to_pylist()]
        flat = pa.array([w for own in lists for w in own], pa.binary()).dictionary_encode()
        codes, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        shift = np.cumsum([0, *map(len, lists[:-1])])
        columns = [group[f"w{d}"].combine_chunks() for d in range(depth)]
        per = np.diff(columns[0].offsets.to_numpy())
        offset = np.repeat(shift, per)
        keys = []
        for col in columns:
            local = col.flatten().to_numpy().astype(np.int64)
            keys.append(np.where(local < 0, -1, codes[np.maximum(local, 0) + offset]))
        times = group["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        out = [[] for _ in range(depth + 2)]
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in names.to_pylist()], np.uint64)
        for level, rows, weight in three_way(keys, times, least):
            if level < depth:
                continue  # shorter beginnings meet here only in part
            out[0].append(weight)
            out[1].append(
                chain(hashes[keys[0][rows]], hashes[keys[1][rows]]).view(np.int64) if depth == 2 else np.zeros(len(rows), np.int64)
            )
            for d in range(depth):
                out[2 + d].append(keys[d][rows])
        weight, h, *found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        texts = [names.take(pa.array(k, mask=k < 0)).cast(pa.string()) for k in found]
        size = pa.array(np.full(len(weight), depth) - (found[1] < 0), pa.int32())
        table_ = [pa.array([lang] * len(weight), pa.string()), size, *texts, pa.array(weight), pa.array(h)]
        total = int(times[keys[1] < 0].sum()) if depth == 2 else 0
        if total:
            row = [pa.array([lang]), pa.array([0], pa.int32()), *[pa.nulls(1, pa.string())] * depth, pa.array([total]), pa.array([0])]
            table_ = [pa.concat_arrays([x, y]) for x, y in zip(table_, row)]
        return pa.table(table_, names=["lang", "depth", *[f"w{d}" for d in range(depth)], "f", "h"])

    return run


def counted(rows: DataFrame, depth: int, least: int, routes: int, wanted: np.ndarray | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    names = [f"w{d}" for d in range(depth)]
    sent = rows.mapInArrow(
        route_kernel(depth, routes, wanted, block_words),
        "lang string, route int, words string, " + ", ".join(f"{w} array<int>" for w in names) + ", times array<int>",
    )
    schema = "lang string, depth int, " + ", ".join(f"{w} string" for w in names) + ", f bigint, h bigint"
    return sent.groupBy("lang", "route").applyInArrow(count_kernel(depth, least), schema)


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Bits of the slots of all pairs: at most 2^FILTER_BITS / 64 rows come to the driver."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = pairs.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for part in words.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.view(np.uint8)


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two or three words.

    A null text counts as empty, a null language as ``und``. Ties go to the larger count, then to
    the phrase that comes first byte by byte, so ranks are unique. Repeated rows count
    each. Empty texts, and an empty table, give no phrase. Other columns are not read.
    ``docs`` is read twice. A text may be of any length up to what one row holds.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).filter("text <> ''")
    routes = partitions(spark) * ROUTES
    short = written(counted(rows, 2, least, routes, None, block_words), "phrases-2")
    total = short.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = short.filter("depth = 1").select("lang", F.col("w0").alias("w"), "f")
    pairs = short.filter("depth = 2")
    long = written(counted(rows, 3, least, routes, pair_bitmap(pairs), block_words), "phrases-3")
    pairs = pairs.select("lang", "w0", "w1", F.col("f").alias("a"))
    triples = long.select("lang", "w0", "w1", "w2", F.col("f").alias("a"))

    single = lambda w, name: words.select("lang", F.col("w").alias(w), F.col("f").alias(name))
    double = lambda x, y, name: pairs.select("lang", F.col("w0").alias(x), F.col("w1").alias(y), F.col("a").alias(name))
    inside = triples.select("lang", "a", F.explode(F.array(F.struct(F.col("w0").alias("x"), F.col("w1").alias("y")), F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")))).alias("p"))
    inside = inside.groupBy("lang", F.col("p.x").alias("w0"), F.col("p.y").alias("w1")).agg(F.max("a").alias("longer"))
    two = pairs.join(single("w0", "l"), ["lang", "w0"]).join(single("w1", "r"), ["lang", "w1"]).join(inside, ["lang", "w0", "w1"], "left")
    two = two.filter("longer is null or 100 * longer < 50 * a").select(
        "lang", F.concat_ws(" ", "w0", "w1").alias("phrase"), "a", "l", "r", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = triples.join(single("w0", "l1"), ["lang", "w0"]).join(single("w2", "r2"), ["lang", "w2"])
    three = three.join(double("w1", "w2", "r1"), ["lang", "w1", "w2"]).join(double("w0", "w1", "l2"), ["lang", "w0", "w1"])
    s1, s2 = exact_score(F.col("a"), F.col("l1"), F.col("r1")), exact_score(F.col("a"), F.col("l2"), F.col("r2"))
    first = s1 <= s2
    three = three.select(
        "lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "a",
        F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least(s1, s2).alias("score"))
    ranked = rank_in_group(two.unionByName(three), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")]).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select(F.col("lang").alias(lang_col), "rank", "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations", r"""
with piece as (select coalesce(lang, 'und') as lang, row_number() over () as p, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents),
listed as (select row_number() over () as p, lang, regexp_extract_all(t, '[^\x20\x09]+') as ws from piece),
word as (select p, lang, unnest(ws) as w0, generate_subscripts(ws, 1) as k from listed),
suffix as (select lang, w0, lead(w0) over s as w1, lead(w0, 2) over s as w2 from word window s as (partition by p order by k)),
total as (select lang, count(*) as n from suffix group by lang),
f1 as (select lang, w0, count(*) as f from suffix group by all),
f2 as (select lang, w0, w1, count(*) as f from suffix where w1 is not null group by all having count(*) >= 10),
f3 as (select lang, w0, w1, w2, count(*) as f from suffix where w2 is not null group by all having count(*) >= 10),
two as (select x.lang, x.w0 || ' ' || x.w1 as phrase, x.f as a, l.f as l, r.f as r, (1000000::hugeint * x.f * x.f) // (l.f::hugeint * r.f) as score
  from f2 x join f1 l on l.lang = x.lang and l.w0 = x.w0 join f1 r on r.lang = x.lang and r.w0 = x.w1
  where not exists (select 1 from f3 y where y.lang = x.lang and (y.w0 = x.w0 and y.w1 = x.w1 or y.w1 = x.w0 and y.w2 = x.w1) and 100 * y.f >= 50 * x.f)),
cut as (select x.lang, x.w0 || ' ' || x.w1 || ' ' || x.w2 as phrase, x.f as a, unnest([
    {'k': 1, 'l': l1.f, 'r': r1.f, 's': (1000000::hugeint * x.f * x.f) // (l1.f::hugeint * r1.f)},
    {'k': 2, 'l': l2.f, 'r': r2.f, 's': (1000000::hugeint * x.f * x.f) // (l2.f::hugeint * r2.f)}]) as c
  from f3 x join f1 l1 on l1.lang = x.lang and l1.w0 = x.w0 join f2 r1 on r1.lang = x.lang and r1.w0 = x.w1 and r1.w1 = x.w2
  join f2 l2 on l2.lang = x.lang and l2.w0 = x.w0 and l2.w1 = x.w1 join f1 r2 on r2.lang = x.lang and r2.w0 = x.w2),
three as (select lang, phrase, a, c.l as l, c.r as r, c.s as score from cut qualify row_number() over (partition by lang, phrase order by c.s, c.k) = 1),
both_ as (select * from two union all select * from three),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from both_)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))
