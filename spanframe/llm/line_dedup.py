"""Line deduplication by an exact set-similarity join.

A line is its set of tokens. It is removed if an earlier line, by (id, row, line), has a
Jaccard similarity of at least the threshold, kept or not. Steps:

1. Tokens are ordered by rarity: counts of 2^20 token slots over all rows rank the
   slots, and the token hash orders within a slot. The order is total, so the filters below
   are exact for any counts; how well it sorts by rarity only decides speed.
2. Every line gives its size, the digest of its token set and its prefix, the rarest
   tokens that two similar lines cannot both lack. Lines of one digest collapse onto the
   earliest, combined map-side, so a line that a third of the table repeats is one row.
3. Prefix tokens of the remaining lines are sorted by (token, line) and stream past. Lines of
   a token are compared in the stream. Length and position filters and a 64-bit parity
   bitmap of the tokens (it differs in at most as many bits as the sets in tokens) discard
   all but likely pairs before they leave the task. A line sends its first few likely
   partners only; of over ``crowd`` lines of a token each meets the earliest first.
4. Survivors are verified on the true tokens. A line that had more partners than it sent, and
   no match among those, then meets all earlier lines of its token by a join under the same
   filters. Near copies match at once, so crowds of them are never paired off.
5. Removed lines are taken out of their texts. Only rows that lose lines are shuffled.

The input must be a plan that gives the same rows when read again: a table or a
checkpoint. Rows are told apart by their place in it; a hash of each text guards this.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.ranking import attach_group
from spanframe.llm.common import bounded_batches, slot_marks, written
from spanframe.llm.registry import query, table
from spanframe.session import durable

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
REST = 64 - SLOT_BITS
LOW = (1 << REST) - 1
FILTER_BITS = 22
_ONE, _LAST = np.uint64(1), np.uint64(63)
MEMO_WORDS = 100_000
BLOCK_WORDS = 250_000
THRESHOLD = 0.8
HOT = 100_000
CROWD = 4096
FEW = 8


def slot_ranks(rows: DataFrame) -> np.ndarray:
    """Rank of each token slot by how often its tokens occur, counted over all rows.

    The ranks only order the tokens, which decides speed: the join is exact in any order.
    """

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        seen: Counter = Counter()

        def pour():
            h = _token_hashes(seen)
            total[:] += np.bincount((h >> np.uint64(REST)).astype(np.int64), np.fromiter(seen.values(), np.float64, len(seen)), SLOTS).astype(np.int64)
            seen.clear()

        for b in batches:
            for text in b.column(0):
                seen.update((text.as_py() or "").split())
                if len(seen) > MEMO_WORDS:
                    pour()
        pour()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    counted = rows.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most SLOTS rows
    n = np.zeros(SLOTS, np.int64)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    ranks = np.empty(SLOTS, np.int32)
    ranks[np.argsort(n, kind="stable")] = np.arange(SLOTS, dtype=np.int32)
    return ranks


def _token_hashes(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def _mixed(k: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of each key; sums of it over a set do not depend on the order."""
    z = k + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def signed_lines(rows: DataFrame, ranks: np.ndarray, t: Fraction) -> DataFrame:
    """(id, uid, line, n, digest, h, sig, prefix) of each line that has tokens."""
    kind = rows.schema["id"].dataType.simpleString()

    def sign(b, at, line_no, hashes, words, sizes):
        """One batch of lines from the tokens of a block, all of it in arrays."""
        codes = _Codes()
        coded = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        h = _token_hashes(codes)
        keys = (ranks[(h >> np.uint64(REST)).astype(np.int64)].astype(np.uint64) << np.uint64(REST)) | (h & np.uint64(LOW))
        by_key = np.argsort(keys)
        rank = np.empty(len(keys), np.uint64)
        rank[by_key] = np.arange(len(keys), dtype=np.uint64)
        both = (np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32)) | rank[coded]
        both = np.unique(both)  # each line's distinct tokens, rarest first
        line = (both >> np.uint64(32)).astype(np.int64)
        own = keys[by_key][(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        n = np.bincount(line, minlength=len(sizes))
        starts = np.cumsum(n) - n
        digest = np.stack([np.add.reduceat(_mixed(own, salt), starts) for salt in (0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D)], axis=1)
        sig = np.bitwise_xor.reduceat(_ONE << (own & _LAST), starts)
        size = n + (-n * t.numerator // t.denominator) + 1  # two similar lines share a token among so many
        first = np.arange(len(own)) - starts[line] < size[line]
        at = pa.array(at, pa.int64())
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(digest).tobytes())])
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array(line_no, pa.int32()), pa.array(n, pa.int32()), packed.cast(pa.binary()), pa.array(hashes, pa.int64()), pa.array(sig.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(own[first].view(np.int64)))],
            names=["id", "uid", "line", "n", "digest", "h", "sig", "prefix"])

    def run(batches):
        for b in batches:
            block: tuple[list, ...] = ([], [], [], [], [])
            for row, text in enumerate(b.column(2)):
                text = text.as_py()
                if not text:
                    continue
                at, line_no, hashes, words, sizes = block
                h = xxhash.xxh64_intdigest(text.encode()) >> 1
                for k, line in enumerate(text.split("\n")):
                    tokens = line.split()
                    if tokens:
                        at.append(row)
                        line_no.append(k)
                        hashes.append(h)
                        words += tokens
                        sizes.append(len(tokens))
                if len(words) > BLOCK_WORDS:
                    yield sign(b, *block)
                    block = ([], [], [], [], [])
            if block[0]:
                yield sign(b, *block)

    return rows.mapInArrow(run, f"id {kind}, uid bigint, line int, n int, digest binary, h bigint, sig bigint, prefix array<bigint>")


def _need(total, t: Fraction):
    """Least overlap of two sets with ``total`` members in all."""
    return -(-total * t.numerator // (t.numerator + t.denominator))


def _likely(col: dict, i: np.ndarray, j: np.ndarray, hub: dict, t: Fraction) -> np.ndarray:
    """Which entries ``i`` of ``col`` and ``j`` of ``hub`` with one token pass length, position and bitmap."""
    nx, ny = col["n"][i], hub["n"][j]
    need = _need(nx + ny, t)
    ok = (ny * t.denominator >= nx * t.numerator) & (nx * t.denominator >= ny * t.numerator)
    ok &= np.minimum(nx - col["pos"][i], ny - hub["pos"][j]) >= need
    ok &= np.bitwise_count(col["sig"][i] ^ hub["sig"][j]) <= nx + ny - 2 * need
    return ok


def meet_earlier(entries: DataFrame, t: Fraction, crowd: int = CROWD) -> DataFrame:
    """Walks entries sorted by token and line. Rows with ``y_uid`` pair a line with an earlier one
    of its token. Rows with ``token`` are the members of tokens where some line has more
    partners than it sent; ``rest`` marks those lines."""
    kind = entries.schema["id"].dataType.simpleString()
    names = ["id", "token", "uid", "line", "n", "pos", "sig"]

    def numbers(table: pa.Table) -> dict:
        col = {c: table.column(c).to_numpy() for c in names[1:]}
        return col | {"n": col["n"].astype(np.int64), "sig": col["sig"].view(np.uint64)}

    def rows(table: pa.Table, col: dict, i: np.ndarray, hub: dict, j: np.ndarray, members: np.ndarray, rest: np.ndarray):
        at = pa.array(np.concatenate([i, members]).astype(np.int64))
        paired = np.arange(len(at)) < len(i)
        out = table.select(names[:1] + names[2:]).take(at).combine_chunks()
        none = np.zeros(len(members), np.int64)
        return pa.RecordBatch.from_arrays(
            [*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns], pa.array(np.concatenate([col["token"][i], col["token"][members]]), mask=paired),
             pa.array(np.concatenate([hub["uid"][j], none]), mask=~paired), pa.array(np.concatenate([hub["line"][j], none.astype(np.int32)]), mask=~paired), pa.array(np.concatenate([np.zeros(len(i), bool), rest]))],
            names=[*names[:1], *names[2:], "token", "y_uid", "y_line", "rest"])

    def crowded(table, col, members, hub):
        """Members of one crowd against its first entry."""
        j = np.zeros(len(members), np.int64)
        ok = _likely(col, members, j, hub, t)
        return rows(table, col, members[ok], hub, j[ok], members, np.ones(len(members), bool))

    def crossed(table, col, first, last):
        """The runs among the first ``last`` entries: each line against those before it."""
        depth = np.arange(last) - first[:last]
        i, d = np.flatnonzero(depth >= 1), 1
        sent, more, found = np.zeros(last, np.int64), np.zeros(last, bool), ([], [])
        while len(i):
            ok = i[_likely(col, i, i - d, col, t)]
            found[0].append(ok)
            found[1].append(ok - d)
            sent[ok] += 1
            i = i[depth[i] > d]
            stop = sent[i] >= FEW
            more[i[stop]] = True
            i, d = i[~stop], d + 1
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        members = np.flatnonzero(np.isin(first[:last], first[:last][more]))
        return rows(table, col, i, col, j, members, more[members])

    def run(batches):
        held, hub = None, None  # entries of an unfinished run; the first of an unfinished crowd
        for b in batches:
            table = pa.Table.from_batches([b.select(names)])
            col = numbers(table)
            if hub is not None:
                m = int(np.argmin(np.append(col["token"] == hub["token"][0], False)))
                if m:
                    yield crowded(table, col, np.arange(m), hub)
                if m == len(table):
                    continue
                hub, table = None, table.slice(m)
            if held is not None:
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            col = numbers(table)
            token, n = col["token"], len(table)
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            first = np.repeat(starts, np.diff(np.append(starts, n)))
            lengths = np.diff(np.append(starts, n))
            big = lengths > crowd
            for s, k in zip(starts[big].tolist(), lengths[big].tolist()):
                yield crowded(table, col, np.arange(s + 1, s + k), {c: v[s : s + 1] for c, v in col.items()})
            last = int(starts[-1])
            alone = first.copy()
            in_crowd = np.repeat(big, lengths)
            alone[in_crowd] = np.arange(n)[in_crowd]
            yield crossed(table, col, alone, last)
            held, hub = (None, {c: v[last : last + 1].copy() for c, v in col.items()}) if big[-1] else (table.slice(last), None)
        if held is not None:
            held = held.combine_chunks()
            yield crossed(held, numbers(held), np.zeros(len(held), np.int64), len(held))

    dealt = entries.repartition("token").sortWithinPartitions("token", "id", "uid", "line")
    return dealt.mapInArrow(run, f"id {kind}, uid bigint, line int, n int, pos int, sig bigint, token bigint, y_uid bigint, y_line int, rest boolean")


def _slot_of(uid, line):
    return ((uid & 0x3FFFFF) * 40503 + (uid >> 33) * 7919 + line * 31) & ((1 << FILTER_BITS) - 1)


def _slot_column(uid: Column, line: Column) -> Column:
    low = uid.bitwiseAND(F.lit(0x3FFFFF)) * 40503
    return (low + F.shiftright(uid, 33) * 7919 + line.cast("bigint") * 31).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def line_tokens(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, line, tokens) of lines that may be wanted: a bitmap of 2^22 bits goes to the readers."""
    slots = wanted.select(_slot_column(F.col("uid"), F.col("line")).alias("s"))
    words = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("b")).toArrow()  # at most 131,072 rows
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)

    def run(batches):
        for b in batches:
            out = ([], [], [])
            for uid, text in zip(b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                if not text:
                    continue
                lines = text.split("\n")
                s = _slot_of(np.int64(uid), np.arange(len(lines), dtype=np.int64))
                for k in np.flatnonzero((bits[s >> 5] >> (s & 31).astype(np.uint32)) & 1).tolist():
                    tokens = set(lines[k].split())
                    if tokens:
                        for column, v in zip(out, (uid, k, " ".join(tokens))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["uid", "line", "tokens"])

    return rows.mapInArrow(run, "uid bigint, line int, tokens string")


def verified(rows: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """Lines (uid, line) of pairs whose true Jaccard similarity reaches the threshold."""
    pairs = written(pairs.select("uid", "line", "y_uid", "y_line").distinct(), "lines-pairs")
    wanted = pairs.select("uid", "line").unionByName(pairs.select(F.col("y_uid").alias("uid"), F.col("y_line").alias("line")))
    tokens = line_tokens(rows, wanted)
    left = pairs.join(tokens.withColumnRenamed("tokens", "x"), ["uid", "line"])
    both = left.join(tokens.select(F.col("uid").alias("y_uid"), F.col("line").alias("y_line"), F.col("tokens").alias("y")), ["y_uid", "y_line"])
    p, q = t.numerator, t.denominator

    def judge(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
                a, c = set(x.split(" ")), set(y.split(" "))
                if len(a & c) * (p + q) >= p * (len(a) + len(c)):
                    keep.append(i)
            yield b.select(["uid", "line"]).take(pa.array(keep, pa.int64()))

    return both.select("uid", "line", "x", "y").mapInArrow(judge, "uid bigint, line int").distinct()


def removed_lines(rows: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """(uid, lines to take out, h) of the rows (id, uid, text) that lose lines."""
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("threshold must be in (0, 1]")
    lines = written(signed_lines(rows, slot_ranks(rows), t), "lines")
    place = F.struct("id", "uid", "line")
    reps = lines.groupBy("digest").agg(F.min(place).alias("at"), *[F.first(c).alias(c) for c in ("n", "sig", "prefix")])
    entries = reps.select("at.id", "at.uid", "at.line", "n", "sig", F.posexplode("prefix").alias("pos", "token"))
    met = written(meet_earlier(entries, t, crowd), "lines-met")
    first = durable(verified(rows, met.filter("y_uid is not null"), t))
    others = met.filter("token is not null").select("id", "token", "uid", "line", "n", "pos", "sig", "rest")
    open_ = others.filter("rest").join(first, ["uid", "line"], "left_anti")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    p, q = t.numerator, t.denominator
    total = x("n") + y("n")
    need = F.ceil(total * p / F.lit(float(p + q)) - 1e-9)
    near = (
        (y("n") * q >= x("n") * p) & (x("n") * q >= y("n") * p) & (F.least(x("n") - x("pos"), y("n") - y("pos")) >= need)
        & (F.bit_count(x("sig").bitwiseXOR(y("sig"))) <= total - 2 * need)
    )
    earlier = F.struct(y("id"), y("uid"), y("line")) < F.struct(x("id"), x("uid"), x("line"))
    pairs = open_.alias("x").join(others.alias("y"), (x("token") == y("token")) & earlier & near)
    second = verified(rows, pairs.select(x("uid").alias("uid"), x("line").alias("line"), y("uid").alias("y_uid"), y("line").alias("y_line")), t)
    matched = first.unionByName(second)
    earliest = written(lines.groupBy("digest").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "lines-repeated")
    later = attach_group(lines.select("digest", "id", "uid", "line", "h"), earliest, ["digest"], "k", HOT, send_hot=True).filter((F.col("at.uid") != F.col("uid")) | (F.col("at.line") != F.col("line")))
    like = lines.select("uid", "line", "h").join(matched, ["uid", "line"])
    gone = later.select("uid", "line", "h").unionByName(like)
    return gone.groupBy("uid").agg(F.collect_set("line").alias("gone"), F.max("h").alias("h"))


def without_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """``docs`` with near-repeated lines taken out of the text; adds n_lines and n_removed.

    Lines end at line feeds; tokens are what white space separates; a line without tokens
    stays and matches none. A text that loses all lines becomes empty; a null text stays
    null and has no lines. Rows may repeat or lack their id: each is a row of its own, a
    null id is earlier than others, and equal ids go by place in the table. All columns
    stay, whatever their names; those called n_lines and n_removed are replaced. An empty
    table gives no rows.
    """
    placed = docs.withColumn("_line_uid", F.monotonically_increasing_id())
    rows = placed.select(F.col(id_col).alias("id"), F.col("_line_uid").alias("uid"), F.col(text_col).cast("string").alias("text"))
    with bounded_batches(docs.sparkSession):
        gone = durable(removed_lines(rows, threshold, crowd))
    keys = gone.select(F.col("uid").alias("_line_uid"), F.col("gone").alias("_line_gone"), F.col("h").alias("_line_h"))

    def strip(text: pd.Series, gone: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for body, lines, mark in zip(text, gone, h):
            if xxhash.xxh64_intdigest(body.encode()) >> 1 != mark:
                raise RuntimeError("the input gave other rows when read again")
            drop = set(lines)
            out.append("\n".join(x for k, x in enumerate(body.split("\n")) if k not in drop))
        return pd.Series(out)

    stripped = F.pandas_udf(strip, "string")
    lines = F.coalesce(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    likely, others = _split(placed, gone)
    hit = likely.join(keys, "_line_uid", "left")
    changed = hit.filter("_line_gone is not null").withColumn("n_lines", lines).withColumn("n_removed", F.size("_line_gone").cast("bigint")).withColumn(
        text_col, stripped(F.col(text_col), F.col("_line_gone"), F.col("_line_h")))
    same = hit.filter("_line_gone is null").drop("_line_gone", "_line_h").unionByName(others).withColumn("n_lines", lines).withColumn("n_removed", F.lit(0).cast("bigint"))
    columns = [*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    return changed.select(*[F.col(f"`{c}`") for c in columns]).unionByName(same.select(*[F.col(f"`{c}`") for c in columns]))


def _split(placed: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may lose lines, and the rest, which stay where they were read."""
    marked = slot_marks(placed, "_line_uid", gone, "uid")
    return marked.filter("_marked").drop("_marked"), marked.filter("not _marked").drop("_marked")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = without_similar_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
