"""Ranked lexical search of many items at once, sharing what they have in common.

Items are bags of terms. Terms that the same items hold form one node; then the pair of
nodes that most items share is replaced by a node of its own, again and again. What
comes out is a query-sharing DAG: an item is a sum of nodes, a node a sum of two others
or of terms. One pass over the texts writes the occurrences of the items' terms; after
document frequencies are known, each block of documents works out the partial sums of
all nodes once, in the order of the DAG, and items add up their nodes. A task sends on
only the best of each item. Items are taken in blocks of a bounded number of terms, so
what is sent to the tasks is bounded whatever the number of items.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.ranking import top_in_group
from spanframe.llm.common import written
from spanframe.llm.registry import query, table

#: Runs of letters, digits and all characters beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: An item block holds at most so many terms (repeats included), or a single item.
BLOCK_TERMS = 1 << 14
#: Of an item, so many nodes at most (those that most items hold) are mined for shared pairs.
#: This bounds the driver's work; what is not mined is summed item by item, with equal results.
PAIR_NODES = 256
#: Cells of one matrix of partial sums, which bounds the documents scored at a time.
CELLS = 1 << 21


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.translate(LOWER)) if text else []


class SharingDag:
    """Nodes over the terms of a block of items.

    Leaf ``t`` is term ``t``. ``groups`` lists (node, terms with multiplicity) over terms that the
    same items hold equally often; ``joins`` lists (node, left, right); ``items`` the nodes of each.
    """

    def __init__(self, bags: list[dict[int, int]], n_terms: int):
        self.n_terms = n_terms
        holders: dict[int, list[tuple[int, int]]] = {}
        for i, bag in enumerate(bags):
            for t, times in bag.items():
                holders.setdefault(t, []).append((i, times))
        by_signature: dict[tuple, list[int]] = {}
        for t in sorted(holders):
            by_signature.setdefault(tuple(holders[t]), []).append(t)
        self.groups: list[tuple[int, list[tuple[int, int]]]] = []
        self.joins: list[tuple[int, int, int]] = []
        members: list[set[int]] = [set() for _ in bags]
        node = n_terms
        for signature, terms in by_signature.items():
            # equal counts everywhere: one group; else one group per multiplicity
            for times in sorted({m for _, m in signature}):
                self.groups.append((node, [(t, times) for t in terms]))
                for i, m in signature:
                    if m == times:
                        members[i].add(node)
                node += 1
        node = self._share(members, node)
        self.size = node
        self.items = [sorted(m) for m in members]

    def _share(self, members: list[set[int]], node: int) -> int:
        """Replace the pair of nodes that most items hold, while two or more do."""
        where: dict[int, set[int]] = {}
        for i, own in enumerate(members):
            for a in own:
                where.setdefault(a, set()).add(i)
        pairs: Counter = Counter()
        for own in members:
            shared = sorted(sorted((a for a in own if len(where[a]) > 1), key=lambda a: (-len(where[a]), a))[:PAIR_NODES])
            pairs.update((a, b) for k, a in enumerate(shared) for b in shared[k + 1 :])
        queues: dict[int, list[tuple[int, int]]] = {}  # pairs by count; what has changed since is passed over
        for p, c in pairs.items():
            queues.setdefault(c, []).append(p)
        for q in queues.values():
            heapq.heapify(q)

        def change(p: tuple[int, int], by: int) -> None:
            pairs[p] += by
            if pairs[p] > 1:
                heapq.heappush(queues.setdefault(pairs[p], []), p)

        for count in range(max(queues, default=0), 1, -1):
            queue = queues.get(count, [])
            while queue:
                a, b = heapq.heappop(queue)
                if pairs[a, b] != count:
                    continue
                both = sorted(where[a] & where[b])
                self.joins.append((node, a, b))
                where[node] = set()
                for i in both:
                    own = members[i]
                    own.difference_update((a, b))
                    for gone in (a, b):
                        where[gone].discard(i)
                        for other in own:
                            change((min(gone, other), max(gone, other)), -1)
                    change((a, b), -1)
                    for other in own:
                        change((min(node, other), max(node, other)), 1)
                    own.add(node)
                    where[node].add(i)
                node += 1
        return node

    def partial_sums(self, leaves: np.ndarray) -> np.ndarray:
        """(nodes x documents) partial sums from (terms x documents) contributions, each node once."""
        out = np.zeros((self.size, leaves.shape[1]), np.int64)
        out[: self.n_terms] = leaves
        for node, terms in self.groups:
            for t, times in terms:
                out[node] += times * out[t]
        for node, a, b in self.joins:
            np.add(out[a], out[b], out=out[node])
        return out

    def item_sums(self, sums: np.ndarray, item: int) -> np.ndarray:
        return sums[self.items[item]].sum(axis=0) if self.items[item] else np.zeros(sums.shape[1], np.int64)


def postings_kernel(terms: dict[bytes, int]):
    """(doc, text) -> (doc, n, terms, times): all terms counted, those of the items listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, counts, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = terms_of(text)
                mine = Counter(map(terms.get, found))
                mine.pop(None, None)
                sizes.append(len(found))
                ids.extend(mine)
                counts.extend(mine.values())
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "times"])

    return run


def score_kernel(dag: SharingDag, weights: np.ndarray, n_docs: int, n_words: int, item_ids: list, top: int):
    """Postings -> (item, doc, score): the best ``top`` documents of each item in this task."""

    def block(least: np.ndarray, docs: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray):
        m = 25 + (75 * n * n_docs) // n_words
        doc_of = np.repeat(np.arange(len(n)), np.diff(ends))
        leaves = np.zeros((dag.n_terms, len(n)), np.int64)
        leaves[terms, doc_of] = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc_of]))
        sums = dag.partial_sums(leaves)
        for i in range(len(dag.items)):
            score = dag.item_sums(sums, i)
            found = np.flatnonzero(score >= least[i])
            if len(found) > top:
                found = found[score[found] >= np.partition(score[found], len(found) - top)[len(found) - top]]
            if len(found):  # ties stay, the order below cuts them
                yield i, docs.take(pa.array(found)), score[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(dag.items)
        least = np.ones(len(dag.items), np.int64)  # no smaller score can be among the best
        step = max(1, CELLS // max(1, dag.size))
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            lists, counts = batch.column(2), batch.column(3)
            offsets = lists.offsets.to_numpy()
            terms, times = lists.values.to_numpy(), counts.values.to_numpy()
            for lo in range(0, len(n), step):
                hi = min(len(n), lo + step)
                a, b = offsets[lo], offsets[hi]
                for i, docs, score in block(least, batch.column(0).slice(lo, hi - lo), n[lo:hi], offsets[lo : hi + 1] - a, terms[a:b], times[a:b]):
                    both = pa.table({"doc": docs, "score": score})
                    if best[i] is not None:
                        both = pa.concat_tables([best[i], both])
                    if both.num_rows >= top:
                        both = both.take(pc.sort_indices(both, [("score", "descending"), ("doc", "ascending")], null_placement="at_end").slice(0, top))
                        least[i] = both["score"][top - 1].as_py()
                    best[i] = both.combine_chunks()
        for i, rows in enumerate(best):
            if rows is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_ids[i]] * rows.num_rows, pa.int64()), rows["doc"].combine_chunks(), rows["score"].combine_chunks()], names=["item", "doc", "score"])

    return run


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of at most ``block_terms`` terms (or one item), streamed past the driver."""
    rows = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text")).orderBy("item", "text")
    out, held = [], 0
    for r in rows.toLocalIterator():
        terms = terms_of((r["text"] or "").encode())
        if out and held + len(terms) > block_terms:
            yield out
            out, held = [], 0
        out.append((r["item"], terms))
        held += len(terms)
    if out:
        yield out


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", top: int = 10, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each item with a score above 0.

    Equal scores are ordered by ascending id, a null id last; repeated rows are documents
    of their own and may stand side by side. A null or empty text has no terms and is no
    document for N and L. Items that repeat an id are ranked each, their rows told apart
    by nothing but the order, so item ids should be unique; an item without terms, or
    with none that any document holds, has no rows. An empty table of either kind gives
    none. Other columns are not read. ``docs`` is read once for each block of items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = None
    for block in item_blocks(items, item_col, item_text, block_terms):
        vocabulary: dict[bytes, int] = {}
        bags = [dict(Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms)) for _, terms in block]
        if not vocabulary:
            continue
        postings = written(rows.mapInArrow(postings_kernel(vocabulary), "doc bigint, n bigint, terms array<int>, times array<bigint>"), "postings")
        size = postings.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        if not size["docs"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # at most the terms of a block
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        kernel = score_kernel(SharingDag(bags, len(vocabulary)), weights, size["docs"], size["words"], [i for i, _ in block], top)
        part = postings.filter("n > 0").mapInArrow(kernel, "item bigint, doc bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item bigint, doc bigint, score bigint")
    best = top_in_group(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc")], top)
    return best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


@query("op12_ranked_search", r"""
with term as (select rowid_ as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from (select row_number() over () as rowid_, * from documents)),
size as (select r, any_value(doc_id) as doc_id, count(*) as n from term group by r),
corpus as (select count(*) as docs, sum(n)::bigint as words from size),
tf as (select r, t, count(*) as tf from term group by r, t),
weight as (select t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, corpus group by t),
item as (select item_id, t, count(*) as times from (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by all),
part as (select item_id, r, doc_id, (times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::bigint as s
  from item join weight using (t) join tf using (t) join size using (r), corpus),
total as (select item_id, r, any_value(doc_id) as doc_id, sum(s)::bigint as score from part group by item_id, r having sum(s) > 0)
select item_id, row_number() over w::int as rank, doc_id, score from total window w as (partition by item_id order by score desc, doc_id) qualify row_number() over w <= 10
""")
def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
