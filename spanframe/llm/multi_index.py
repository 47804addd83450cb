"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, so K centroids a half make K x K
cells. A query walks the pairs of centroids in order of summed distance with a heap and
stops once the cells seen hold the wanted share of the vectors; what stands in those
cells is reranked by exact distance.

Centroids are fitted on a bounded sample, every vector is indexed. The index is dealt by
the first half's centroid and split into blocks of bounded size; a task holds one block
and lets the queries that want it stream past, so neither a crowded cell nor the number
of queries has to fit anywhere. Of vectors that are equal, only the ``k + 1`` smallest ids
can be among ``k`` nearest, and only these are indexed; this cut is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import partitions
from spanframe.llm.registry import query, table
from spanframe.session import durable

#: At most so many vectors fit the centroids, those of the smallest keyed hash.
SAMPLE_ROWS = 20_000
CENTROIDS = 64
#: Share of the vectors a query visits. Evenly spread vectors have no cells to tell near
#: from far; there recall 0.9 takes over a third of them. Clustered ones need far less.
SHARE = 0.5
BLOCK_ROWS = 8192


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


def centroids(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; an emptied centroid stays where it was."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in order of summed distance until they hold ``wanted`` vectors."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, seen, out, held = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(sizes[o1[i], o2[j]])
        if n:
            out.append((o1[i], o2[j]))
            held += n
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with vectors of the commonest length that are finite and not zero."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(size.select("n")), F.size("v") == F.col("n")).select("id", "v").dropDuplicates(["id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE,
    k_centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each vector whose id is divisible by ``every``.

    Euclidean distance in double precision on the original vectors, nearest first, ties to
    the smaller id; with no more than ``k`` candidates in the cells seen the walk goes on.
    Vectors that are null, zero, of another length than the commonest, or with null or
    non-finite components take no part, nor do null ids. Rows that repeat id and vector
    count once; an id with several vectors is several candidates, and as a query it has
    the smallest of them. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    base = durable(usable(vectors, id_col, vec_col))
    sample = base.orderBy(F.xxhash64("id", F.lit("centroids")), "v").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    if len(sample) == 0:
        return spark.createDataFrame([], out_schema)
    x = _matrix(sample)
    half = x.shape[1] // 2
    c1, c2 = centroids(x[:, :half], k_centroids), centroids(x[:, half:], k_centroids)
    copies = Window.partitionBy("v").orderBy("id")
    unique = base.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1).select("id", "v")

    def quantise(batches):
        for b in batches:
            v = _matrix(b.column("v"))
            a, z = squared(v[:, :half], c1).argmin(1), squared(v[:, half:], c2).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["id", "v", "c1", "c2"])

    index = durable(unique.mapInArrow(quantise, "id bigint, v array<double>, c1 int, c2 int"))
    sizes = np.zeros((len(c1), len(c2)), np.int64)
    for a, z, n in index.groupBy("c1", "c2").count().collect():  # at most K x K rows
        sizes[a, z] = n
    wanted = max(int(np.ceil(share * sizes.sum())), k + 1)
    blocks = np.maximum(1, -(-sizes.sum(1) // block_rows))
    n_blocks = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("c1") + 1)

    def probe(batches):
        for b in batches:
            v, rows = _matrix(b.column("v")), ([], [], [])
            d1, d2 = squared(v[:, :half], c1), squared(v[:, half:], c2)
            for i in range(len(v)):
                by: dict[int, list[int]] = {}
                for a, z in walk(d1[i], d2[i], sizes, wanted):
                    by.setdefault(a, []).append(z)
                for a, cells in by.items():
                    for column, value in zip(rows, (i, a, cells)):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.int32()))], names=["id", "v", "c1", "cells"])

    asked = base.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    probes = asked.mapInArrow(probe, "id bigint, v array<double>, c1 int, cells array<int>").withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    held = index.withColumn("block", F.pmod(F.xxhash64("id", "v"), n_blocks).cast("int"))
    both = held.select("c1", "block", F.lit(0).alias("kind"), "id", "v", "c2", F.lit(None).cast("array<int>").alias("cells")).unionByName(
        probes.select("c1", "block", F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("int").alias("c2"), "cells"))
    dealt = both.repartition(partitions(spark), "c1", "block").sortWithinPartitions("c1", "block", "kind", "id")

    def rerank(batches):
        now, ids, vecs, cell = None, [], [], []
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("c1", "block", "kind")], axis=1)
            cuts = np.flatnonzero(np.any(np.diff(key, axis=0), axis=1)) + 1
            found = ([], [], [])
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                if lo == hi:
                    continue
                part, (a, block, kind) = b.slice(lo, hi - lo), key[lo].tolist()
                if (a, block) != now:
                    now, ids, vecs, cell = (a, block), [], [], []
                if kind == 0:
                    ids.append(part.column("id").to_numpy())
                    vecs.append(_matrix(part.column("v")))
                    cell.append(part.column("c2").to_numpy())
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vecs, cell = [np.concatenate(ids)], [np.concatenate(vecs)], [np.concatenate(cell)]
                for s in range(0, hi - lo, 256):
                    _best(part.slice(s, 256), ids[0], vecs[0], cell[0], k, len(c2), found)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = dealt.mapInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(part, ids, vecs, cell, k, n_cells, found) -> None:
    """The k nearest of a block for each query: a matrix product picks them, differences measure them."""
    q = _matrix(part.column("v"))
    rough = squared(q, vecs)
    slack = 1e-11 * ((q**2).sum(1) + (vecs**2).sum(1).max())
    for i, (query_id, cells) in enumerate(zip(part.column("id").to_pylist(), part.column("cells").to_pylist())):
        wanted = np.zeros(n_cells, bool)
        wanted[cells] = True
        at = np.flatnonzero(wanted[cell] & (ids != query_id))
        if len(at) > k:
            d = rough[i, at]
            at = at[d <= np.partition(d, k - 1)[k - 1] + slack[i]]
        if not len(at):
            continue
        score = np.sqrt(((vecs[at] - q[i]) ** 2).sum(1))
        order = np.lexsort((ids[at], score))[:k]
        found[0].extend([query_id] * len(order))
        found[1].extend(ids[at][order].tolist())
        found[2].extend(score[order].tolist())


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"))
