"""Sequential greedy choices on conflict graphs, as rounds over the whole table.

What precedes all its undecided rivals is decided for certain, wherever else in its group
decisions are still open. So all such rows of all groups are decided at once, their
rivals lose, and the next round follows. The result is that of going through each group
in order; only a group of few pairs is collected. Rounds end when nothing is undecided; each is cut by a
checkpoint. On random orders their number grows with the logarithm of the group.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.session import durable


#: Groups of up to so many pairs are walked in one row.
SMALL_GROUP = 64


def greedy_pairs(pairs: DataFrame, group: str, left: str, right: str, order: list[Column], small: int = SMALL_GROUP) -> DataFrame:
    """Pairs that a pass in ``order`` takes, each left and right row at most once.

    ``order`` must be total within a group. The other columns of ``pairs`` stay. A group of at
    most ``small`` pairs travels as one array and is walked there; only larger ones, if any, take rounds.
    """
    pairs = durable(pairs)
    keyed = pairs.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    large = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small)
    if large.isEmpty():
        return _walk(keyed, group, left, right, pairs.columns)
    large = durable(large.select(group))
    few = _walk(keyed.join(large, group, "left_anti"), group, left, right, pairs.columns)
    return few.unionByName(_rounds(keyed.join(large, group, "left_semi").select(*keyed.columns), group, left, right).select(*pairs.columns))


def _walk(keyed: DataFrame, group: str, left: str, right: str, columns: list[str]) -> DataFrame:
    """The pass over each group inside the row that holds it."""
    cells = keyed.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_key", *[c for c in columns if c != group]))).alias("_cells"))

    def run(batches):
        for b in batches:
            flat, sizes = b.column("_cells").flatten(), pc.list_value_length(b.column("_cells")).to_pylist()
            ls, rs = flat.field(left).to_pylist(), flat.field(right).to_pylist()
            taken, at, start = [], [], 0
            for row, n in enumerate(sizes):
                used_left, used_right = set(), set()
                for i in range(start, start + n):
                    if ls[i] not in used_left and rs[i] not in used_right:
                        used_left.add(ls[i])
                        used_right.add(rs[i])
                        taken.append(i)
                        at.append(row)
                start += n
            rows, at = flat.take(pa.array(taken, pa.int64())), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(group).take(at) if c == group else rows.field(c) for c in columns], names=columns)

    return cells.mapInArrow(run, keyed.select(*columns).schema)


def _rounds(open_: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """The pass as rounds over all groups."""
    open_ = durable(open_)
    columns = open_.columns
    rounds = []
    while not open_.isEmpty():
        best = [open_.groupBy(group, side).agg(F.min("_key").alias(f"_best_{side}")) for side in (left, right)]
        judged = open_.join(best[0], [group, left]).join(best[1], [group, right])
        taken = durable(judged.filter((F.col("_key") == F.col(f"_best_{left}")) & (F.col("_key") == F.col(f"_best_{right}"))).select(*open_.columns))
        rounds.append(taken)
        open_ = durable(open_.join(taken.select(group, left), [group, left], "left_anti").join(taken.select(group, right), [group, right], "left_anti"))
    return reduce(DataFrame.unionByName, rounds, open_).select(*columns)


def greedy_owners(nodes: DataFrame, rivals: DataFrame, group: str, node: str) -> DataFrame:
    """(group, node, owner): a pass in order makes each free node a seed, which takes its free rivals.

    rivals: group, node, rival, key, one row for each rival that precedes the node; ``key`` is
    its place in the order. A node goes to the first seed among its rivals; a seed owns itself.
    """
    open_ = durable(nodes.select(group, node))
    edges = durable(rivals.select(group, node, "rival", "key", F.lit(False).alias("seed")))
    rounds = []
    while not open_.isEmpty():
        first = edges.groupBy(group, node).agg(F.min(F.struct("key", "rival", "seed")).alias("_first"))
        state = durable(open_.join(first, [group, node], "left"))
        seeds = state.filter("_first is null").select(group, F.col(node).alias("rival"), F.lit(True).alias("new"))
        behind = state.filter("_first is not null").select(group, node, "_first.rival", "_first.seed").join(seeds, [group, "rival"], "left")
        decided = seeds.select(group, F.col("rival").alias(node), F.col("rival").alias("owner")).unionByName(
            behind.filter("seed or new").select(group, node, F.col("rival").alias("owner")))
        decided = durable(decided)
        rounds.append(decided)
        fate = decided.select(group, F.col(node).alias("rival"), (F.col("owner") == F.col(node)).alias("chosen"))
        left = edges.join(decided.select(group, node), [group, node], "left_anti").join(fate, [group, "rival"], "left")
        edges = durable(left.filter("chosen is null or chosen").select(group, node, "rival", "key", (F.col("seed") | F.coalesce("chosen", F.lit(False))).alias("seed")))
        open_ = durable(open_.join(decided.select(group, node), [group, node], "left_anti"))
    empty = open_.select(group, node, F.col(node).alias("owner"))
    return reduce(DataFrame.unionByName, rounds, empty)
