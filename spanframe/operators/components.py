"""Connected components of duplicate graphs by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.ranking import attach_group
from spanframe.session import durable


def star_edges(df: DataFrame, key: str, node: str = "id") -> DataFrame:
    """One edge (lowest member, member) per row of a shared key: linear, never all pairs."""
    rows = df.filter(F.col(key).isNotNull()).select(node, key)
    hub = rows.groupBy(key).agg(F.min(node).alias("_hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    linked = attach_group(rows, hub, [key], "_n")
    return linked.filter(F.col(node) != F.col("_hub")).select(F.col("_hub").alias("a"), F.col(node).alias("b"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of an edge; the component is its lowest id.

    Each round hooks larger neighbours to the lowest neighbour (large star) and then
    collapses towards smaller ones (small star). Minima are combinable aggregates and
    hub joins are salted by degree; every round is checkpointed.
    """
    cur = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = _state(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n"))
        hooked = attach_group(both, low, ["a"], "_n").filter("b > a").select(F.least("a", "_m").alias("a"), "b").filter("a <> b").distinct()
        down = hooked.groupBy("b").agg(F.min("a").alias("_m"), F.count(F.lit(1)).alias("_n"))
        side = attach_group(hooked, down, ["b"], "_n").filter("a <> _m").select(F.col("_m").alias("a"), F.col("a").alias("b"))
        cur = durable(side.unionByName(down.select(F.col("_m").alias("a"), "b")).distinct())
        after = _state(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(
        cur.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )


def component_dedup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep one node per duplicate component, held-out first; drop conflicting components.

    nodes: id, label, split. Returns every node with ``keep`` and the exclusion reason.
    """
    comp = connected_components(edges)
    known = nodes.join(comp, "id")
    facts = known.groupBy("component").agg(
        F.min(F.struct(F.when(F.col("split") == "val", 0).otherwise(1).alias("r"), F.col("id").alias("id"))).alias("_k"),
        (F.min("label") != F.max("label")).alias("_conflict"), F.count(F.lit(1)).alias("_n"),
    )
    judged = attach_group(known, facts, ["component"], "_n")
    reason = F.when(F.col("_conflict"), "component_has_conflicting_labels").when(F.col("id") != F.col("_k.id"), "duplicate_in_component")
    lone = nodes.join(comp, "id", "left_anti").select("id", "label", "split", F.col("id").alias("component"), F.lit(None).cast("string").alias("reason"))
    out = judged.select("id", "label", "split", "component", reason.alias("reason")).unionByName(lone)
    return out.withColumn("keep", F.col("reason").isNull())
