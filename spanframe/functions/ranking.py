"""Ranks, running sums and order statistics inside groups of any size.

There is one plan for all sizes: a range sort over the cluster, written once, local
positions within each partition, and offsets from one row per group and partition. No
group is ever held by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.session import durable

def sorted_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", few_groups: bool = False) -> DataFrame:
    """Exact 1-based rank per group from one range-partitioned sort of all rows.

    With ``few_groups`` the offsets, one row per group and partition, are broadcast: the rows are not
    moved again, and the partitions of the result follow one another in the order of the sort.
    """
    ordered = df.sort(*[F.col(g) for g in group], *order).withColumn("_mid", F.monotonically_increasing_id())
    ordered = durable(
        ordered.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
            "_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    # One row per (group, partition): at most groups + partitions rows.
    cells = ordered.groupBy(*group, "_part").agg(
        F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    g2 = [F.col(f"o.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]
    cond = F.col("o._part") == F.col("c._part")
    for c in g2:
        cond = cond & c
    keep = [F.col(f"o.{c}") for c in df.columns]
    return ordered.alias("o").join(F.broadcast(cells).alias("c") if few_groups or not group else cells.alias("c"), cond).select(
        *keep, (F.col("o._local") - F.col("c._first") + 1 + F.col("c._before")).cast("bigint").alias(name)
    )


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", few_groups: bool = False) -> DataFrame:
    """1-based ``row_number`` per group under a total order."""
    return sorted_rank(df, group, order, name, few_groups)


def top_in_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    A constant bound lets the planner cut each map task to ``n`` rows per group
    before the shuffle; for large ``n`` a salted first pass does the same.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    if n <= 1000:
        return df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r", "_salt")
    return cut.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= n)


def first_in_group(df: DataFrame, group: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """The first row per group by ``order``, as a combinable aggregate (no window)."""
    picked = df.groupBy(*group).agg(F.min(F.struct(*dict.fromkeys(order + carry))).alias("_f"), F.count(F.lit(1)).alias("group_size"))
    return picked.select(*group, *[F.col(f"_f.{c}").alias(c) for c in dict.fromkeys(order + carry)], "group_size")


def attach_group(df: DataFrame, facts: DataFrame, keys: list[str], size_col: str, hot_rows: int = 1_000_000, send_hot: bool = False) -> DataFrame:
    """Join per-group ``facts`` back to the rows, splitting hot groups over salts.

    A group above ``hot_rows`` rows is replicated once per million rows on the facts
    side and its rows are spread over the copies. There are at most rows/``hot_rows`` hot
    groups; how their list is joined is left to the planner, or with ``send_hot`` it is broadcast,
    so that the rows move once.
    """
    hot = facts.filter(F.col(size_col) > hot_rows).select(
        *keys, F.ceil(F.col(size_col) / F.lit(float(hot_rows))).cast("int").alias("_salts")
    )
    rows = df.join(F.broadcast(hot) if send_hot else hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
        ),
    ).drop("_salts")
    copies = facts.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(size_col) / F.lit(float(hot_rows)))).cast("int") - 1)),
    )
    # a group of exactly hot_rows rows gets one copy on both sides
    return rows.join(copies, keys + ["_salt"]).drop("_salt")


def order_values(df: DataFrame, by: list[str], x: str, positions) -> DataFrame:
    """Rows ``(by, tag, value)`` holding the order statistics of ``x``.

    ``positions`` maps a tag to a function of the group size column giving a
    0-based index. Nulls are skipped.
    """
    base = df.select(*by, F.col(x).alias("_x")).filter(F.col("_x").isNotNull())
    # Equal values share one row, so repeated values never inflate the ranked table.
    hist = base.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    hist = durable(hist)
    total = hist.groupBy(*by).agg(F.sum("_c").alias("_n"))
    tags = F.array(*[
        F.struct(F.lit(tag).alias("tag"), fn(F.col("_n")).cast("bigint").alias("_i")) for tag, fn in positions.items()
    ])
    wanted = total.select(*by, "_n", F.explode(tags).alias("_t")).select(*by, "_n", "_t.tag", "_t._i")
    cum = running_sums(hist, by, [F.col("_x")], {"_c": "_hi"})
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("_c"))
    if by:
        j = cum.join(wanted, by)
    else:
        j = cum.join(F.broadcast(wanted))  # one row per tag
    return j.filter((F.col("_i") >= F.col("_lo")) & (F.col("_i") < F.col("_hi"))).select(
        *by, "tag", F.col("_x").alias("value"), F.col("_n").alias("n")
    )


def running_sums(df: DataFrame, by: list[str], order: list, sums: dict[str, str]) -> DataFrame:
    """Adds the running sum of each column of ``sums`` within ``by`` under a total order.

    One sort over the cluster, written once; every partition sums its own rows and adds
    what the partitions before it hold, so a group may span any number of tasks.
    """
    ranked = durable(df.sort(*by, *order).withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33)))
    cells = ranked.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_b{i}") for i, c in enumerate(sums)])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "_part", *[F.coalesce(F.sum(f"_b{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*by, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = ranked.select("*", *[F.sum(c).over(inside).alias(f"_l{i}") for i, c in enumerate(sums)])
    j = local.join(cells, [*by, "_part"])
    return j.select(*df.columns, *[(F.col(f"_l{i}") + F.col(f"_b{i}")).alias(name) for i, name in enumerate(sums.values())])


def linear_quantiles(df: DataFrame, by: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles as one wide row per group: ``n`` and one column per tag."""
    positions = {}
    for tag, p in probs.items():
        positions[f"{tag}|f"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        positions[f"{tag}|c"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    rows = order_values(df, by, x, positions)
    wide = rows.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(f"_{t}") for t in positions],
    )
    out = [F.col(c) for c in by] + [F.col("n")]
    for tag, p in probs.items():
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"`_{tag}|f`").cast("double"), F.col(f"`_{tag}|c`").cast("double")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(tag))
    return wide.select(*out)
