"""Hot-group paths must give what the plain window gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanframe.functions import ranking


def _rows(spark):
    # group 0 holds a third of all rows
    return spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 101).alias("x"), "id")


def test_sorted_rank_equals_window(spark):
    df = _rows(spark)
    order = [F.col("x").desc(), F.col("id")]
    plain = {(r.id, r["rank"]) for r in df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
    assert plain == {(r.id, r["rank"]) for r in ranking.rank_in_group(df, ["g"], order).collect()}


def test_order_values_equal_sorted_lists(spark):
    df = _rows(spark)
    pos = {"lo": lambda n: F.floor(n / 4), "hi": lambda n: n - 1}
    got = {(r.g, r.tag): r.value for r in ranking.order_values(df, ["g"], "x", pos).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.x)
    for g, xs in groups.items():
        xs.sort()
        assert got[(g, "lo")] == xs[len(xs) // 4] and got[(g, "hi")] == xs[-1]


def test_running_sums_over_partitions(spark):
    df = _rows(spark).groupBy("g", "x").count()
    w = Window.partitionBy("g").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    want = {tuple(r) for r in df.withColumn("t", F.sum("count").over(w)).collect()}
    assert want == {tuple(r) for r in ranking.running_sums(df, ["g"], [F.desc("x")], {"count": "t"}).collect()}


def test_attach_group_salts_hot_groups(spark):
    df = _rows(spark)
    facts = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = ranking.attach_group(df, facts, ["g"], "n", hot_rows=100)
    assert out.count() == 3000
    assert out.filter("g = 0").agg(F.min("n"), F.max("n")).first() == (out.filter("g = 0").count(),) * 2


def test_top_in_group_large_n(spark):
    df = _rows(spark)
    order = [F.col("x"), F.col("id")]
    a = {tuple(r) for r in ranking.top_in_group(df, ["g"], order, 1200).select("g", "id", "rank").collect()}
    b = {(r.g, r.id, r["rank"]) for r in ranking.rank_in_group(df, ["g"], order).collect() if r["rank"] <= 1200}
    assert a == b
