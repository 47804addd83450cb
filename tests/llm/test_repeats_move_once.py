"""Facts of repeated lines reach their lines without moving the lines for the list of hot groups."""

from pyspark.sql import functions as F

from spanframe.functions.ranking import attach_group


def test_hot_list_is_broadcast(spark):
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)], "g int, v int").repartition(4)
    facts = rows.groupBy("g").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, sent = (attach_group(rows, facts, ["g"], "k", 10, send_hot=s) for s in (False, True))
        moves = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (plain, sent)]
        a, b = (sorted(tuple(r[c] for c in ("g", "v", "first", "k")) for r in df.collect()) for df in (plain, sent))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a == b and len(a) == 200 and moves[1] < moves[0]
