"""The evaluation grid: one row per tile and interval part, in tasks that follow the input."""

from pyspark.sql import functions as F

from spanframe.operators import budget
from spanframe.plans import flagship


def _ranked(spark):
    tiles = spark.createDataFrame(
        [(s, t, 10, float((7 * s + 3 * t) % 5), float((3 * s + t) % 4)) for s in (1, 2, 3) for t in range(1 if s == 3 else 9 + s)],
        "sample_id bigint, tile bigint, tile_len bigint, entropy double, boundary double",
    )
    found = spark.createDataFrame([(1, 5, 37), (1, 60, 62), (2, 0, 4)], "sample_id bigint, lo bigint, hi bigint")
    out = budget.evidence_tiles(tiles.drop("boundary"), found, 10, 3)
    return budget.rank_selectors(out.join(tiles.select("sample_id", "tile", "boundary"), ["sample_id", "tile"]).withColumn("kind", F.lit("x")), "s")


def test_grid_equals_one_row_per_choice(spark):
    ranked = _ranked(spark)
    cols = ["sample_id", "kind", "selector", "budget", "coverage", "byte_iou", "interval_recall_50", "evidence_hit", "k", "has_evidence", "n_regions"]
    long = budget.selection_metrics(budget.choices(ranked), ["kind", "selector", "budget"]).select(cols)
    grid = budget.grid_metrics(ranked, ["kind"]).select(cols)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(grid) == rows(long)
    assert grid.count() == 3 * len(budget.SELECTORS) * len(budget.BUDGETS)


def test_evaluation_deals_samples_over_tasks_of_the_input(spark, sf):
    plan = flagship.evaluation(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_line_rows_are_dealt_over_tasks_of_the_input(spark, sf):
    from spanframe.plans.views import view

    plan = view(spark, sf, "v_region")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1


def test_import_does_not_deal_rows_by_label(spark, sf):
    from spanframe.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["c15_import_annotations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert dealt and not any("category" in line or "label" in line for line in dealt)
