"""Pre-registered verdicts: null means not measured and stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.stats import holm, paired_bootstrap
from spanframe.session import durable


def stratum_report(
    ev: DataFrame, strata: list[str], selectors: list[str], baselines: list[str],
    replicates: int = 1000, seed: str | int = 0, alpha: float = 0.05,
) -> DataFrame:
    """Each selector against each baseline per stratum, corrected within the stratum.

    ``ev``: sample_id, stratum, selector, coverage at one budget. Selectors become
    columns of one row per sample, so no self join is needed. Comparisons with fewer
    than two pairs enter the family with p = 1 and show null.
    """
    names = list(dict.fromkeys([*selectors, *baselines]))
    # one narrow row per sample, written once: the evaluation behind it runs a single time
    wide = durable(ev.filter(F.col("selector").isin(*names)).groupBy("sample_id", "stratum").pivot("selector", names).agg(F.max("coverage")))
    pairs = F.array(*[
        F.struct(F.lit(i * len(baselines) + j).alias("pos"), F.lit(s).alias("selector"), F.lit(b).alias("baseline"), F.col(s).alias("treatment"), F.col(b).alias("control"))
        for i, s in enumerate(selectors) for j, b in enumerate(baselines)
    ])
    rows = wide.select("sample_id", "stratum", F.explode(pairs).alias("c")).select("sample_id", "stratum", "c.*")
    tested = paired_bootstrap(rows, ["stratum", "selector", "baseline"], ["sample_id"], replicates, seed)
    spark = ev.sparkSession
    planned = spark.createDataFrame(
        [(t, i * len(baselines) + j, s, b) for t in strata for i, s in enumerate(selectors) for j, b in enumerate(baselines)],
        "stratum string, pos int, selector string, baseline string",
    )
    table = planned.join(tested, ["stratum", "selector", "baseline"], "left")
    enough = F.coalesce(F.col("n_pairs"), F.lit(0)) >= 2
    table = table.withColumn("_p", F.when(enough, F.col("p_value")).otherwise(1.0))
    table = holm(table, ["stratum"], "_p", ["pos"], alpha)
    shown = lambda c: F.when(enough, F.col(c)).alias(c)
    positive = F.coalesce(F.col("estimate") > 0, F.lit(False)) & enough
    return durable(table.select(
        "stratum", "selector", "baseline", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), shown("estimate"), shown("low"), shown("high"),
        shown("cohens_d"), shown("p_value"), positive.alias("positive"), (F.col("holm_reject") & positive).alias("significant"),
    ))


def coverage_means(ev: DataFrame) -> DataFrame:
    """Mean coverage per stratum and selector over samples with evidence."""
    return ev.groupBy("stratum", "selector").agg(F.count("coverage").alias("n"), F.avg("coverage").alias("coverage_mean"))


def winners(report: DataFrame) -> DataFrame:
    """Does a selector beat all baselines in its stratum?"""
    return report.groupBy("stratum", "selector").agg(F.bool_and("significant").alias("beats_all"))


def gate_verdict(report: DataFrame, strata: list[str], primary: str, front: str, chosen: str | None = None, strong: str | None = None) -> DataFrame:
    """One row of gate flags.

    Without ``chosen``: every stratum has a selector that beats all baselines, and in
    the primary stratum some selector beats ``front``. With it: the chosen selector
    beats ``front`` in the primary stratum; a selector absent from the report gives null.
    """
    sig = lambda cond: F.max(F.when(cond, F.col("significant").cast("int"))) == 1
    if chosen is None:
        won = winners(report).groupBy().agg(
            F.count_distinct(F.when(F.col("beats_all") & F.col("stratum").isin(*strata), F.col("stratum"))).alias("_won")
        )
        beats = report.groupBy().agg(F.coalesce(sig((F.col("stratum") == primary) & (F.col("baseline") == front)), F.lit(False)).alias("primary_beats_front"))
        both = won.join(beats).withColumn("all_strata_pass", F.col("_won") == len(strata))
        return both.select("all_strata_pass", "primary_beats_front", (F.col("all_strata_pass") & F.col("primary_beats_front")).alias("gate_pass"))
    mine = F.col("selector") == chosen
    flags = [sig(mine & (F.col("stratum") == s) & (F.col("baseline") == b)).alias(f"{s}_beats_{b}")
             for s in strata for b in dict.fromkeys([front, *( [strong] if strong else [])])]
    return report.groupBy().agg(*flags, sig(mine & (F.col("stratum") == primary) & (F.col("baseline") == front)).alias("gate_pass")).withColumn("chosen", F.lit(chosen))


# The six decision rules. ``gain`` needs both the estimate and its lower
# bound above zero, ``floor`` needs the observed value to reach the threshold.
DECISION_RULES = (
    ("D1", "floor", 0.50, True),
    ("D2", "gain", 0.0, True),
    ("D3", "gain", 0.0, True),
    ("D4", "floor", 0.60, False),
    ("D5", "floor", 0.70, False),
    ("D6", "floor", 3.0, False),
)


def decision_table(measures: DataFrame, rules=DECISION_RULES) -> DataFrame:
    """``measures(key, observed, low)`` against the rules; a missing measure stays null."""
    spark = measures.sparkSession
    frozen = spark.createDataFrame(list(rules), "key string, kind string, threshold double, critical boolean")
    clean = measures.select(
        "key", F.when(~F.isnan("observed"), F.col("observed")).alias("observed"), F.when(~F.isnan("low"), F.col("low")).alias("low")
    )
    passed = F.when(F.col("kind") == "floor", F.col("observed") >= F.col("threshold")).otherwise(
        F.when(F.col("observed").isNotNull() & F.col("low").isNotNull(), (F.col("observed") > 0) & (F.col("low") > 0))
    )
    return frozen.join(clean, "key", "left").select("key", "kind", "critical", "observed", "threshold", passed.alias("passed"))


def standing(decisions: DataFrame) -> DataFrame:
    """unmeasured / incomplete / supported / not-supported from the critical rules."""
    crit = F.col("critical")
    agg = decisions.groupBy().agg(
        F.count(F.when(crit, F.lit(1))).alias("_c"), F.count(F.when(crit, F.col("passed"))).alias("_m"),
        F.bool_and(F.when(crit, F.col("passed"))).alias("_all"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("key"))))).alias("failed"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("passed").isNull(), F.col("key"))))).alias("unmeasured"),
    )
    verdict = F.when(F.col("_m") == 0, "unmeasured").when(F.col("_m") < F.col("_c"), "incomplete").when(F.col("_all"), "supported").otherwise("not-supported")
    return agg.select(verdict.alias("standing"), "failed", "unmeasured")


# Unit of each experiment metric.
METRIC_UNITS = {
    "ap50": "fraction_0_1", "ap_s": "fraction_0_1", "map50_95": "fraction_0_1", "tile_recall": "fraction_0_1",
    "precision": "fraction_0_1", "recall": "fraction_0_1", "f1": "fraction_0_1", "false_negative_rate": "fraction_0_1",
    "detector_images": "count", "detector_invocations": "count", "latency_p50_ms": "milliseconds",
    "latency_p95_ms": "milliseconds", "peak_vram_mib": "mebibytes",
}


def experiment_template(spark, arms: list[str]) -> DataFrame:
    """Every required (arm, metric) cell; nothing is measured yet."""
    return spark.createDataFrame(
        [(a, m, u) for a in arms for m, u in METRIC_UNITS.items()], "arm string, metric string, unit string"
    )


def experiment_table(measures: DataFrame, arms: list[str], whole_arm: str | None = None) -> DataFrame:
    """Required cells joined to ``measures(arm, metric, value, status)``.

    A value is present exactly when the cell is measured; the violation column names
    the first broken rule.
    """
    cells = experiment_template(measures.sparkSession, arms)
    given = measures.select("arm", "metric", F.col("value").cast("double").alias("value"), F.col("status").alias("_s"))
    joined = cells.join(given, ["arm", "metric"], "left")
    default = F.when((F.col("arm") == (whole_arm or "")) & (F.col("metric") == "tile_recall"), "not_applicable").otherwise("not_measured")
    status = F.coalesce("_s", default)
    v, unit = F.col("value"), F.col("unit")
    measured = F.col("status") == "measured"
    violation = (
        F.when(~F.col("status").isin("measured", "not_measured", "not_applicable", "failed"), "invalid status")
        .when(~measured & v.isNotNull(), "value without measurement")
        .when(measured & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "measured value must be finite")
        .when(measured & (unit == "fraction_0_1") & ~v.between(0, 1), "fraction out of range")
        .when(measured & (unit != "fraction_0_1") & (v < 0), "negative value")
        .when(measured & (unit == "count") & (v != F.floor(v)), "count must be an integer")
    )
    return joined.withColumn("status", status).select("arm", "metric", "unit", "value", "status", violation.alias("violation"))


def reduction(part: Column, whole: Column) -> Column:
    return 1.0 - part / F.when(whole != 0, whole)


def primary_gate(cells: DataFrame, baseline: str, candidates: list[str], max_loss_points: float = 1.5, min_calls: float = 0.40, min_latency: float = 0.25) -> DataFrame:
    """Non-inferior accuracy, fewer calls and lower latency per candidate; any gap is not_measured."""
    needed = ("ap_s", "detector_images", "latency_p95_ms")
    wide = cells.filter(F.col("metric").isin(*needed) & (F.col("status") == "measured")).groupBy("arm").pivot("metric", list(needed)).agg(F.max("value"))
    base = wide.filter(F.col("arm") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in needed])
    arms = cells.sparkSession.createDataFrame([(c,) for c in candidates], "arm string")
    # ``arms`` is a parameter list and ``base`` one row.
    j = arms.join(wide, "arm", "left").join(F.broadcast(base), F.lit(True), "left")
    complete = F.lit(True)
    for c in needed:
        complete = complete & F.col(c).isNotNull() & F.col(f"b_{c}").isNotNull()
    accuracy = (F.col("b_ap_s") - F.col("ap_s")) * 100 <= max_loss_points + 1e-12
    calls = reduction(F.col("detector_images"), F.col("b_detector_images")) >= min_calls
    latency = reduction(F.col("latency_p95_ms"), F.col("b_latency_p95_ms")) >= min_latency
    show = lambda c: F.when(complete, c)
    return j.select(
        "arm", F.when(complete, "measured").otherwise("not_measured").alias("status"), show(accuracy).alias("accuracy_non_inferior"),
        show(calls).alias("calls_improved"), show(latency).alias("latency_improved"), show(accuracy & calls & latency).alias("passed"),
    )


def cohort_summary(results: DataFrame) -> DataFrame:
    """One row of cohort rates and totals from per-sample results.

    results: ok, coverage, ok_bytes, total_bytes, overlay_share, points, errors.
    """
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("double")), 6), F.lit(0.0))
    return results.groupBy().agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("ok")).alias("ok_rate"), F.round(F.avg("coverage"), 6).alias("coverage_mean"),
        F.round(F.sum("ok_bytes") / F.when(F.sum("total_bytes") > 0, F.sum("total_bytes")), 6).alias("coverage_byte_weighted"),
        F.sum("total_bytes").alias("total_bytes"), F.sum("points").alias("roundtrip_points"), F.sum("errors").alias("roundtrip_errors"),
        F.count(F.when(F.col("overlay_share") > 0.5, F.lit(1))).alias("overlay_dominant"),
    )
