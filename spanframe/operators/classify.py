"""Classification metrics from long prediction and probability tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, classes: Sequence) -> DataFrame:
    """All class x class cells, zeros kept; the grid comes from the class list."""
    kind = pred.schema["truth"].dataType.simpleString()
    names = F.array(*[F.lit(c).cast(kind) for c in classes])
    grid = pred.sparkSession.range(1).select(F.explode(names).alias("truth")).select("truth", F.explode(names).alias("pred"))
    return grid.join(pred.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n")), ["truth", "pred"], "left").na.fill(0, ["n"])


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; an empty denominator gives 0."""
    by_truth = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    out = by_truth.join(by_pred, "label").withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    pr = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / F.when(pr > 0, pr)).otherwise(0.0))


def report_totals(report: DataFrame) -> DataFrame:
    """Accuracy, macro means over all classes, and support-weighted F1."""
    return report.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def macro_f1_present(report: DataFrame) -> DataFrame:
    """Macro F1 over the classes that occur in the truth."""
    return report.agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1_present"))


def probability_rows(prob: DataFrame, top: int = 5) -> DataFrame:
    """Per sample: argmax, confidence, top-k hit, loss and squared error. prob: sample_id, truth, label, p."""
    w = Window.partitionBy("sample_id").orderBy(F.col("p").desc(), "label")  # one row per class
    hot = F.col("label") == F.col("truth")
    ranked = prob.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("sample_id", "truth").agg(
        F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("pred"), F.max("p").alias("confidence"),
        F.max((hot & (F.col("_r") <= top)).cast("int")).alias("top_hit"), F.max(F.when(hot, -F.ln(F.least(F.greatest("p", F.lit(1e-12)), F.lit(1.0))))).alias("nll"),
        F.sum(F.pow(F.col("p") - hot.cast("double"), 2)).alias("brier"), F.sum("p").alias("total_p"), F.min("p").alias("min_p"),
    )


def probability_metrics(rows: DataFrame) -> DataFrame:
    """Top-k accuracy, mean loss, Brier score and the number of refused rows."""
    bad = (F.abs(F.col("total_p") - 1) > 1e-5) | (F.col("min_p") < 0)
    ok = lambda c: F.avg(F.when(~bad, c))
    return rows.agg(
        F.count(F.when(~bad, F.lit(1))).alias("n"), F.count(F.when(bad, F.lit(1))).alias("refused"), ok(F.col("top_hit")).alias("top_accuracy"),
        ok(F.col("nll")).alias("nll"), ok(F.col("brier")).alias("brier"), ok((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"),
    )


def reliability_bins(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Count, accuracy and confidence per ``(lo, hi]`` bin, the first one closed; empty bins are null."""
    b = F.greatest(F.lit(1), F.ceil(F.col("confidence") * bins)).cast("int") - 1
    agg = rows.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence")
    )
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(agg, "bin", "left").select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence")


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def mc_uncertainty(passes: DataFrame) -> DataFrame:
    """Predictive entropy and mutual information over stochastic passes. passes: sample_id, pass, label, p."""
    h = lambda p: -F.greatest(p, F.lit(1e-12)) * F.ln(F.greatest(p, F.lit(1e-12)))
    per = passes.groupBy("sample_id", "label").agg(F.avg("p").alias("_m"), F.avg(h(F.col("p"))).alias("_e"))
    return per.groupBy("sample_id").agg(
        F.max("_m").alias("confidence"), F.sum(h(F.col("_m"))).alias("predictive_entropy"), (F.sum(h(F.col("_m"))) - F.sum("_e")).alias("mutual_information")
    )


def majority_baseline(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Accuracy and macro F1 (over present classes) of always guessing the most frequent class; the first wins ties."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct(F.col("n"), (-F.col(label)).alias("neg"))).alias("b"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("present"))
    acc = F.col("b.n") / F.col("t")
    return best.select((-F.col("b.neg")).alias("majority_class"), acc.alias("accuracy"), (2 * acc / (acc + 1) / F.col("present")).alias("macro_f1"))


def sanity_gate(measured: DataFrame, baseline: DataFrame, margin_points: float = 10.0, ratio: float = 1.5) -> DataFrame:
    """Both are one-row tables; accuracy must beat the majority by a margin and macro F1 by a ratio."""
    j = measured.select(F.col("accuracy").alias("a"), F.col("macro_f1").alias("f")).join(F.broadcast(baseline))
    acc = F.col("a") >= F.col("accuracy") + margin_points / 100
    f1 = F.when(F.col("macro_f1") > 0, F.col("f") >= ratio * F.col("macro_f1")).otherwise(F.col("f") > 0)
    return j.select("majority_class", acc.alias("accuracy_ok"), f1.alias("macro_f1_ok"), (acc & f1).alias("passed"))


def latency_summary(df: DataFrame, by: list[str], ms: str, elapsed_s: str | None = None) -> DataFrame:
    """Mean, linear p50/p95 and throughput."""
    from spanframe.functions.ranking import linear_quantiles

    total = F.sum(ms) / 1000.0 if elapsed_s is None else F.max(elapsed_s)
    base = df.groupBy(*by).agg(F.avg(ms).alias("mean_ms"), (F.count(ms) / total).alias("per_second"))
    return base.join(linear_quantiles(df, by, ms, {"p50_ms": 0.50, "p95_ms": 0.95}), by)


def flatten_metrics(df: DataFrame, key: list[str], metrics: str) -> DataFrame:
    """Nested ``section -> metric -> value`` maps as long rows; non-finite values are dropped."""
    one = df.select(*key, F.explode(metrics).alias("section", "_m")).select(*key, "section", F.explode("_m").alias("metric", "value"))
    return one.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def ranking_curves(df: DataFrame, by: list[str], score: str, positive: str, fprs: Sequence[float] = (0.001, 0.01)) -> DataFrame:
    """Average precision, ROC AUC and TPR at fixed FPR per group, on exact scores.

    Equal scores are counted together; the running counts come from one sort over the
    cluster, so a group may be of any size.
    """
    from spanframe.functions.ranking import running_sums

    hist = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(F.col(positive).cast("bigint")).alias("_pos"), F.sum((~F.col(positive)).cast("bigint")).alias("_neg")
    )
    c = running_sums(hist, by, [F.col("_s").desc()], {"_pos": "_tp", "_neg": "_fp"})
    totals = df.groupBy(*by).agg(F.sum(F.col(positive).cast("bigint")).alias("_all_pos"), F.sum((~F.col(positive)).cast("bigint")).alias("_all_neg"))
    c = c.join(totals, by)
    tpr, fpr = F.col("_tp") / F.col("_all_pos"), F.col("_fp") / F.col("_all_neg")
    ap = F.col("_pos") / F.col("_all_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    roc = F.col("_neg") / F.col("_all_neg") * (F.col("_tp") - F.col("_pos") / 2) / F.col("_all_pos")
    at = [F.coalesce(F.max(F.when(fpr <= f, tpr)), F.lit(0.0)).alias(f"tpr_at_{str(f).replace('.', '_')}") for f in fprs]
    return c.filter("_all_pos > 0 and _all_neg > 0").groupBy(*by).agg(F.max("_all_pos").alias("positives"), F.max("_all_neg").alias("negatives"), F.sum(ap).alias("pr_auc"), F.sum(roc).alias("roc_auc"), *at)


def review_curve(ranked: DataFrame, key: str = "sample_id") -> DataFrame:
    """Unit and byte precision/recall at every rank. ranked: key, rank, tile_len, evidence (of one content row)."""
    w = Window.partitionBy(key)
    run = w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("evidence") > 0).cast("bigint")
    r = ranked.withColumn("_u", F.sum(hit).over(run)).withColumn("_units", F.sum(hit).over(w)).withColumn("_b", F.sum("evidence").over(run)).withColumn("_bytes", F.sum("evidence").over(w))
    r = r.withColumn("_l", F.sum("tile_len").over(run)).withColumn("_length", F.sum("tile_len").over(w))
    div = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    return r.select(
        key, "rank", div(F.col("_u"), F.col("_units")).alias("unit_recall"), (F.col("_u") / F.col("rank")).alias("unit_precision"),
        div(F.col("_b"), F.col("_bytes")).alias("byte_recall"), div(F.col("_b"), F.col("_l")).alias("byte_precision"), div(F.col("_l"), F.col("_length")).alias("reviewed"),
        "evidence", F.col("_bytes").alias("evidence_bytes"),
    )


def review_area(curve: DataFrame, key: str = "sample_id") -> DataFrame:
    """Byte average precision per sample with evidence."""
    return curve.filter("evidence_bytes > 0").groupBy(key).agg(F.sum(F.col("evidence") / F.col("evidence_bytes") * F.col("byte_precision")).alias("byte_auprc"))


def first_hit(ranked: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rank of the first relevant unit and its reciprocal; none gives null and 0."""
    f = F.min(F.when(F.col("evidence") > 0, F.col("rank")))
    return ranked.groupBy(key).agg(f.alias("first_rank"), F.coalesce(1.0 / f, F.lit(0.0)).alias("reciprocal_rank"))


def coverage_report(required: DataFrame, outputs: DataFrame, methods: Sequence[str], by: list[str]) -> DataFrame:
    """Missing outputs per method count as lost coverage, never as a negative.

    required: sample_id and ``by``; outputs: sample_id, method, value.
    """
    cells = required.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    j = cells.join(outputs.select("sample_id", "method", "value"), ["sample_id", "method"], "left")
    return j.groupBy(*by, "method").agg(
        F.count(F.lit(1)).alias("required"), F.count("value").alias("measured"), (F.count("value") / F.count(F.lit(1))).alias("coverage"), F.avg("value").alias("mean_value")
    )
