"""Evidence tables: mass, recall at a budget, deletion curves and controls.

The long ``deltas`` table (sample_id, fill, block, delta) is the contract; a null
delta was not probed and counts as zero. The blocks of one sample and fill come from
one content row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.ranking import attach_group, rank_in_group, running_sums
from spanframe.operators.stats import kendall_tau_b, summarize_paired
from spanframe.session import durable


def positive(delta: str | Column) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0))


def evidence_mass(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the positive deltas; occlusions that helped do not cancel evidence."""
    return deltas.groupBy(*by).agg(F.sum(positive("delta")).alias("mass"))


def recall_at_budget(deltas: DataFrame, by: list[str], selected: str = "selected") -> DataFrame:
    """Share of the mass on selected blocks; without mass it is undefined."""
    agg = deltas.groupBy(*by).agg(
        F.sum(positive("delta")).alias("_t"), F.sum(F.when(F.col(selected), positive("delta")).otherwise(0.0)).alias("_s"), F.count(F.when(F.col(selected), F.lit(1))).alias("k")
    )
    return agg.select(*by, "k", F.when(F.col("_t") > 0, F.col("_s") / F.when(F.col("_t") > 0, F.col("_t"))).alias("recall"))


def deletion_curve(deltas: DataFrame, by: list[str], order: list[Column], baseline: Column) -> DataFrame:
    """Cumulative loss per removed block in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = deltas.withColumn("step", F.row_number().over(w)).withColumn("nll", baseline + F.sum(F.coalesce("delta", F.lit(0.0))).over(run))
    return out.withColumn("fraction", F.col("step") / F.count(F.lit(1)).over(Window.partitionBy(*by)))


def trapezoid_auc(curve: DataFrame, by: list[str], x: str, y: str, order: str, single: Column | None = None) -> DataFrame:
    """Trapezoid area per group; a single point gives its value unless told otherwise."""
    w = Window.partitionBy(*by).orderBy(order)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    g = curve.withColumn("_a", area).groupBy(*by).agg(F.sum("_a").alias("_s"), F.count(F.lit(1)).alias("n_points"), F.max(y).alias("_y"))
    return g.select(*by, "n_points", F.when(F.col("n_points") > 1, F.col("_s")).otherwise(F.col("_y") if single is None else single).alias("auc"))


def observed_deletion_curve(steps: DataFrame, baselines: DataFrame) -> DataFrame:
    """Measured losses over the covered share of bytes, starting at the baseline.

    steps: sample_id, step, lo, hi, nll (cumulative deletions, 1-based, in order);
    baselines: sample_id, n, nll. A step adds only the bytes no earlier step covered.
    Elementary pieces of the ranges belong to the first step that covers them. Positions are
    ranked and shares summed over the cluster, so a sample may have any number of steps.
    """
    # a position with its rank and how many ends it is, so that one met by many steps is salted
    ends = steps.select("sample_id", F.explode(F.array("lo", "hi")).alias("pos")).groupBy("sample_id", "pos").agg(F.count(F.lit(1)).alias("_uses"))
    marks = durable(rank_in_group(ends, ["sample_id"], [F.col("pos")], "_i").withColumn("_i", F.col("_i") - 1))
    after = marks.select("sample_id", (F.col("_i") - 1).alias("_i"), F.col("pos").alias("_next"))
    sizes = marks.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_top", F.floor(F.log2(F.col("_n").cast("double"))).cast("int"))
    pieces = marks.join(after, ["sample_id", "_i"]).select("sample_id", "_i", "pos", (F.col("_next") - F.col("pos")).alias("_len"))
    pieces = attach_group(pieces, sizes, ["sample_id"], "_n").drop("_n")
    # A range of pieces is the union of at most two aligned power-of-two blocks per level, so
    # ranges meet pieces through equi joins on blocks instead of a range join.
    at = lambda c, n: marks.select("sample_id", F.col("pos").alias(c), F.col("_i").alias(n), "_uses")
    spans = steps.select("sample_id", "step", "lo", "hi")
    for c, n in (("lo", "_a"), ("hi", "_b")):
        spans = attach_group(spans, at(c, n), ["sample_id", c], "_uses").drop("_uses")

    def blocks(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        lo, hi = F.ceil(F.col("_a") / size), F.floor(F.col("_b") / size)
        first = F.when((lo < hi) & (lo % 2 == 1), F.struct(level.alias("level"), lo.alias("node")))
        last = F.when((lo + lo % 2 < hi) & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).alias("node")))
        return F.array_compact(F.array(first, last))

    nodes = spans.select("sample_id", "step", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), blocks))).alias("n"))
    cover = nodes.groupBy("sample_id", F.col("n.level").alias("level"), F.col("n.node").alias("node")).agg(F.min("step").alias("step"))
    seen = pieces.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    seen = seen.withColumn("node", F.floor(F.col("_i") / F.pow(F.lit(2.0), F.col("level")))).drop("_top")
    # a block of a level holds at most 2^level pieces
    cover = cover.withColumn("_most", F.pow(F.lit(2.0), F.col("level")).cast("bigint"))
    owner = attach_group(seen, cover, ["sample_id", "level", "node"], "_most").groupBy("sample_id", "pos").agg(F.min("step").alias("step"), F.max("_len").alias("_len"))
    fresh = owner.groupBy("sample_id", "step").agg(F.sum("_len").alias("_new"))
    body = steps.join(fresh, ["sample_id", "step"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    body = running_sums(body, ["sample_id"], [F.col("step")], {"_new": "_covered"})
    facts = baselines.select("sample_id", "n", F.col("nll").alias("baseline_nll")).join(steps.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_steps")), "sample_id")
    body = attach_group(body, facts, ["sample_id"], "_steps").withColumn("fraction", F.col("_covered") / F.col("n"))
    start = baselines.select("sample_id", F.lit(0).cast("bigint").alias("step"), "nll", F.col("nll").alias("baseline_nll"), F.lit(0.0).alias("fraction"))
    curve = body.select("sample_id", F.col("step").cast("bigint").alias("step"), "nll", "baseline_nll", "fraction").unionByName(start)
    return curve.withColumn("delta_nll", F.col("nll") - F.col("baseline_nll")).drop("baseline_nll")


def budget_ablation(rows: DataFrame) -> DataFrame:
    """Per (router, upsampler) arm: defined recalls, their mean, mean passes. rows carry recall and passes."""
    return rows.groupBy("router", "upsampler").agg(
        F.count("recall").alias("n"), F.avg("recall").alias("mean_recall"), F.avg("passes").alias("mean_passes"), F.avg("exhaustive_passes").alias("exhaustive_passes")
    )


def necessity(nll: DataFrame) -> DataFrame:
    """Loss added by the evidence and by its control. nll: sample_id, model, role, nll, covered."""
    roles = ["baseline", "evidence", "control"]
    wide = nll.groupBy("sample_id", "model").pivot("role", roles).agg(F.max("nll"))
    covered = nll.filter("role = 'evidence'").groupBy("sample_id", "model").agg(F.max("covered").alias("covered_bytes"))
    e, c = F.col("evidence") - F.col("baseline"), F.col("control") - F.col("baseline")
    return wide.join(covered, ["sample_id", "model"], "left").select(
        "sample_id", "model", e.alias("delta_evidence"), c.alias("delta_control"), (e - c).alias("delta_over_control"), "covered_bytes"
    )


def necessity_vs_control(nll: DataFrame, replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    rows = necessity(nll).select("sample_id", "model", F.col("delta_evidence").alias("treatment"), F.col("delta_control").alias("control"))
    return summarize_paired(rows, ["model"], ["sample_id"], replicates, seed)


def fill_agreement(deltas: DataFrame, primary: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tau per sample and fill, summary per fill); samples with unequal block counts are left out."""
    wide = deltas.withColumn("delta", F.coalesce("delta", F.lit(0.0))).groupBy("sample_id", "block").pivot("fill", [primary, *others]).agg(F.max("delta"))
    long = wide.select("sample_id", "block", F.col(primary).alias("a"), F.explode(F.array(*[F.struct(F.lit(o).alias("fill"), F.col(o).alias("b")) for o in others])).alias("o"))
    long = long.select("sample_id", "block", "a", "o.fill", "o.b")
    # counted beside the rows: they lie by sample already, and a join would move both sides
    w = Window.partitionBy("sample_id", "fill")
    whole = long.withColumn("_na", F.count("a").over(w)).withColumn("_nb", F.count("b").over(w)).filter("_na = _nb and _na > 0").drop("_na", "_nb")
    tau = kendall_tau_b(whole, ["sample_id", "fill"], "a", "b").filter("kendall_tau is not null")
    return tau, tau.groupBy("fill").agg(F.count(F.lit(1)).alias("pairs"), F.avg("kendall_tau").alias("mean_tau"), F.min("kendall_tau").alias("min_tau"))


def calibration_summary(rows: DataFrame, replicates: int = 1000, seed: str | int = 0) -> tuple[DataFrame, DataFrame]:
    """(means and hit rates, paired gap). rows: pair_id, positive, byte_iou; a pair shares its host."""
    pos = F.col("positive")
    hit = (F.col("byte_iou") > 0).cast("double")
    one = rows.agg(
        F.count(F.when(pos, F.lit(1))).alias("positives"), F.count(F.when(~pos, F.lit(1))).alias("negatives"),
        F.avg(F.when(pos, F.col("byte_iou"))).alias("mean_iou_positive"), F.avg(F.when(~pos, F.col("byte_iou"))).alias("mean_iou_negative"),
        F.avg(F.when(pos, hit)).alias("hit_rate_positive"), F.avg(F.when(~pos, hit)).alias("false_hit_rate"),
    )
    pairs = rows.groupBy("pair_id").agg(F.max(F.when(pos, F.col("byte_iou"))).alias("treatment"), F.max(F.when(~pos, F.col("byte_iou"))).alias("control"))
    gap = summarize_paired(pairs.withColumn("label", F.lit("positive vs negative")), ["label"], ["pair_id"], replicates, seed)
    return one, gap


def sensitivity_summary(rows: DataFrame, replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Per fraction: counts, means, and a paired interval when at least two controls exist.

    rows: sample_id, fraction, recognized, delta_evidence, delta_control (nullable).
    """
    rec = F.col("recognized")
    base = rows.groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(rec, F.lit(1))).alias("n_recognized"), F.avg("delta_evidence").alias("mean_evidence"),
        F.count("delta_control").alias("n_control"), F.avg("delta_control").alias("mean_control"), F.avg(F.when(rec, F.col("delta_evidence"))).alias("mean_evidence_recognized"),
    )
    pairs = rows.select("sample_id", "fraction", F.col("delta_evidence").alias("treatment"), F.col("delta_control").alias("control"))
    tested = summarize_paired(pairs, ["fraction"], ["sample_id"], replicates, seed).filter("n_pairs >= 2").select("fraction", "estimate", "low", "high")
    return base.join(tested, "fraction", "left")
