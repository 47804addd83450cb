"""Intervals, paired tests and effect sizes on long tables.

Resampling draws are hashes of (seed, row key, replicate). The default mode gives
every row a Poisson(1) weight per replicate, which needs one pass and shuffles
``groups x replicates`` partial sums, never the resampled rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.hashing import hash_hex, index_draw, poisson_weight, positive_weight
from spanframe.functions.ranking import attach_group, order_values, rank_in_group, running_sums
from spanframe.session import durable

# Two-sided 95 % critical values of the t distribution by sample size.
T_CRITICAL_95 = {2: 12.706205, 3: 4.302653, 4: 3.182446, 5: 2.776445, 6: 2.570582}


def t_critical(n: Column, largest: int = 6) -> Column:
    out = F.lit(None).cast("double")
    for size, value in T_CRITICAL_95.items():
        if size <= largest:
            out = F.when(n == size, F.lit(value)).otherwise(out)
    return out


def replicate_weights(df: DataFrame, key: list[str], replicates: int, seed: str | int) -> DataFrame:
    """``df`` with (rep, w) rows for every positive Poisson weight; one hash serves eight replicates."""
    chunks = -(-replicates // 8)
    drawn = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("_h", hash_hex(seed, *key, "_c"))
    digits = F.array(*[F.substring("_h", 8 * j + 1, 8) for j in range(8)])
    drawn = drawn.select(*df.columns, "_c", F.posexplode(digits).alias("_j", "_d")).filter(positive_weight(F.col("_d")))
    return drawn.select(
        *df.columns, (F.col("_c") * 8 + F.col("_j")).alias("rep"), poisson_weight(F.col("_d")).alias("w")
    ).filter(F.col("rep") < replicates)


def bootstrap_replicates(df: DataFrame, by: list[str], x: str, key: list[str], replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Weighted mean per (group, replicate)."""
    base = df.filter(F.col(x).isNotNull()).select(*dict.fromkeys([*by, *key]), F.col(x).alias("_x"))
    return replicate_weights(base, key, replicates, seed).groupBy(*by, "rep").agg(
        (F.sum(F.col("w") * F.col("_x")) / F.sum("w")).alias("boot_mean")
    )


def bootstrap_exact(df: DataFrame, by: list[str], x: str, order: list[str], replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Multinomial resampling: each of n draws picks a row index by hash.

    Every row contributes one draw per replicate, so draws are spread like the rows;
    picks are counted per index before they meet the values.
    """
    base = df.filter(F.col(x).isNotNull()).select(*dict.fromkeys([*by, *order]), F.col(x).alias("_x"))
    ranked = rank_in_group(base, by, [F.col(c).asc() for c in order], "_i")
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(sizes, by) if by else ranked.join(F.broadcast(sizes))
    draws = rows.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    picks = draws.withColumn("_i", index_draw("_n", seed, *by, "rep", "_i") + 1).groupBy(*by, "rep", "_i").agg(
        F.count(F.lit(1)).alias("w")
    )
    return picks.join(ranked.select(*by, "_i", "_x"), [*by, "_i"]).groupBy(*by, "rep").agg(
        (F.sum(F.col("w") * F.col("_x")) / F.sum("w")).alias("boot_mean")
    )


def percentile_interval(reps: DataFrame, by: list[str], value: str = "boot_mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval; a group holds one row per replicate, so the exact percentile is bounded."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return reps.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def bootstrap_mean(df, by: list[str], x: str, key: list[str], replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Mean with a percentile bootstrap interval."""
    centre = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("estimate"))
    reps = bootstrap_replicates(df, by, x, key, replicates, seed)
    return centre.join(percentile_interval(reps, by), by)


def mean_ci_t(df, by: list[str], x: str, key: list[str], replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """One value: degenerate; two to six: t table; more: bootstrap."""
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("estimate"), F.stddev_samp(x).alias("_sd"))
    many = base.filter("n > 6").select(*by)
    boot = percentile_interval(bootstrap_replicates(df.join(many, by, "left_semi"), by, x, key, replicates, seed), by)
    n, est = F.col("n"), F.col("estimate")
    margin = t_critical(n) * F.col("_sd") / F.sqrt(n.cast("double"))
    method = F.when(n == 1, "single-observation").when(n <= 6, F.concat(F.lit("t("), (n - 1).cast("string"), F.lit(")"))).otherwise(f"bootstrap-{replicates}")
    out = base.filter("n > 0").join(boot.withColumnRenamed("low", "_bl").withColumnRenamed("high", "_bh"), by, "left")
    low = F.when(n == 1, est).when(n <= 6, est - margin).otherwise(F.col("_bl"))
    high = F.when(n == 1, est).when(n <= 6, est + margin).otherwise(F.col("_bh"))
    return out.select(*by, "n", "estimate", low.alias("low"), high.alias("high"), method.alias("method")).withColumn(
        "excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)
    )


def with_difference(pairs: DataFrame, left: str = "treatment", right: str = "control") -> DataFrame:
    return pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("diff", F.col(left) - F.col(right))


def cohens_d(mean: Column, sd: Column, n: Column) -> Column:
    """Paired effect size: null below two pairs; no spread gives infinity or zero."""
    return F.when(n < 2, F.lit(None).cast("double")).when(
        sd == 0, F.when(mean != 0, F.lit(float("inf"))).otherwise(0.0)
    ).otherwise(mean / sd)


def cohens_d_paired(pairs: DataFrame, by: list[str], left: str = "treatment", right: str = "control") -> DataFrame:
    d = with_difference(pairs, left, right).groupBy(*by).agg(
        F.count("diff").alias("n"), F.avg("diff").alias("_m"), F.stddev_samp("diff").alias("_sd")
    )
    return d.select(*by, "n", cohens_d(F.col("_m"), F.col("_sd"), F.col("n")).alias("cohens_d"))


def paired_bootstrap(pairs: DataFrame, by: list[str], key: list[str], replicates: int = 1000, seed: str | int = 0,
                     left: str = "treatment", right: str = "control") -> DataFrame:
    """Interval and two-sided p-value of the mean difference from the same replicates."""
    diffs = with_difference(pairs, left, right)
    reps = bootstrap_replicates(diffs, by, "diff", key, replicates, seed)
    q = F.percentile("boot_mean", F.array(F.lit(0.025), F.lit(0.975)))
    tail = lambda c: F.avg(c.cast("double"))
    boot = reps.groupBy(*by).agg(
        q.alias("_q"), tail(F.col("boot_mean") <= 0).alias("_le"), tail(F.col("boot_mean") >= 0).alias("_ge")
    )
    centre = diffs.groupBy(*by).agg(F.count("diff").alias("n_pairs"), F.avg("diff").alias("estimate"), F.stddev_samp("diff").alias("_sd"))
    return centre.join(boot, by).select(
        *by, "n_pairs", "estimate", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"),
        F.least(F.lit(1.0), 2.0 * F.least("_le", "_ge")).alias("p_value"),
        cohens_d(F.col("estimate"), F.col("_sd"), F.col("n_pairs")).alias("cohens_d"),
    )


def bootstrap_pvalue(pairs, by, key, replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    return paired_bootstrap(pairs, by, key, replicates, seed).select(*by, "n_pairs", "p_value")


def summarize_paired(pairs: DataFrame, by: list[str], key: list[str], replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Pair count, both means, interval of the difference and effect size."""
    means = with_difference(pairs).groupBy(*by).agg(F.avg("treatment").alias("mean_treatment"), F.avg("control").alias("mean_control"))
    return paired_bootstrap(pairs, by, key, replicates, seed).drop("p_value").join(means, by)


#: Groups of up to so many distinct (x, y) are compared pair by pair inside their row.
SMALL_GROUP = 64


def kendall_tau_b(df: DataFrame, by: list[str], x: str, y: str, small: int = SMALL_GROUP) -> DataFrame:
    """Tau-b per group; a group may span any number of tasks.

    A group of at most ``small`` distinct (x, y) travels as one array and its pairs are compared
    there; the others, if any, go by bit levels. Both ways are exact and give the same numbers.
    Rows with a null value or key take no part.
    """
    whole = [F.col(c).isNotNull() for c in [*by, x, y]]
    r = df.filter(reduce(lambda a, b: a & b, whole)).groupBy(*by, F.col(x).alias("rx"), F.col(y).alias("ry")).agg(F.count(F.lit(1)).alias("_c"))
    r = durable(r)
    large = r.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small)
    if large.isEmpty():
        return _tau(_small_counts(r, by), by)
    large = durable(large.select(*by))
    few = _tau(_small_counts(r.join(large, by, "left_anti"), by), by)
    return few.unionByName(_tau(_level_counts(r.join(large, by, "left_semi"), by), by))


def _tau(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts: by, _n rows, tied pairs of each side, _s concordant less discordant pairs."""
    n = F.col("_n")
    pairs = n * (n - 1) / 2
    den = F.sqrt((pairs - F.col("_tie_rx")) * (pairs - F.col("_tie_ry")))
    return counts.select(*by, n.alias("n"), F.when(den > 0, F.coalesce("_s", F.lit(0)) / F.when(den > 0, den)).alias("kendall_tau"))


def _small_counts(r: DataFrame, by: list[str]) -> DataFrame:
    """The counts of ``_tau`` from one array per group, unfolded into its pairs where it lies."""
    groups = r.groupBy(*by).agg(F.collect_list(F.struct("rx", "ry", "_c")).alias("_cells"), F.sum("_c").alias("_n"))
    pairs = groups.select(*by, "_n", "_cells", F.explode("_cells").alias("_a")).select(*by, "_n", "_a", F.explode("_cells").alias("_b"))
    n, zero = F.col("_a._c") * F.col("_b._c"), F.lit(0).cast("bigint")
    above, below = F.col("_a.ry") > F.col("_b.ry"), F.col("_a.ry") < F.col("_b.ry")
    # a pair counts once, at its row of larger x
    order = F.when(F.col("_a.rx") > F.col("_b.rx"), F.when(above, n).when(below, -n).otherwise(zero)).otherwise(zero)
    # a value met t times gives t^2 ordered pairs, those of a row with itself included
    tied = lambda c: ((F.sum(F.when(F.col(f"_a.{c}") == F.col(f"_b.{c}"), n).otherwise(zero)) - F.col("_n")) / 2).alias(f"_tie_{c}")
    return pairs.groupBy(*by, "_n").agg(tied("rx"), tied("ry"), F.sum(order).alias("_s"))


def _level_counts(r: DataFrame, by: list[str]) -> DataFrame:
    """The counts of ``_tau`` without enumerating pairs; r is written.

    Two rows with different x-ranks differ first at exactly one bit, counted from the top.
    For each bit, rows sharing the higher bits form a block, in which a running count over y
    says how many zero-bit rows lie below and above each one-bit row. Equal (x, y) share a
    row and equal y of a block do, ranks and running counts come from sorts over the
    cluster. Work is distinct (x, y) x log2(distinct x).
    """
    values = r.groupBy(*by, "rx").agg(F.count(F.lit(1)).alias("_rows"))
    top = values.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("_max"), F.sum("_rows").alias("_all"))
    places = rank_in_group(values, by, [F.col("rx")], "_place")
    placed = attach_group(r, places, [*by, "rx"], "_rows").select(*by, (F.col("_place") - 1).alias("_at"), "ry", "_c")
    placed = attach_group(placed, top.select(*by, "_max", "_all"), by, "_all")
    bits = F.when(F.col("_max") > 0, F.sequence(F.lit(0), F.floor(F.log2(F.col("_max").cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    levels = placed.withColumn("_b", F.explode(bits)).select(
        *by, "_b", F.expr("shiftright(_at, _b + 1)").alias("_p"), "ry", "_c", (F.expr("shiftright(_at, _b) & 1") == 1).alias("_one"))
    block = [*by, "_b", "_p"]
    cells = levels.groupBy(*block, "ry").agg(
        F.sum(F.when(~F.col("_one"), F.col("_c")).otherwise(0)).alias("_z"), F.sum(F.when(F.col("_one"), F.col("_c")).otherwise(0)).alias("_o"))
    cum = running_sums(cells, block, [F.col("ry")], {"_z": "_upto"})
    # below less above: (upto - z) - (total - upto) for each one-bit row
    per = cum.groupBy(*block).agg(F.sum(F.col("_o") * (2 * F.col("_upto") - F.col("_z"))).alias("_s"), F.sum("_z").alias("_zs"), F.sum("_o").alias("_os"))
    score = per.groupBy(*by).agg(F.sum(F.col("_s") - F.col("_zs") * F.col("_os")).alias("_s"))

    def tied(c: str) -> DataFrame:
        t = r.groupBy(*by, c).agg(F.sum("_c").alias("_t"))
        return t.groupBy(*by).agg(F.sum(F.col("_t") * (F.col("_t") - 1) / 2).alias(f"_tie_{c}"), F.sum("_t").alias(f"_n_{c}"))

    return tied("rx").join(tied("ry"), by).join(score, by, "left").withColumnRenamed("_n_rx", "_n")


def holm(df: DataFrame, family: list[str], p: str, tie: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down correction; ``tie`` fixes the order of equal p-values.

    A family is a list of planned comparisons, so its window is small by design.
    """
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(F.col(p), *tie)
    m = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(ordered)
    ok = (F.col(p) <= alpha / (m - rank + 1)).cast("int")
    out = df.withColumn("_ok", ok)
    passed = F.min("_ok").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("holm_reject", passed == 1).drop("_ok")


QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def nearest_rank_quantiles(df: DataFrame, by: list[str], x: str, probs: dict[str, float] = QUANTILES, digits: int = 6) -> DataFrame:
    """Order statistic at ``round(p*(n-1))`` (half to even), one column per quantile."""
    rows = order_values(df, by, x, {t: (lambda n, p=p: F.bround(F.lit(p) * (n - 1))) for t, p in probs.items()})
    return rows.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.round(F.max(F.when(F.col("tag") == t, F.col("value"))), digits).alias(t) for t in probs]
    )


def aggregate_runs(runs: DataFrame, by: list[str] = ("config", "mode", "metric"), value: str = "value") -> DataFrame:
    """Mean, spread, t interval (two to five runs), extremes per configuration.

    A metric without any value is ``not_measured``; a repeated (config, seed) makes
    the row ``refused``.
    """
    n = F.count(value)
    agg = runs.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.count("seed") - F.count_distinct("seed")).alias("_repeats"),
    )
    margin = t_critical(F.col("n"), 5) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    status = F.when(F.col("_repeats") > 0, "refused").when(F.col("n") == 0, "not_measured").otherwise("measured")
    return agg.select(*by, "n", "mean", "sd", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"), "min", "max", status.alias("status"))


def paired_run_differences(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Same-seed ``right - left`` per mode and metric; fewer than two shared seeds give no row."""
    side = F.col("config")
    paired = runs.filter(side.isin(left, right)).groupBy("mode", "metric", "seed").agg(
        F.max(F.when(side == left, F.col("value"))).alias("_l"), F.max(F.when(side == right, F.col("value"))).alias("_r")
    )
    d = paired.filter("_l is not null and _r is not null").withColumn("diff", F.col("_r") - F.col("_l"))
    agg = d.groupBy("mode", "metric").agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd")).filter("n >= 2")
    margin = t_critical(F.col("n"), 5) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return agg.select("mode", "metric", "n", "mean", "sd", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def stratified_bootstrap(pred: DataFrame, key: list[str], replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Interval of accuracy, macro-F1 and macro-recall under per-class resampling.

    Rows collapse to (replicate, truth, prediction) weights right away; each true
    class is rescaled to its own size, so class shares never move.
    """
    base = pred.select(*key, "truth", "pred")
    cells = replicate_weights(base, key, replicates, seed).groupBy("rep", "truth", "pred").agg(F.sum("w").cast("double").alias("w"))
    sizes = base.groupBy("truth").agg(F.count(F.lit(1)).alias("_n"))
    drawn = cells.groupBy("rep", "truth").agg(F.sum("w").alias("_w"))
    scale = drawn.join(sizes, "truth").select("rep", "truth", (F.col("_n") / F.col("_w")).alias("_f"))
    cells = cells.join(scale, ["rep", "truth"]).withColumn("w", F.col("w") * F.col("_f"))
    hit = F.when(F.col("truth") == F.col("pred"), F.col("w")).otherwise(0.0)
    by_truth = cells.groupBy("rep", F.col("truth").alias("label")).agg(F.sum("w").alias("_sup"), F.sum(hit).alias("_tp"))
    by_pred = cells.groupBy("rep", F.col("pred").alias("label")).agg(F.sum("w").alias("_prd"))
    per = by_truth.join(by_pred, ["rep", "label"], "full").na.fill(0.0)
    f1 = F.when(F.col("_sup") + F.col("_prd") > 0, 2 * F.col("_tp") / (F.col("_sup") + F.col("_prd"))).otherwise(0.0)
    rec = F.when(F.col("_sup") > 0, F.col("_tp") / F.when(F.col("_sup") > 0, F.col("_sup"))).otherwise(0.0)
    reps = per.groupBy("rep").agg(
        (F.sum("_tp") / F.sum("_sup")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.avg(rec).alias("macro_recall")
    )
    long = reps.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "macro_f1", "macro_recall")])).alias("m"))
    return percentile_interval(long.select("m.metric", "m.v"), ["metric"], "v")


def cluster_bootstrap(df: DataFrame, by: list[str], x: str, cluster: str, replicates: int = 1000, seed: str | int = 0) -> DataFrame:
    """Mean whose resampling unit is the cluster: a cluster's rows share one weight."""
    parts = df.filter(F.col(x).isNotNull()).groupBy(*by, cluster).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))
    reps = replicate_weights(parts, [cluster], replicates, seed).groupBy(*by, "rep").agg(
        (F.sum(F.col("w") * F.col("_s")) / F.sum(F.col("w") * F.col("_n"))).alias("boot_mean")
    )
    centre = parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), (F.sum("_s") / F.sum("_n")).alias("estimate"))
    return centre.join(percentile_interval(reps, by), by)
