"""H1-H4, H7-H11, J1-J9, L1-L3, L5."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import budget, classify, evidence, intervals
from spanframe.plans import flagship
from spanframe.plans.interval_queries import RATIO
from spanframe.plans.registry import query
from spanframe.plans.sql_parts import EVAL, RANKS
from spanframe.plans.stats_queries import TAU, _r, reps_sql
from spanframe.plans.views import table, view

B = 200


@query("h1_evidence_mass", "select sample_id, fill, round(sum(greatest(coalesce(delta, 0), 0)), 6) as mass from v_delta group by 1, 2", ("v_delta",))
def h1(spark, sf):
    return _r(evidence.evidence_mass(view(spark, sf, "v_delta"), ["sample_id", "fill"]), "mass")


SEL = """rk as (select *, row_number() over (partition by sample_id, fill order by coalesce(delta, 0) desc, block) as r, count(*) over (partition by sample_id, fill) as n from v_delta),
zs as (select sample_id, block, r <= greatest(1, ceil(0.25 * n)) as selected from rk where fill = 'zero'),
pr as (select d.sample_id, d.block, d.delta, zs.selected from v_delta d join zs on zs.sample_id = d.sample_id and zs.block = d.block where d.fill = 'primary')"""


def _selected(spark, sf):
    from pyspark.sql import Window

    d = view(spark, sf, "v_delta")
    n = F.count(F.lit(1)).over(Window.partitionBy("sample_id"))
    z = d.filter("fill = 'zero'").withColumn("n", n).withColumn("r", budget.rank_by(F.coalesce("delta", F.lit(0.0)), "sample_id", "block"))
    z = z.select("sample_id", "block", (F.col("r") <= budget.budget_size(F.col("n"), 0.25)).alias("selected"))
    return d.filter("fill = 'primary'").join(z, ["sample_id", "block"])


@query("h2_recall_at_budget", f"with {SEL} select sample_id, count(*) filter (selected) as k, round(case when sum(greatest(coalesce(delta, 0), 0)) > 0 then coalesce(sum(greatest(coalesce(delta, 0), 0)) filter (selected), 0) / sum(greatest(coalesce(delta, 0), 0)) end, 9) as recall from pr group by 1", ("v_delta",))
def h2(spark, sf):
    return _r(evidence.recall_at_budget(_selected(spark, sf), ["sample_id"]), "recall", digits=9)


CURVE = """cv as (select sample_id, fill, row_number() over w as step, 1.5 + sum(coalesce(delta, 0)) over (w rows unbounded preceding) as nll, row_number() over w / count(*) over (partition by sample_id, fill)::double as fraction
 from v_delta window w as (partition by sample_id, fill order by coalesce(delta, 0) desc, block))"""


def _curve(spark, sf):
    order = [F.coalesce("delta", F.lit(0.0)).desc(), F.col("block")]
    return evidence.deletion_curve(view(spark, sf, "v_delta"), ["sample_id", "fill"], order, F.lit(1.5))


@query("h3_deletion_curve", f"with {CURVE} select sample_id, fill, step, round(nll, 6) as nll, round(fraction, 9) as fraction from cv", ("v_delta",))
def h3(spark, sf):
    c = _curve(spark, sf).select("sample_id", "fill", F.col("step").cast("bigint").alias("step"), "nll", "fraction")
    return _r(_r(c, "nll"), "fraction", digits=9)


@query(
    "h3_deletion_auc",
    f"""with {CURVE}, a as (select *, (fraction - lag(fraction) over w) * (nll + lag(nll) over w) / 2 as ar from cv window w as (partition by sample_id, fill order by step))
    select sample_id, fill, count(*) as n_points, round(case when count(*) > 1 then sum(ar) else max(nll) end, 6) as auc from a group by 1, 2""",
    ("v_delta",),
)
def h3a(spark, sf):
    return _r(evidence.trapezoid_auc(_curve(spark, sf), ["sample_id", "fill"], "fraction", "nll", "step"), "auc")


STEPS = """st as (select key as sample_id, row_number() over (partition by key order by event_id) as step, lo, hi, 2.0 + event_id % 17 / 10.0 as nll from (select user_id as key, event_id, event_type, (event_id * 7) % 5000 as lo, (event_id * 7) % 5000 + 1 + 100 * (event_id % 4) as hi from events) x),
ed as (select distinct sample_id, unnest([lo, hi]) as pos from st), pc as (select sample_id, pos, lead(pos) over (partition by sample_id order by pos) as nx from ed),
ow as (select p.sample_id, p.pos, min(step) as step, max(nx - pos) as len from st join pc p on p.sample_id = st.sample_id and p.pos >= st.lo and p.nx <= st.hi group by 1, 2),
fr as (select sample_id, step, sum(len) as nw from ow group by 1, 2),
cv as (select st.sample_id, st.step, nll, sum(coalesce(nw, 0)) over (partition by st.sample_id order by st.step rows unbounded preceding) / 6000.0::double as fraction from st left join fr on fr.sample_id = st.sample_id and fr.step = st.step
 union all select distinct sample_id, 0, 1.5, 0 from st)"""


def _observed(spark, sf):
    e = table(spark, sf, "events")
    lo = (F.col("event_id") * 7) % 5000
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    st = e.select(F.col("user_id").alias("sample_id"), step.alias("step"), lo.alias("lo"), (lo + 1 + 100 * (F.col("event_id") % 4)).alias("hi"), (2.0 + F.col("event_id") % 17 / 10.0).alias("nll"))
    base = e.select(F.col("user_id").alias("sample_id")).distinct().select("sample_id", F.lit(6000).alias("n"), F.lit(1.5).alias("nll"))
    return evidence.observed_deletion_curve(st, base)


@query("h4_observed_deletion_curve", f"with {STEPS} select sample_id, step, round(nll, 6) as nll, round(nll - 1.5, 6) as delta_nll, round(fraction, 9) as fraction from cv")
def h4(spark, sf):
    return _r(_r(_observed(spark, sf), "nll", "delta_nll"), "fraction", digits=9)


@query(
    "h4_observed_deletion_auc",
    f"""with {STEPS}, a as (select *, (fraction - lag(fraction) over w) * (nll + lag(nll) over w) / 2 as ar from cv window w as (partition by sample_id order by step))
    select sample_id, count(*) as n_points, round(coalesce(sum(ar), 0), 6) as auc from a group by 1""",
)
def h4a(spark, sf):
    return _r(evidence.trapezoid_auc(_observed(spark, sf), ["sample_id"], "fraction", "nll", "step", F.lit(0.0)), "auc")


@query(
    "h7_budget_ablation",
    """with a as (select *, row_number() over (partition by sample_id, fill order by coalesce(delta, 0) desc, block) as rd, row_number() over (partition by sample_id, fill order by sha256(concat_ws('|', 'arm', sample_id, block)), block) as rr, count(*) over (partition by sample_id, fill) as n from v_delta),
    z as (select sample_id, block, rd as rz from a where fill = 'zero'), p as (select a.*, rz from a join z using (sample_id, block) where fill = 'primary'),
    l as (select sample_id, delta, n, greatest(1, cast(ceil(0.25 * n) as bigint)) as k, 'coarse' as router, 'linear' as upsampler, rz as r from p union all select sample_id, delta, n, greatest(1, cast(ceil(0.25 * n) as bigint)), 'random', 'none', rr from p),
    s as (select sample_id, router, upsampler, case when sum(greatest(coalesce(delta, 0), 0)) > 0 then coalesce(sum(greatest(coalesce(delta, 0), 0)) filter (r <= k), 0) / sum(greatest(coalesce(delta, 0), 0)) end as recall, max(k) + 1 + case when router = 'coarse' then max(n) + 1 else 0 end as passes, max(n) + 1 as ex from l group by 1, 2, 3)
    select router, upsampler, count(recall) as n, round(avg(recall), 9) as mean_recall, round(avg(passes), 6) as mean_passes, round(avg(ex), 6) as exhaustive_passes from s group by 1, 2""",
    ("v_delta",),
)
def h7(spark, sf):
    from pyspark.sql import Window

    d = view(spark, sf, "v_delta")
    z = d.filter("fill = 'zero'").withColumn("rz", budget.rank_by(F.coalesce("delta", F.lit(0.0)), "sample_id", "block")).select("sample_id", "block", "rz")
    p = d.filter("fill = 'primary'").join(z, ["sample_id", "block"]).withColumn("rr", budget.random_order("arm", "sample_id", "block"))
    p = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sample_id"))).withColumn("k", budget.budget_size(F.col("n"), 0.25))
    arms = F.array(F.struct(F.lit("coarse").alias("router"), F.lit("linear").alias("upsampler"), F.col("rz").alias("r")), F.struct(F.lit("random").alias("router"), F.lit("none").alias("upsampler"), F.col("rr").alias("r")))
    long = p.withColumn("a", F.explode(arms)).select("sample_id", "delta", "n", "k", "a.*").withColumn("selected", F.col("r") <= F.col("k"))
    keys = ["sample_id", "router", "upsampler"]
    cost = long.groupBy(*keys).agg(F.max("k").alias("k"), F.max("n").alias("n"))
    passes = F.when(F.col("router") == "coarse", budget.routing_cost(F.col("n"), F.col("k"), "coarse")).otherwise(budget.routing_cost(F.col("n"), F.col("k"), "random"))
    rows = evidence.recall_at_budget(long, keys).drop("k").join(cost, keys).withColumn("passes", passes).withColumn("exhaustive_passes", F.col("n") + 1)
    return _r(_r(evidence.budget_ablation(rows), "mean_passes", "exhaustive_passes"), "mean_recall", digits=9)


NLL = """pp as (select sample_id, stratum as model, treatment / 10007.3::double as e, control / 10007.3::double as c, 1.25 as b from v_pair)"""


def _nll(spark, sf):
    p = view(spark, sf, "v_pair")
    cell = lambda r, v: F.struct(F.lit(r).alias("role"), v.alias("nll"))
    rows = F.array(cell("baseline", F.lit(1.25)), cell("evidence", F.col("treatment") / 10007.3), cell("control", F.col("control") / 10007.3))
    return p.select("sample_id", F.col("stratum").alias("model"), F.explode(rows).alias("r")).select("sample_id", "model", "r.role", "r.nll", (F.col("sample_id") % 100).alias("covered"))


@query("h8_necessity", f"with {NLL} select sample_id, model, round(e - b, 6) as delta_evidence, round(c - b, 6) as delta_control, round(e - c, 6) as delta_over_control, sample_id % 100 as covered_bytes from pp", ("v_pair",))
def h8n(spark, sf):
    return _r(evidence.necessity(_nll(spark, sf)), "delta_evidence", "delta_control", "delta_over_control")


@query(
    "h8_necessity_vs_control",
    f"""with {NLL}, dd as (select sample_id, model, (e - b) - (c - b) as diff, e - b as t, c - b as k from pp), {reps_sql("dd", "model", "diff", "sample_id", "nec")},
    q as (select model, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from bm group by 1)
    select model, count(*) as n_pairs, round(avg(diff), 6) as estimate, round(any_value(low), 6) as low, round(any_value(high), 6) as high, round(avg(diff) / stddev_samp(diff), 6) as cohens_d, round(avg(t), 6) as mean_treatment, round(avg(k), 6) as mean_control from dd join q using (model) group by model""",
    ("v_pair",),
)
def h8(spark, sf):
    return _r(evidence.necessity_vs_control(_nll(spark, sf), B, "nec"), "estimate", "low", "high", "cohens_d", "mean_treatment", "mean_control")


@query("h9_fill_agreement", f"with {TAU.format(key='sample_id')} select k as sample_id, 'zero' as fill, n, round(kendall_tau, 9) as kendall_tau from tau where kendall_tau is not null", ("v_delta",))
def h9(spark, sf):
    return _r(evidence.fill_agreement(view(spark, sf, "v_delta"), "primary", ["zero"])[0], "kendall_tau", digits=9)


@query("h9_fill_summary", f"with {TAU.format(key='sample_id')} select 'zero' as fill, count(*) as pairs, round(avg(kendall_tau), 9) as mean_tau, round(min(kendall_tau), 9) as min_tau from tau where kendall_tau is not null", ("v_delta",))
def h9s(spark, sf):
    return _r(evidence.fill_agreement(view(spark, sf, "v_delta"), "primary", ["zero"])[1], "mean_tau", "min_tau", digits=9)


CAL = RATIO.format(empty="0.0::double", name="byte_iou").replace("from uni left join", "from uni left join")


def _calibration(spark, sf):
    v = view(spark, sf, "v_iv")
    a, b = v.filter("set_id = 'A'"), v.filter("set_id = 'B'")
    pos = intervals.byte_iou(a, b, ["key"])
    wide = b.select("key", F.col("lo") + 1800, F.col("hi") + 5400).toDF("key", "lo", "hi")
    neg = intervals.byte_iou(a, wide, ["key"])
    rows = pos.select(F.col("key").alias("pair_id"), F.lit(True).alias("positive"), "byte_iou").unionByName(neg.select(F.col("key").alias("pair_id"), F.lit(False).alias("positive"), "byte_iou"))
    return evidence.calibration_summary(rows, B, "cal")


IOU = """{n}_e as (select key, s, pos, sum(d) as d from (select key, set_id as s, {lo} as pos, 1 as d from v_iv union all select key, set_id, {hi}, -1 from v_iv) group by 1, 2, 3),
{n}_g as (select key, pos, coalesce(sum(d) filter (s = 'A'), 0) as a, coalesce(sum(d) filter (s = 'B'), 0) as b from {n}_e group by 1, 2),
{n}_s as (select key, lead(pos) over w - pos as len, sum(a) over w as da, sum(b) over w as db from {n}_g window w as (partition by key order by pos)),
{n} as (select key, coalesce(sum(len) filter (da > 0 and db > 0), 0)::double / sum(len) filter (da > 0 or db > 0) as iou from {n}_s group by 1)"""
CALS = IOU.format(n="ps", lo="lo", hi="hi") + ", " + IOU.format(n="ng", lo="case when set_id = 'B' then lo + 1800 else lo end", hi="case when set_id = 'B' then hi + 5400 else hi end")


@query(
    "h10_calibration_summary",
    f"""with {CALS} select (select count(*) from ps) as positives, (select count(*) from ng) as negatives, round((select avg(iou) from ps), 9) as mean_iou_positive, round((select avg(iou) from ng), 9) as mean_iou_negative,
    round((select avg((iou > 0)::int::double) from ps), 9) as hit_rate_positive, round((select avg((iou > 0)::int::double) from ng), 9) as false_hit_rate""",
    ("v_iv",),
)
def h10(spark, sf):
    return _r(_calibration(spark, sf)[0], "mean_iou_positive", "mean_iou_negative", "hit_rate_positive", "false_hit_rate", digits=9)


@query(
    "h10_calibration_gap",
    f"""with {CALS}, dd as (select ps.key as pair_id, 'positive vs negative' as label, ps.iou as t, ng.iou as c, ps.iou - ng.iou as diff from ps join ng on ng.key = ps.key), {reps_sql("dd", "label", "diff", "pair_id", "cal")},
    q as (select label, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from bm group by 1)
    select label, count(*) as n_pairs, round(avg(diff), 6) as estimate, round(any_value(low), 6) as low, round(any_value(high), 6) as high, round(avg(diff) / stddev_samp(diff), 6) as cohens_d, round(avg(t), 6) as mean_treatment, round(avg(c), 6) as mean_control from dd join q using (label) group by label""",
    ("v_iv",),
)
def h10g(spark, sf):
    return _r(_calibration(spark, sf)[1], "estimate", "low", "high", "cohens_d", "mean_treatment", "mean_control")


@query(
    "h11_sensitivity_summary",
    f"""with s as (select sample_id, (sample_id % 5 + 1) / 10.0::double as fraction, treatment > 30000 as recognized, treatment / 7.3 as e, case when stratum <> 'P' then control / 7.3 end as c from v_pair),
    dd as (select *, e - c as diff from s where c is not null), {reps_sql("dd", "fraction", "diff", "sample_id", "sens")},
    q as (select fraction, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from bm group by 1), a as (select fraction, avg(diff) as est from dd group by 1)
    select s.fraction, count(*) as n, count(*) filter (recognized) as n_recognized, round(avg(e), 5) as mean_evidence, count(c) as n_control, round(avg(c), 5) as mean_control, round(avg(e) filter (recognized), 5) as mean_evidence_recognized,
    round(any_value(est), 5) as estimate, round(any_value(low), 5) as low, round(any_value(high), 5) as high from s left join q on q.fraction = s.fraction left join a on a.fraction = s.fraction group by s.fraction""",
    ("v_pair",),
)
def h11(spark, sf):
    p = view(spark, sf, "v_pair")
    rows = p.select("sample_id", ((F.col("sample_id") % 5 + 1) / 10.0).alias("fraction"), (F.col("treatment") > 30000).alias("recognized"),
                    (F.col("treatment") / 7.3).alias("delta_evidence"), F.when(F.col("stratum") != "P", F.col("control") / 7.3).alias("delta_control"))
    return _r(evidence.sensitivity_summary(rows, B, "sens"), "mean_evidence", "mean_control", "mean_evidence_recognized", "estimate", "low", "high", digits=5)


CONF = """gc as (select a.c as truth, b.c as pred from (select unnest([0, 1, 2]) as c) a cross join (select unnest([0, 1, 2]) as c) b),
cf as (select gc.truth, gc.pred, count(p.sample_id) as n from gc left join v_pred p on p.truth = gc.truth and p.pred = gc.pred group by 1, 2),
tr as (select truth as label, cast(sum(n) as bigint) as support, cast(sum(n) filter (truth = pred) as bigint) as tp from cf group by 1), pd as (select pred as label, cast(sum(n) as bigint) as predicted from cf group by 1),
rp as (select *, case when predicted > 0 then tp::double / predicted else 0 end as precision, case when support > 0 then tp::double / support else 0 end as recall from tr join pd using (label)),
cr as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rp)"""


def _report(spark, sf):
    return classify.class_report(classify.confusion(view(spark, sf, "v_pred"), [0, 1, 2]))


@query("j1_confusion", f"with {CONF} select truth, pred, n from cf", ("v_pred",))
def j1(spark, sf):
    return classify.confusion(view(spark, sf, "v_pred"), [0, 1, 2])


@query("j2_class_report", f"with {CONF} select label, support, tp, predicted, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from cr", ("v_pred",))
def j2(spark, sf):
    return _r(_report(spark, sf), "precision", "recall", "f1", digits=9)


@query("j2_report_totals", f"with {CONF} select round(sum(tp) / sum(support), 9) as accuracy, round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from cr", ("v_pred",))
def j2t(spark, sf):
    return _r(classify.report_totals(_report(spark, sf)), "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", digits=9)


@query("j3_macro_f1_present", f"with {CONF} select round(avg(f1) filter (support > 0), 9) as macro_f1_present from cr", ("v_pred",))
def j3(spark, sf):
    return _r(classify.macro_f1_present(_report(spark, sf)), "macro_f1_present", digits=9)


PROB = """px as (select vec_id as sample_id, label as truth, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
lg as (select sample_id, truth, least(i // 10, 5) as pass, (i % 10)::int as label, avg(x) as x from px group by all),
ps as (select sample_id, truth, pass, label, exp(x) / sum(exp(x)) over (partition by sample_id, pass) as p from lg),
l0 as (select sample_id, truth, (i % 10)::int as label, avg(x) as x from px group by all),
p0 as (select sample_id, truth, label, exp(x) / sum(exp(x)) over (partition by sample_id) as p from l0),
pr as (select *, row_number() over (partition by sample_id order by p desc, label) as r from p0),
pw as (select sample_id, truth, max(label) filter (r = 1) as pred, max(p) as confidence, max((label = truth and r <= 5)::int) as top_hit, max(-ln(least(greatest(p, 1e-12), 1.0))) filter (label = truth) as nll, sum(pow(p - (label = truth)::int, 2)) as brier from pr group by 1, 2)"""


def _soft(spark, sf, *parts):
    """Class probabilities: the logit of class c is the mean of all values with ``i % 10 = c``, per part."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("truth"), F.posexplode("embedding").alias("i", "x"))
    e = e.select("sample_id", "truth", F.least(F.expr("i div 10"), F.lit(5)).alias("pass"), (F.col("i") % 10).alias("label"), F.col("x").cast("double").alias("x"))
    e = e.groupBy("sample_id", "truth", *parts, "label").agg(F.exp(F.avg("x")).alias("x"))
    return e.withColumn("p", F.col("x") / F.sum("x").over(Window.partitionBy("sample_id", *parts))).drop("x")


def _passes(spark, sf):
    """Six passes; together they cover every value."""
    return _soft(spark, sf, "pass")


def _prob_rows(spark, sf):
    return classify.probability_rows(_soft(spark, sf))


@query("j4_probability_metrics", f"with {PROB} select count(*) as n, 0::bigint as refused, round(avg(top_hit), 9) as top_accuracy, round(avg(nll), 9) as nll, round(avg(brier), 9) as brier, round(avg((pred = truth)::int::double), 9) as accuracy from pw")
def j4(spark, sf):
    return _r(classify.probability_metrics(_prob_rows(spark, sf)), "top_accuracy", "nll", "brier", "accuracy", digits=9)


BINS = PROB + """, bn as (select greatest(1, ceil(confidence * 15))::int - 1 as bin, count(*) as n, avg((pred = truth)::int::double) as accuracy, avg(confidence) as mean_confidence from pw group by 1),
bb as (select g.bin::int as bin, g.bin / 15.0::double as lower, (g.bin + 1) / 15.0::double as upper, coalesce(n, 0) as n, accuracy, mean_confidence from (select unnest(range(15)) as bin) g left join bn on bn.bin = g.bin)"""


@query("j5_reliability_bins", f"with {BINS} select bin, round(lower, 9) as lower, round(upper, 9) as upper, n, round(accuracy, 9) as accuracy, round(mean_confidence, 9) as mean_confidence from bb")
def j5(spark, sf):
    return _r(classify.reliability_bins(_prob_rows(spark, sf)), "lower", "upper", "accuracy", "mean_confidence", digits=9)


@query("j5_ece", f"with {BINS} select round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 9) as ece from bb")
def j5e(spark, sf):
    return _r(classify.ece(classify.reliability_bins(_prob_rows(spark, sf))), "ece", digits=9)


@query(
    "j6_mc_uncertainty",
    f"""with {PROB}, m as (select sample_id, label, avg(p) as m, avg(-greatest(p, 1e-12) * ln(greatest(p, 1e-12))) as e from ps group by 1, 2)
    select sample_id, round(max(m), 9) as confidence, round(sum(-greatest(m, 1e-12) * ln(greatest(m, 1e-12))), 9) as predictive_entropy, round(sum(-greatest(m, 1e-12) * ln(greatest(m, 1e-12))) - sum(e), 9) as mutual_information from m group by 1""",
)
def j6(spark, sf):
    return _r(classify.mc_uncertainty(_passes(spark, sf)), "confidence", "predictive_entropy", "mutual_information", digits=9)


MAJ = "n as (select quality, count(*) as n from labels group by 1), b as (select quality, n from n order by n desc, quality limit 1), mb as (select b.quality as majority_class, b.n::double / (select sum(n) from n) as accuracy, 2 * (b.n::double / (select sum(n) from n)) / (b.n::double / (select sum(n) from n) + 1) / (select count(*) from n) as macro_f1 from b)"


@query("j7_majority_baseline", f"with {MAJ} select majority_class, round(accuracy, 9) as accuracy, round(macro_f1, 9) as macro_f1 from mb")
def j7(spark, sf):
    return _r(classify.majority_baseline(table(spark, sf, "labels"), "quality", 2), "accuracy", "macro_f1", digits=9)


@query(
    "j7_sanity_gate",
    f"""with {MAJ}, {CONF}, me as (select sum(tp)::double / sum(support) as a, avg(f1) filter (support > 0) as f from cr)
    select majority_class, a >= accuracy + 0.1 as accuracy_ok, f >= 1.5 * macro_f1 as macro_f1_ok, a >= accuracy + 0.1 and f >= 1.5 * macro_f1 as passed from mb, me""",
    ("v_pred",),
)
def j7g(spark, sf):
    rep = _report(spark, sf)
    measured = rep.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"))
    return classify.sanity_gate(measured, classify.majority_baseline(table(spark, sf, "labels"), "quality", 2))


@query(
    "j8_latency_summary",
    "select event_type, count(value) as n, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.5), 6) as p50_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, round(count(value) / (sum(value) / 1000.0), 6) as per_second from events group by 1",
)
def j8(spark, sf):
    return _r(classify.latency_summary(table(spark, sf, "events"), ["event_type"], "value"), "mean_ms", "p50_ms", "p95_ms", "per_second")


@query(
    "j9_flatten_metrics",
    """with a as (select l_suppkey, l_returnflag as section, avg(l_extendedprice) as price, avg(l_tax) as tax from lineitem group by 1, 2)
    select l_suppkey, section, 'price' as metric, round(price, 5) as value from a union all select l_suppkey, section, 'tax', round(tax, 5) from a where section <> 'N'""",
)
def j9(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("section")).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax"))
    inner = F.create_map(F.lit("price"), "price", F.lit("tax"), F.when(F.col("section") == "N", float("nan")).otherwise(F.col("tax")), F.lit("gone"), F.lit(None).cast("double"))
    docs = a.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("section", inner))).alias("metrics"))
    return _r(classify.flatten_metrics(docs, ["l_suppkey"], "metrics"), "value", digits=5)


@query(
    "l1_ranking_curves",
    f"""with {PROB}, s as (select sample_id % 3 as stratum, p as s, label = truth as pos from p0), h as (select stratum, s, sum(pos::int) as p, sum((not pos)::int) as n from s group by 1, 2),
    c as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by stratum) as tot_p, sum(n) over (partition by stratum) as tot_n from h window w as (partition by stratum order by s desc rows unbounded preceding))
    select stratum, cast(max(tot_p) as bigint) as positives, cast(max(tot_n) as bigint) as negatives, round(sum(p / tot_p * tp / (tp + fp)), 9) as pr_auc, round(sum(n / tot_n * (tp - p / 2) / tot_p), 9) as roc_auc,
    round(coalesce(max(tp / tot_p) filter (fp / tot_n <= 0.001), 0), 9) as tpr_at_0_001, round(coalesce(max(tp / tot_p) filter (fp / tot_n <= 0.01), 0), 9) as tpr_at_0_01 from c group by 1""",
)
def l1(spark, sf):
    p = _soft(spark, sf).select((F.col("sample_id") % 3).alias("stratum"), "p", (F.col("label") == F.col("truth")).alias("pos"))
    return _r(classify.ranking_curves(p, ["stratum"], "p", "pos"), "pr_auc", "roc_auc", "tpr_at_0_001", "tpr_at_0_01", digits=9)


RV = RANKS + """, cv as (select sample_id, r_entropy as rank, evidence, tile_len, sum((evidence > 0)::int) over w as u, sum((evidence > 0)::int) over (partition by sample_id) as ut, sum(evidence) over w as b, sum(evidence) over (partition by sample_id) as bt,
 sum(tile_len) over w as l, sum(tile_len) over (partition by sample_id) as lt from rk window w as (partition by sample_id order by r_entropy rows unbounded preceding))"""


def _ranked(spark, sf):
    t = flagship.scored_tiles(spark, sf).withColumn("rank", budget.rank_by(F.col("entropy")))
    return t.select("sample_id", "rank", "tile_len", "evidence")


@query(
    "l2_review_curve",
    f"""with {RV} select sample_id, rank, round(u / nullif(ut, 0), 9) as unit_recall, round(u / rank, 9) as unit_precision, round(b / nullif(bt, 0), 9) as byte_recall, round(b / l, 9) as byte_precision, round(l / lt, 9) as reviewed from cv""",
)
def l2(spark, sf):
    c = classify.review_curve(_ranked(spark, sf)).drop("evidence", "evidence_bytes")
    return _r(c, "unit_recall", "unit_precision", "byte_recall", "byte_precision", "reviewed", digits=9)


@query("l2_review_area", f"with {RV} select sample_id, round(sum(evidence / bt * (b / l)), 9) as byte_auprc from cv where bt > 0 group by 1")
def l2a(spark, sf):
    return _r(classify.review_area(classify.review_curve(_ranked(spark, sf))), "byte_auprc", digits=9)


@query("l3_first_hit", f"with {RANKS} select sample_id, min(r_entropy) filter (evidence > 0) as first_rank, round(coalesce(1.0::double / min(r_entropy) filter (evidence > 0), 0), 9) as reciprocal_rank from rk group by 1")
def l3(spark, sf):
    return _r(classify.first_hit(_ranked(spark, sf)), "reciprocal_rank", digits=9)


@query(
    "l5_coverage_report",
    f"""with {EVAL}, rq as (select sample_id, stratum, unnest(['entropy', 'random', 'attention']) as method from (select distinct sample_id, stratum from ev))
    select rq.stratum, rq.method, count(*) as required, count(e.coverage) as measured, round(count(e.coverage) / count(*)::double, 9) as coverage, round(avg(e.coverage), 9) as mean_value
    from rq left join (select * from ev where budget = 0.10) e on e.sample_id = rq.sample_id and e.selector = rq.method group by 1, 2""",
)
def l5(spark, sf):
    ev = flagship.evaluation(spark, sf, (0.10,))
    req = view(spark, sf, "v_tile").select("sample_id", "stratum")
    out = classify.coverage_report(req, ev.select("sample_id", F.col("selector").alias("method"), F.col("coverage").alias("value")), ["entropy", "random", "attention"], ["stratum"])
    return _r(out, "coverage", "mean_value", digits=9)
