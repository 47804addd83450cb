"""Statistics and verdicts on paired and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.hashing import POISSON_ONE
from spanframe.operators import stats, verdicts
from spanframe.plans import flagship
from spanframe.plans.registry import query
from spanframe.plans.sql_parts import EVAL
from spanframe.plans.views import table, view

B = 200


def poisson_sql(h: str) -> str:
    return "(" + " + ".join(f"({h} >= '{t}')::int" for t in POISSON_ONE) + ")"


def reps_sql(src: str, by: str, x: str, key: str, seed: str, b: int = B, name: str = "bm", prefix: str = "") -> str:
    """CTEs of the weighted-mean replicates."""
    p = prefix
    return f"""{p}hx as (select *, sha256(concat_ws('|', '{seed}', {key}, _c)) as _h from (select *, unnest(range({-(-b // 8)})) as _c from {src} where {x} is not null)),
{p}rp as (select {by}, {x} as _x, _c * 8 + j as rep, {poisson_sql("substr(_h, (j * 8 + 1)::int, 8)")} as w from {p}hx, range(8) as t(j)),
{name} as (select {by}, rep, sum(w * _x) / sum(w) as m from {p}rp where w > 0 and rep < {b} group by {by}, rep)"""


PAIRS = "dd as (select *, treatment - control as diff from v_pair)"


def _r(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "i1_mean_ci_t",
    f"""with g as (select sample_id, count(*) as n, avg(l_extendedprice / 7.3719::double) as est, stddev_samp(l_extendedprice / 7.3719::double) as sd from v_line group by sample_id),
    big as (select v.sample_id, v.idx, l_extendedprice / 7.3719::double as share from v_line v join g using (sample_id) where n > 6), {reps_sql("big", "sample_id", "share", "sample_id, idx", "ci")},
    q as (select sample_id, quantile_cont(m, 0.025) as bl, quantile_cont(m, 0.975) as bh from bm group by sample_id),
    t as (select g.*, bl, bh, case n when 2 then 12.706205 when 3 then 4.302653 when 4 then 3.182446 when 5 then 2.776445 when 6 then 2.570582 end::double * sd / sqrt(n) as mg from g left join q using (sample_id)),
    o as (select sample_id, n, est, case when n = 1 then est when n <= 6 then est - mg else bl end as lo, case when n = 1 then est when n <= 6 then est + mg else bh end as hi from t)
    select sample_id, n, round(est, 6) as estimate, round(lo, 6) as low, round(hi, 6) as high,
      case when n = 1 then 'single-observation' when n <= 6 then 't(' || (n - 1) || ')' else 'bootstrap-200' end as method, lo > 0 or hi < 0 as excludes_zero from o""",
    ("v_line",),
)
def i1(spark, sf):
    return _r(stats.mean_ci_t(view(spark, sf, "v_line").withColumn("share", F.col("l_extendedprice") / 7.3719), ["sample_id"], "share", ["sample_id", "idx"], B, "ci"), "estimate", "low", "high", digits=6)


@query(
    "i2_bootstrap_mean",
    f"""with {reps_sql("v_line", "l_returnflag", "l_extendedprice", "sample_id, idx", "mean")},
    q as (select l_returnflag, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from bm group by 1),
    c as (select l_returnflag, count(*) as n, avg(l_extendedprice) as estimate from v_line group by 1)
    select l_returnflag, n, round(estimate, 4) as estimate, round(low, 4) as low, round(high, 4) as high from c join q using (l_returnflag)""",
    ("v_line",),
)
def i2(spark, sf):
    out = stats.bootstrap_mean(view(spark, sf, "v_line"), ["l_returnflag"], "l_extendedprice", ["sample_id", "idx"], B, "mean")
    return _r(out, "estimate", "low", "high", digits=4)


@query(
    "i2_bootstrap_exact",
    """with r as (select source, n_chars, row_number() over (partition by source order by doc_id) as i, count(*) over (partition by source) as n from documents),
    d as (select source, rep, ('0x' || substr(sha256(concat_ws('|', 'exact', source, rep, i)), 1, 13))::ubigint::bigint % n + 1 as pick from r, range(50) t(rep)),
    k as (select source, rep, pick, count(*) as w from d group by all)
    select k.source, k.rep::int as rep, round(sum(w * n_chars)::double / sum(w), 6) as boot_mean from k join r on r.source = k.source and r.i = k.pick group by 1, 2""",
)
def i2e(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return _r(stats.bootstrap_exact(d, ["source"], "n_chars", ["doc_id"], 50, "exact"), "boot_mean")


PAIRED = f"""{PAIRS}, {reps_sql("dd", "stratum", "diff", "sample_id", "pair")},
q as (select stratum, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high, avg((m <= 0)::int::double) as le, avg((m >= 0)::int::double) as ge from bm group by 1),
c as (select stratum, count(*) as n_pairs, avg(diff) as estimate, stddev_samp(diff) as sd, avg(treatment) as mt, avg(control) as mc from dd group by 1),
pb as (select *, least(1.0, 2.0 * least(le, ge)) as p_value, estimate / sd as d from c join q using (stratum))"""


@query("i3_paired_bootstrap", f"with {PAIRED} select stratum, n_pairs, round(estimate, 4) as estimate, round(low, 4) as low, round(high, 4) as high, round(p_value, 6) as p_value, round(d, 9) as cohens_d from pb", ("v_pair",))
def i3(spark, sf):
    out = stats.paired_bootstrap(view(spark, sf, "v_pair"), ["stratum"], ["sample_id"], B, "pair")
    return _r(_r(out, "estimate", "low", "high", digits=4), "p_value").withColumn("cohens_d", F.round("cohens_d", 9))


@query("i4_bootstrap_pvalue", f"with {PAIRED} select stratum, n_pairs, round(p_value, 6) as p_value from pb", ("v_pair",))
def i4(spark, sf):
    return _r(stats.bootstrap_pvalue(view(spark, sf, "v_pair"), ["stratum"], ["sample_id"], B, "pair"), "p_value")


@query(
    "i5_cohens_d_paired",
    f"""with {PAIRS}, k as (select *, sample_id % 2500 as bucket from dd),
    g as (select bucket, count(*) as n, avg(diff) as m, stddev_samp(diff) as sd from k group by 1)
    select bucket, n, round(case when n < 2 then null when sd = 0 then case when m <> 0 then 'inf'::double else 0 end else m / sd end, 6) as cohens_d from g""",
    ("v_pair",),
)
def i5(spark, sf):
    p = view(spark, sf, "v_pair").withColumn("bucket", F.col("sample_id") % 2500)
    return _r(stats.cohens_d_paired(p, ["bucket"]), "cohens_d")


TAU = """pv as (select sample_id, block, max(delta) filter (fill = 'primary') as x, max(delta) filter (fill = 'zero') as y, block % 3 as g from v_delta group by sample_id, block),
pq as (select {key} as k, coalesce(x, 0) as x, coalesce(y, 0) as y, row_number() over (partition by {key} order by sample_id, block) as i from pv),
pr as (select a.k, sign(a.x - b.x) * sign(a.y - b.y) as s, (a.x <> b.x)::int as dx, (a.y <> b.y)::int as dy from pq a join pq b on a.k = b.k and a.i < b.i),
ts as (select k, sum(s) as s, sum(dx) as px, sum(dy) as py from pr group by k),
nn as (select k, count(*) as n from pq group by k),
tau as (select nn.k, n, case when px * py > 0 then s / sqrt(px::double * py) end as kendall_tau from nn left join ts on ts.k = nn.k)"""


def _wide_delta(spark, sf):
    return view(spark, sf, "v_delta").groupBy("sample_id", "block").pivot("fill", ["primary", "zero"]).agg(F.max("delta")).na.fill(0.0)


@query("i6_kendall_tau_b", f"with {TAU.format(key='sample_id')} select k as sample_id, n, round(kendall_tau, 9) as kendall_tau from tau", ("v_delta",))
def i6(spark, sf):
    return _r(stats.kendall_tau_b(_wide_delta(spark, sf), ["sample_id"], "primary", "zero"), "kendall_tau", digits=9)


@query("i6_kendall_large_groups", f"with {TAU.format(key='sample_id % 300')} select k as bucket, n, round(kendall_tau, 9) as kendall_tau from tau", ("v_delta",))
def i6b(spark, sf):
    w = _wide_delta(spark, sf).withColumn("bucket", F.col("sample_id") % 300)
    return _r(stats.kendall_tau_b(w, ["bucket"], "primary", "zero"), "kendall_tau", digits=9)


@query(
    "i7_holm",
    f"""with k as (select stratum, sample_id % 8 as bucket, sample_id, treatment - control as diff from v_pair), {reps_sql("k", "stratum, bucket", "diff", "sample_id", "holm")},
    p as (select stratum, bucket, round(least(1.0, 2.0 * least(avg((m <= 0)::int::double), avg((m >= 0)::int::double))), 6) as p_value from bm group by 1, 2),
    r as (select *, row_number() over w as rk, count(*) over (partition by stratum) as n from p window w as (partition by stratum order by p_value, bucket)),
    o as (select *, min((p_value <= 0.05 / (n - rk + 1))::int) over (partition by stratum order by p_value, bucket rows unbounded preceding) as ok from r)
    select stratum, bucket, p_value, ok = 1 as holm_reject from o""",
    ("v_pair",),
)
def i7(spark, sf):
    p = view(spark, sf, "v_pair").withColumn("bucket", F.col("sample_id") % 8)
    pv = _r(stats.bootstrap_pvalue(p, ["stratum", "bucket"], ["sample_id"], B, "holm"), "p_value").drop("n_pairs")
    return stats.holm(pv, ["stratum"], "p_value", ["bucket"])


@query(
    "i8_summarize_paired",
    f"""with {PAIRED} select stratum, n_pairs, round(estimate, 4) as estimate, round(low, 4) as low, round(high, 4) as high, round(d, 9) as cohens_d,
    round(mt, 4) as mean_treatment, round(mc, 4) as mean_control from pb""",
    ("v_pair",),
)
def i8(spark, sf):
    out = stats.summarize_paired(view(spark, sf, "v_pair"), ["stratum"], ["sample_id"], B, "pair")
    return _r(_r(out, "estimate", "low", "high", "mean_treatment", "mean_control", digits=4), "cohens_d", digits=9)


STRATA, SELECT, BASE = ["long", "short"], ["entropy", "entropy_boundary"], ["random", "front_first", "position_only"]


def report_sql() -> str:
    comps = ", ".join(f"({i * len(BASE) + j}, '{s}', '{b}')" for i, s in enumerate(SELECT) for j, b in enumerate(BASE))
    return f"""{EVAL},
e1 as (select sample_id, stratum, selector, coverage from ev where budget = 0.10 and coverage is not null),
cm as (select * from (values {comps}) as c(pos, selector, baseline)),
pl as (select s.stratum, cm.* from cm, (values ('long'), ('short')) as s(stratum)),
pp as (select a.sample_id, a.stratum, a.selector, b.selector as baseline, a.coverage - b.coverage as diff from e1 a join e1 b on a.sample_id = b.sample_id
  join cm on cm.selector = a.selector and cm.baseline = b.selector),
{reps_sql("pp", "stratum, selector, baseline", "diff", "sample_id", "gate", 200)},
q as (select stratum, selector, baseline, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high,
  least(1.0, 2.0 * least(avg((m <= 0)::int::double), avg((m >= 0)::int::double))) as p from bm group by 1, 2, 3),
cc as (select stratum, selector, baseline, count(*) as n, avg(diff) as est, stddev_samp(diff) as sd from pp group by 1, 2, 3),
tb as (select pl.*, coalesce(n, 0) as n_pairs, est, low, high, est / sd as d, p, case when coalesce(n, 0) >= 2 then p else 1.0 end as pf
  from pl left join cc using (stratum, selector, baseline) left join q using (stratum, selector, baseline)),
hr as (select *, row_number() over (partition by stratum order by pf, pos) as rk, count(*) over (partition by stratum) as fam from tb),
ho as (select *, min((pf <= 0.05 / (fam - rk + 1))::int) over (partition by stratum order by pf, pos rows unbounded preceding) as ok from hr),
rep as (select stratum, selector, baseline, n_pairs, round(est, 6) as estimate, round(low, 6) as low, round(high, 6) as high, round(d, 6) as cohens_d, round(p, 6) as p_value,
  coalesce(est > 0, false) as positive, ok = 1 and coalesce(est > 0, false) as significant from ho)"""


def _report(spark, sf):
    ev = flagship.evaluation(spark, sf, (0.10,)).filter("coverage is not null")
    return verdicts.stratum_report(ev, STRATA, SELECT, BASE, B, "gate")


@query("i9_stratum_report", f"with {report_sql()} select * from rep")
def i9(spark, sf):
    return _r(_report(spark, sf), "estimate", "low", "high", "cohens_d", "p_value")


@query("i9_coverage_means", f"with {EVAL} select stratum, selector, count(coverage) as n, round(avg(coverage), 9) as coverage_mean from ev where budget = 0.10 group by all")
def i9m(spark, sf):
    return _r(verdicts.coverage_means(flagship.evaluation(spark, sf, (0.10,))), "coverage_mean", digits=9)


@query(
    "i10_gate_verdict",
    f"""with {report_sql()}, w as (select stratum, selector, bool_and(significant) as b from rep group by 1, 2),
    f as (select (select count(distinct stratum) from w where b) = 2 as all_strata_pass, (select coalesce(bool_or(significant), false) from rep where stratum = 'long' and baseline = 'front_first') as primary_beats_front)
    select *, all_strata_pass and primary_beats_front as gate_pass from f""",
)
def i10(spark, sf):
    return verdicts.gate_verdict(_report(spark, sf), STRATA, "long", "front_first")


@query(
    "i10_gate_chosen",
    f"""with {report_sql()}, m as (select * from rep where selector = 'entropy_boundary')
    select bool_or(significant) filter (stratum = 'long' and baseline = 'front_first') as long_beats_front_first,
      bool_or(significant) filter (stratum = 'long' and baseline = 'random') as long_beats_random,
      bool_or(significant) filter (stratum = 'short' and baseline = 'front_first') as short_beats_front_first,
      bool_or(significant) filter (stratum = 'short' and baseline = 'random') as short_beats_random,
      bool_or(significant) filter (stratum = 'long' and baseline = 'front_first') as gate_pass, 'entropy_boundary' as chosen from m""",
)
def i10b(spark, sf):
    return verdicts.gate_verdict(_report(spark, sf), STRATA, "long", "front_first", "entropy_boundary", "random")


MEASURES = """ms as (
  select 'D1' as key, avg(least(treatment, control) / greatest(treatment, control)) as observed, null::double as low from v_pair
  union all select 'D2', avg(treatment - control), avg(treatment - control) - 1.96 * stddev_samp(treatment - control) / sqrt(count(*)) from v_pair where stratum = 'F'
  union all select 'D3', avg(control - treatment), null from v_pair where stratum = 'O'
  union all select 'D5', avg((treatment > control)::int::double), null from v_pair
  union all select 'D6', 'nan'::double, null)"""
DECIDE = MEASURES + """,
ru as (select * from (values ('D1', 'floor', 0.5::double, true), ('D2', 'gain', 0.0, true), ('D3', 'gain', 0.0, true), ('D4', 'floor', 0.6, false), ('D5', 'floor', 0.7, false), ('D6', 'floor', 3.0, false)) as r(key, kind, threshold, critical)),
dc as (select ru.key, kind, critical, case when not isnan(observed) then observed end as observed, threshold,
  case when kind = 'floor' then (case when not isnan(observed) then observed end) >= threshold when observed is not null and low is not null then observed > 0 and low > 0 end as passed from ru left join ms on ms.key = ru.key)"""


def _measures(spark, sf):
    p = view(spark, sf, "v_pair")
    diff = F.col("treatment") - F.col("control")
    one = p.agg(
        F.avg(F.least("treatment", "control") / F.greatest("treatment", "control")).alias("d1"),
        F.avg(F.when(F.col("stratum") == "F", diff)).alias("d2"), F.stddev_samp(F.when(F.col("stratum") == "F", diff)).alias("s2"),
        F.count(F.when(F.col("stratum") == "F", diff)).alias("n2"), F.avg(F.when(F.col("stratum") == "O", -diff)).alias("d3"),
        F.avg((F.col("treatment") > F.col("control")).cast("double")).alias("d5"),
    )
    none = F.lit(None).cast("double")
    cell = lambda k, o, l: F.struct(F.lit(k).alias("key"), o.alias("observed"), l.alias("low"))  # noqa: E731,E741
    rows = F.array(
        cell("D1", F.col("d1"), none), cell("D2", F.col("d2"), F.col("d2") - 1.96 * F.col("s2") / F.sqrt("n2")),
        cell("D3", F.col("d3"), none), cell("D5", F.col("d5"), none), cell("D6", F.lit(float("nan")), none),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("i11_decision_table", f"with {DECIDE} select key, kind, critical, round(observed, 6) as observed, threshold, passed from dc", ("v_pair",))
def i11(spark, sf):
    return _r(verdicts.decision_table(_measures(spark, sf)), "observed")


@query(
    "i11_standing",
    f"""with {DECIDE} select case when count(passed) filter (critical) = 0 then 'unmeasured' when count(passed) filter (critical) < 3 then 'incomplete'
      when bool_and(passed) filter (critical) then 'supported' else 'not-supported' end as standing,
      coalesce(string_agg(key, ',' order by key) filter (not passed), '') as failed, coalesce(string_agg(key, ',' order by key) filter (passed is null), '') as unmeasured from dc""",
    ("v_pair",),
)
def i11s(spark, sf):
    return verdicts.standing(verdicts.decision_table(_measures(spark, sf)))


@query(
    "i12_nearest_rank_quantiles",
    """with r as (select l_returnflag, l_extendedprice as x, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)
    select l_returnflag, max(n) as n, """ + ", ".join(
        f"round(max(x) filter (i = round_even({p}::double * (n - 1), 0)), 6) as p{int(p * 100)}" for p in (0.10, 0.25, 0.50, 0.75, 0.90)
    ) + " from r group by 1",
)
def i12(spark, sf):
    return stats.nearest_rank_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


PRED_CELLS = f"""hx as (select *, sha256(concat_ws('|', 'strat', sample_id, _c)) as _h from (select *, unnest(range(25)) as _c from v_pred)),
rp as (select truth, pred, _c * 8 + j as rep, {poisson_sql("substr(_h, (j * 8 + 1)::int, 8)")} as w from hx, range(8) as t(j)),
ce as (select rep, truth, pred, sum(w)::double as w from rp where w > 0 group by all),
sz as (select truth, count(*) as n from v_pred group by 1),
fc as (select rep, truth, any_value(n) / sum(w) as f from ce join sz using (truth) group by rep, truth),
cw as (select rep, truth, pred, w * f as w from ce join fc using (rep, truth)),
bt as (select rep, truth as label, sum(w) as sup, sum(case when truth = pred then w else 0 end) as tp from cw group by 1, 2),
bp as (select rep, pred as label, sum(w) as prd from cw group by 1, 2),
pe as (select rep, label, coalesce(sup, 0) as sup, coalesce(tp, 0) as tp, coalesce(prd, 0) as prd from bt full join bp using (rep, label)),
rs as (select rep, sum(tp) / sum(sup) as accuracy, avg(case when sup + prd > 0 then 2 * tp / (sup + prd) else 0 end) as macro_f1, avg(case when sup > 0 then tp / sup else 0 end) as macro_recall from pe group by rep),
lg as (select 'accuracy' as metric, accuracy as v from rs union all select 'macro_f1', macro_f1 from rs union all select 'macro_recall', macro_recall from rs)"""


@query("i14_stratified_bootstrap", f"with {PRED_CELLS} select metric, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from lg group by metric", ("v_pred",))
def i14(spark, sf):
    return _r(stats.stratified_bootstrap(view(spark, sf, "v_pred"), ["sample_id"], B, "strat"), "low", "high")


RUNS = """rn as (select l_returnflag as config, l_linestatus as mode, l_suppkey % 5 as seed, avg(l_extendedprice) as price, avg(l_discount) as discount, null::double as timing from lineitem group by 1, 2, 3),
runs as (select config, mode, seed, 'price' as metric, price as value from rn union all select config, mode, seed, 'discount', discount from rn union all select config, mode, seed, 'timing', timing from rn)"""


def _runs(spark, sf):
    rn = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("mode"), (F.col("l_suppkey") % 5).alias("seed")
    ).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.lit(None).cast("double").alias("timing"))
    return rn.unpivot(["config", "mode", "seed"], ["price", "discount", "timing"], "metric", "value")


@query(
    "i15_aggregate_runs",
    f"""with {RUNS}, g as (select config, mode, metric, count(value) as n, avg(value) as mean, stddev_samp(value) as sd, min(value) as mn, max(value) as mx from runs group by 1, 2, 3)
    select config, mode, metric, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - 2.776445::double * sd / sqrt(n), 6) as low, round(mean + 2.776445::double * sd / sqrt(n), 6) as high,
    round(mn, 6) as min, round(mx, 6) as max, case when n = 0 then 'not_measured' else 'measured' end as status from g""",
)
def i15(spark, sf):
    return _r(stats.aggregate_runs(_runs(spark, sf)), "mean", "sd", "low", "high", "min", "max")


@query(
    "i16_paired_run_differences",
    f"""with {RUNS}, d as (select l.mode, l.metric, r.value - l.value as diff from runs l join runs r on r.mode = l.mode and r.metric = l.metric and r.seed = l.seed and l.config = 'A' and r.config = 'R' where l.value is not null and r.value is not null),
    g as (select mode, metric, count(*) as n, avg(diff) as mean, stddev_samp(diff) as sd from d group by 1, 2 having count(*) >= 2)
    select mode, metric, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - 2.776445::double * sd / sqrt(n), 6) as low, round(mean + 2.776445::double * sd / sqrt(n), 6) as high from g""",
)
def i16(spark, sf):
    return _r(stats.paired_run_differences(_runs(spark, sf), "A", "R"), "mean", "sd", "low", "high")


ARMS = ["full-image", "full-tiles-100", "linear-50", "guided-50", "reference-50"]
CELLS = """ms as (
  select case sample_id % 4 when 0 then 'full-image' when 1 then 'full-tiles-100' when 2 then 'linear-50' else 'guided-50' end as arm, sample_id, treatment, control from v_pair),
mm as (select arm, 'ap_s' as metric, avg((treatment > control)::int::double) as value, 'measured' as status from ms group by arm
  union all select arm, 'detector_images', case arm when 'full-tiles-100' then count(*) else count(*) // 2 end::double, 'measured' from ms group by arm
  union all select arm, 'latency_p95_ms', case arm when 'full-tiles-100' then 1.0 else 0.7 end * avg(treatment), 'measured' from ms group by arm
  union all select arm, 'f1', 1.5, 'measured' from ms group by arm
  union all select arm, 'peak_vram_mib', 3.0, 'failed' from ms group by arm),
un as (select * from (values """ + ", ".join(f"('{m}', '{u}')" for m, u in verdicts.METRIC_UNITS.items()) + """) as u(metric, unit)),
ar as (select * from (values """ + ", ".join(f"('{a}')" for a in ARMS) + """) as a(arm)),
ce as (select ar.arm, un.metric, un.unit, mm.value, coalesce(mm.status, case when ar.arm = 'full-image' and un.metric = 'tile_recall' then 'not_applicable' else 'not_measured' end) as status
  from ar cross join un left join mm on mm.arm = ar.arm and mm.metric = un.metric)"""


def _cells(spark, sf):
    p = view(spark, sf, "v_pair")
    k = F.col("sample_id") % 4
    arm = F.when(k == 0, "full-image").when(k == 1, "full-tiles-100").when(k == 2, "linear-50").otherwise("guided-50")
    full = F.col("arm") == "full-tiles-100"
    g = p.withColumn("arm", arm).groupBy("arm").agg(F.avg((F.col("treatment") > F.col("control")).cast("double")).alias("ap"), F.count(F.lit(1)).alias("n"), F.avg("treatment").alias("t"))
    cell = lambda m, v, s: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(s).alias("status"))
    rows = F.array(
        cell("ap_s", F.col("ap"), "measured"), cell("detector_images", F.when(full, F.col("n")).otherwise(F.expr("n div 2")), "measured"),
        cell("latency_p95_ms", F.when(full, 1.0).otherwise(0.7) * F.col("t"), "measured"), cell("f1", F.lit(1.5), "measured"), cell("peak_vram_mib", F.lit(3.0), "failed"),
    )
    return verdicts.experiment_table(g.select("arm", F.explode(rows).alias("m")).select("arm", "m.*"), ARMS, "full-image")


@query(
    "i17_experiment_table",
    f"""with {CELLS} select arm, metric, unit, round(value, 6) as value, status, case when status <> 'measured' and value is not null then 'value without measurement'
    when status = 'measured' and unit = 'fraction_0_1' and value not between 0 and 1 then 'fraction out of range' end as violation from ce""",
    ("v_pair",),
)
def i17(spark, sf):
    return _r(_cells(spark, sf), "value")


@query(
    "i17_primary_gate",
    f"""with {CELLS}, w as (select arm, max(value) filter (metric = 'ap_s') as ap, max(value) filter (metric = 'detector_images') as di, max(value) filter (metric = 'latency_p95_ms') as la from ce where status = 'measured' group by arm),
    c as (select a.arm, w.ap, w.di, w.la, b.ap as bap, b.di as bdi, b.la as bla from (values ('linear-50'), ('guided-50'), ('reference-50')) as a(arm) left join w on w.arm = a.arm cross join (select * from w where arm = 'full-tiles-100') b),
    v as (select arm, case when ap is null then 'not_measured' else 'measured' end as status, (bap - ap) * 100 <= 1.5 + 1e-12 as acc, 1 - di / bdi >= 0.4 as calls, 1 - la / bla >= 0.25 as lat from c)
    select arm, status, acc as accuracy_non_inferior, calls as calls_improved, lat as latency_improved, acc and calls and lat as passed from v""",
    ("v_pair",),
)
def i17g(spark, sf):
    return verdicts.primary_gate(_cells(spark, sf), "full-tiles-100", ["linear-50", "guided-50", "reference-50"])


@query(
    "l4_cluster_bootstrap",
    f"""with pc as (select lang, source, sum(n_chars) as s, count(*) as n from documents group by 1, 2),
    hx as (select *, sha256(concat_ws('|', 'clu', source, _c)) as _h from (select *, unnest(range(25)) as _c from pc)),
    rp as (select lang, s, n, _c * 8 + j as rep, {poisson_sql("substr(_h, (j * 8 + 1)::int, 8)")} as w from hx, range(8) as t(j)),
    bm as (select lang, rep, sum(w * s)::double / sum(w * n) as m from rp where w > 0 group by 1, 2),
    c as (select lang, cast(sum(n) as bigint) as n, count(*) as n_clusters, sum(s)::double / sum(n) as e from pc group by 1)
    select c.lang, any_value(n) as n, any_value(n_clusters) as n_clusters, round(any_value(e), 6) as estimate, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from c join bm on bm.lang = c.lang group by c.lang""",
)
def l4(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "n_chars")
    return _r(stats.cluster_bootstrap(d, ["lang"], "n_chars", "source", B, "clu"), "estimate", "low", "high")
