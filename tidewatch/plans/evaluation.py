"""Queries of metrics, conformal calibration and online guards."""

from pyspark.sql import functions as F

from tidewatch.operators import conformal, metrics
from tidewatch.plans import fixtures as fx
from tidewatch.plans.registry import query
from tidewatch.sources.shared import written

EV = ["entity", "view"]
P = "over (partition by entity, view)"

RANKS = """, rk as (select *, rank() over (partition by entity, view order by s) + (count(*) over (partition by entity, view, s) - 1) / 2.0 as r from fx_scores)"""
AUC = RANKS + """, auc as (select entity, view, case when sum(label) > 0 and sum(label) < count(*) then
(sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (cast(sum(label) as double) * (count(*) - sum(label))) end as auc_roc from rk group by entity, view)"""
CURVE = f""", c0 as (select entity, view, s as thr, sum(label) as pos, count(*) as n from fx_scores group by entity, view, s),
cv as (select *, cast(sum(pos) over d as double) as tp, cast(sum(n) over d - sum(pos) over d as double) as fp, sum(pos) {P} as p from c0 window d as (partition by entity, view order by thr desc)),
cf as (select *, case when tp > 0 then 2 * tp / (tp + fp + p) else 0 end as f1 from cv)"""
AP = ", ap as (select entity, view, sum(pos * tp / (tp + fp)) / max(p) as auc_pr from cv group by entity, view)"
BEST = ", b1 as (select entity, view, f1 as best_f1, thr as best_threshold from cf qualify row_number() over (partition by entity, view order by f1 desc, thr) = 1)"
SEG = ", sg as (select *, case when label = 1 then t - row_number() over (partition by entity, view, label order by t) end as seg from fx_scores)"


def pa(thr: str, out: str, rows: str = "sg") -> str:
    """Point-adjusted F1 at a table of thresholds (entity, view, thr)."""
    return f""", {out}_p as (select g.*, case when s >= thr then 1 else 0 end as p0 from {rows} g join {thr} using (entity, view)),
{out}_a as (select *, case when seg is null then p0 else max(p0) over (partition by entity, view, seg) end as pred from {out}_p),
{out} as (select entity, view, case when sum(pred * label) > 0 then 2.0 * sum(pred * label) / (sum(pred * label) + sum(pred * (1 - label)) + sum(label)) else 0 end as f from {out}_a group by entity, view)"""


ORACLE = """, lv as (select unnest([0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995, 0.999]) as lvl), qs as (select entity, view, list_sort(list(s)) as xs from fx_scores group by entity, view),
ql as (select entity, view, lvl, xs, (len(xs) - 1) * cast(lvl as double) as h from qs, lv), th as (select entity, view, lvl, xs[cast(floor(h) as bigint) + 1] + (h - floor(h)) * (xs[cast(ceil(h) as bigint) + 1] - xs[cast(floor(h) as bigint) + 1]) as thr from ql),
op as (select g.*, th.lvl, case when s >= thr then 1 else 0 end as p0 from sg g join th using (entity, view)), oa as (select *, case when seg is null then p0 else max(p0) over (partition by entity, view, lvl, seg) end as pred from op),
orc as (select entity, view, lvl, case when sum(pred * label) > 0 then 2.0 * sum(pred * label) / (sum(pred * label) + sum(pred * (1 - label)) + sum(label)) else 0 end as f from oa group by entity, view, lvl),
orb as (select entity, view, max(f) as f1_pa_oracle from orc group by entity, view)"""
#: Validation: the first 20 steps of each stream.
VT = ", vt as (select entity, view, quantile_cont(s, cast(0.95 as double)) as thr from fx_scores where t < 20 group by entity, view)"
TESTED = ", ts as (select * from fx_scores where t >= 20)"


@query("auc_roc", AUC + " select entity, view, round(auc_roc, 6) + 0 as auc_roc from auc")
def _(spark, sf):
    return metrics.auc_roc(fx.scores(spark, sf), EV)


@query("pr_curve", CURVE + " select entity, view, round(thr, 6) + 0 as thr, round(tp / (tp + fp), 6) + 0 as precision, round(case when p > 0 then tp / p end, 6) + 0 as recall from cv")
def _(spark, sf):
    return metrics.pr_curve(fx.scores(spark, sf), EV)


@query("auc_pr", CURVE + AP + " select entity, view, round(auc_pr, 6) + 0 as auc_pr from ap")
def _(spark, sf):
    return metrics.auc_pr(fx.scores(spark, sf), EV)


@query("best_f1", CURVE + BEST + " select entity, view, round(best_f1, 6) + 0 as best_f1, round(best_threshold, 6) + 0 as best_threshold from b1")
def _(spark, sf):
    return metrics.best_f1(fx.scores(spark, sf), EV)


@query("anomaly_segments", SEG + " select entity, view, min(t) as start, max(t) as \"end\" from sg where label = 1 group by entity, view, seg")
def _(spark, sf):
    return metrics.anomaly_segments(fx.scores(spark, sf), EV).select("entity", "view", "start", "end")


FIX = ", fx_thr as (select entity, view, avg(s) + stddev_pop(s) as thr from fx_scores group by entity, view)"


def fixed(spark, sf):
    df = fx.scores(spark, sf)
    return df, df.groupBy(*EV).agg((F.avg("s") + F.stddev_pop("s")).alias("thr"))


@query("point_adjust", FIX + SEG + pa("fx_thr", "pf") + " select entity, view, t, label, pred from pf_a")
def _(spark, sf):
    df, thr = fixed(spark, sf)
    return metrics.point_adjust(df.join(thr, EV), EV, F.col("thr")).select("entity", "view", "t", "label", "pred")


@query("f1_pa", FIX + SEG + pa("fx_thr", "pf") + " select entity, view, round(f, 6) + 0 as f1_pa from pf")
def _(spark, sf):
    return metrics.f1_pa(*fixed(spark, sf), EV)


@query("f1_pa_oracle", SEG + ORACLE + " select entity, view, round(f1_pa_oracle, 6) + 0 as f1_pa_oracle from orb")
def _(spark, sf):
    return metrics.f1_pa_oracle(fx.scores(spark, sf), EV)


@query("val_threshold", VT + " select entity, view, round(thr, 6) + 0 as thr from vt")
def _(spark, sf):
    return metrics.val_threshold(fx.scores(spark, sf).where("t < 20"), EV)


F1V = """, v1 as (select a.*, case when s >= thr then 1 else 0 end as pred from ts a join vt using (entity, view)), vf as (select entity, view, case when min(pred) = max(pred) then 0 when sum(pred * label) > 0
then 2.0 * sum(pred * label) / (sum(pred * label) + sum(pred * (1 - label)) + sum(label)) else 0 end as f from v1 group by entity, view)"""


@query("f1_val", VT + TESTED + F1V + " select entity, view, round(f, 6) + 0 as f1_validation from vf")
def _(spark, sf):
    df = fx.scores(spark, sf)
    return metrics.f1_val(df.where("t >= 20"), metrics.val_threshold(df.where("t < 20"), EV), EV)


SEGT = ", sgt as (select *, case when label = 1 then t - row_number() over (partition by entity, view, label order by t) end as seg from ts)"


@query("f1_pa_val", VT + TESTED + SEGT + pa("vt", "pv", "sgt") + " select entity, view, round(f, 6) + 0 as f1_pa_validation from pv")
def _(spark, sf):
    df = fx.scores(spark, sf)
    return metrics.f1_pa(df.where("t >= 20"), metrics.val_threshold(df.where("t < 20"), EV), EV, "f1_pa_validation")


ALL = AUC + CURVE + AP + BEST + SEG + ORACLE


@query("all_metrics", ALL + """ select entity, view, round(auc_roc, 6) + 0 as auc_roc, round(auc_pr, 6) + 0 as auc_pr, round(best_f1, 6) + 0 as best_f1, round(best_threshold, 6) + 0 as best_threshold, round(f1_pa_oracle, 6) + 0 as f1_pa_oracle,
cast(null as double) as f1_validation, cast(null as double) as f1_pa_validation, cast(null as double) as threshold_validation from auc join ap using (entity, view) join b1 using (entity, view) join orb using (entity, view)""")
def _(spark, sf):
    return metrics.all_metrics(fx.scores(spark, sf), EV)


@query("f1_pa_at_best", CURVE + BEST + ", bt as (select entity, view, best_threshold as thr from b1)" + SEG + pa("bt", "pb") + " select entity, view, round(f, 6) + 0 as f1_pa from pb")
def _(spark, sf):
    return metrics.f1_pa_at_best(fx.scores(spark, sf), EV)


@query("metric_guards", """, g as (select entity, view, t, label, case when entity % 7 = 1 and t = 2 then cast('nan' as double) else s end as s from fx_scores where not (entity % 7 = 2 and label = 1))
select entity, view, count(*) as n, case when count(*) filter (where s is null or not isfinite(s)) > 0 then 'not finite' when count(*) filter (where label not in (0, 1)) > 0 then 'not binary' when min(label) = max(label) then 'one class' end as note from g group by entity, view""")
def _(spark, sf):
    df = fx.scores(spark, sf).where("not (entity % 7 = 2 and label = 1)")
    return metrics.metric_guards(df.withColumn("s", F.when((F.col("entity") % 7 == 1) & (F.col("t") == 2), float("nan")).otherwise(F.col("s"))), EV)


# ------------------------------------------------------------------ J: the first 30 steps calibrate

CAL = ", cal as materialized (select *, row_number() over (partition by entity, view order by s) as rk, count(*) over (partition by entity, view) as n from fx_scores where t < 30), tst as (select * from fx_scores where t >= 30)"
CT = ", ct as materialized (select entity, view, n as n_cal, s as thr from cal where rk = greatest(1, least(ceil((cast(n as double) + 1) * (1 - cast(0.1 as double))), n)))"


def parts(spark, sf):
    df = fx.scores(spark, sf)
    return df.where("t < 30"), df.where("t >= 30")


@query("conformal_threshold", CAL + CT + " select entity, view, n_cal, round(thr, 6) + 0 as thr from ct")
def _(spark, sf):
    return conformal.conformal_threshold(parts(spark, sf)[0], EV, 0.1)


@query("conformal_p", CAL + " select a.entity, a.view, a.t, round((1 + count(c.s)) / (max(k.n) + 1.0), 6) + 0 as p_value from tst a join (select entity, view, max(n) as n from cal group by entity, view) k using (entity, view) left join cal c on c.entity = a.entity and c.view = a.view and c.s >= a.s group by a.entity, a.view, a.t")
def _(spark, sf):
    return conformal.conformal_p(*parts(spark, sf), EV).select("entity", "view", "t", "p_value")


#: No window and no sort of a whole table: a grouped order statistic, and a join on the tested rows alone.
FLAGS = f""", cq as materialized (select entity, view, list_sort(list(s)) as xs, count(*) as n from fx_scores where t < 30 group by entity, view),
cr as materialized (select entity, view, xs[cast(greatest(1, least(ceil((cast(n as double) + 1) * (1 - cast(0.1 as double))), n)) as bigint)] as thr from cq),
te as materialized (select entity, view, t, s from fx_scores where t >= 30)"""


@query("flag_fixed", FLAGS + " select entity, view, t, s > thr as flag from te join cr using (entity, view)")
def _(spark, sf):
    cal, test = parts(spark, sf)
    return conformal.flag_fixed(test, conformal.conformal_threshold(cal, EV, 0.1), EV).select("entity", "view", "t", "flag")


#: Scores count as equal from nine digits on, whatever the order that their means were summed in; they are computed once.
NINE = ", ns as materialized (select * replace (round(s, 9) as s) from fx_scores)"


def nine(df):
    """The same rule as ``NINE``: a mean that is summed again may move a score by its last bit, and so across its equal."""
    return written(df.withColumn("s", F.round("s", 9)))


def far_sql(ratio: float, held: bool, hit: str, rows: str = "fx_scores") -> str:
    k = f"greatest(1, floor(nn * cast({ratio} as double)))"
    k = f"least({k}, nn - 1)" if held else k
    return f""", nm as (select *, row_number() over (partition by entity, view, label order by t) as r, sum(1 - label) {P} as nn from {rows}), pt as (select *, case when label = 1 then 'anomaly' when r <= {k} then 'cal' else 'normal' end as part from nm),
al as (select cast(unnest([0.01, 0.05, 0.1]) as double) as alpha), cc as (select *, row_number() over (partition by entity, view order by s) as rk, count(*) {P} as n, avg(s) {P} as mu, stddev_pop(s) {P} + 1e-10 as sd from pt where part = 'cal'),
ft as (select entity, view, alpha, n, s as thr, mu, sd from cc, al where rk = greatest(1, least(ceil((cast(n as double) + 1) * (1 - alpha)), n)))
select entity, view, alpha, max(n) as n_cal, round(max(thr), 6) + 0 as threshold, round(avg(case when part = 'normal' then case when {hit} then 1.0 else 0 end end), 6) + 0 as far, round(avg(case when part = 'anomaly' then case when {hit} then 1.0 else 0 end end), 6) + 0 as coverage
from pt join ft using (entity, view) where part <> 'cal' group by entity, view, alpha"""


@query("far_at_alpha", far_sql(0.5, False, "s > thr").replace("select entity, view, alpha, max(n)", "select entity, view, round(alpha, 6) + 0 as alpha, max(n)"))
def _(spark, sf):
    return conformal.far_at_alpha(fx.scores(spark, sf), EV, [0.01, 0.05, 0.1])


@query("far_at_alpha_v2", NINE + far_sql(0.8, True, "(s - mu) / sd > (thr - mu) / sd", "ns").replace("select entity, view, alpha, max(n)", "select entity, view, round(alpha, 6) + 0 as alpha, max(n)"))
def _(spark, sf):
    return conformal.far_at_alpha(nine(fx.scores(spark, sf)), EV, [0.01, 0.05, 0.1], 0.8, True)


@query("bonferroni_alpha", "select entity, view, round(least(1 - 1e-10, greatest(1e-10, cast(0.05 as double) / count(*))), 6) + 0 as alpha from fx_scores group by entity, view")
def _(spark, sf):
    return fx.scores(spark, sf).groupBy(*EV).agg(conformal.bonferroni_alpha(F.lit(0.05), F.count("*")).alias("alpha"))


@query("norm_threshold_v2", CAL + CT + ", ms as (select entity, view, avg(s) as mu, stddev_pop(s) as sd from cal group by entity, view) select entity, view, n_cal, round(mu, 6) + 0 as mu, round(sd, 6) + 0 as sd, round((thr - mu) / (sd + 1e-10), 6) + 0 as thr_z, round((thr - mu) / (sd + 1e-10) * (sd + 1e-10) + mu, 6) + 0 as thr from ct join ms using (entity, view)")
def _(spark, sf):
    return conformal.norm_threshold(parts(spark, sf)[0], EV, 0.1)


SP = f", sp as (select *, case when t < floor(count(*) {P} / 2.0) then 'train' else 'test' end as split from fx_scores), tl0 as (select *, row_number() over (partition by entity, view order by t desc) as b, count(*) {P} as nt from sp where split = 'train'), tl as (select *, row_number() over (partition by entity, view order by s) as rk, count(*) {P} as n from tl0 where b <= greatest(1, least(floor(nt * cast(0.2 as double)), nt - 1)))"


def halves(spark, sf):
    from tidewatch.operators.prep import half_split

    return half_split(fx.scores(spark, sf), EV)


@query("train_tail_calibration", SP + " select entity, view, t, round(s, 6) + 0 as s from tl")
def _(spark, sf):
    return conformal.train_tail(halves(spark, sf).where("split = 'train'"), EV, 0.2).select("entity", "view", "t", "s")


FE = SP + """, al as (select cast(unnest([0.01, 0.05, 0.1]) as double) as alpha), tt as (select entity, view, alpha, n, s as thr from tl, al where rk = greatest(1, least(ceil((cast(n as double) + 1) * (1 - alpha)), n))),
pv as (select a.entity, a.view, a.t, a.s, a.label, (1 + count(c.s)) / (max(k.n) + 1.0) as p from (select * from sp where split = 'test') a join (select distinct entity, view, n from tl) k using (entity, view) left join tl c on c.entity = a.entity and c.view = a.view and c.s >= a.s group by all),
fe as (select entity, view, alpha, avg(case when label = 0 then case when s > thr then 1.0 else 0 end end) as far, avg(case when label = 1 then case when s > thr then 1.0 else 0 end end) as coverage, avg(p) as mean_p, count(*) as n_test, max(n) as n_cal from pv join tt using (entity, view) group by entity, view, alpha)"""


@query("far_eval_v3", FE + " select entity, view, round(alpha, 6) + 0 as alpha, round(far, 6) + 0 as far, round(coverage, 6) + 0 as coverage, round(mean_p, 6) + 0 as mean_p, n_test, n_cal, round(abs(far - alpha), 6) + 0 as gap, far <= alpha as controlled from fe")
def _(spark, sf):
    return conformal.far_eval(halves(spark, sf), EV, [0.01, 0.05, 0.1])


@query("far_summary", FE + " select view, round(alpha, 6) + 0 as alpha, round(avg(far), 6) + 0 as far_mean, round(stddev_samp(far), 6) + 0 as far_std, round(avg(coverage), 6) + 0 as coverage, round(avg(case when far <= alpha then 1.0 when far > alpha then 0 end), 6) + 0 as controlled, cast(min(case when abs(far - alpha) < 0.02 then 1 when far is not null then 0 end) as bigint) as all_close from fe group by view, alpha")
def _(spark, sf):
    return conformal.far_summary(conformal.far_eval(halves(spark, sf), EV, [0.01, 0.05, 0.1]), ["view"])


@query("fixed_quantile_eval", SP + """, ns as materialized (select * replace (round(s, 9) as s) from sp), q as (select entity, view, round(quantile_cont(s, cast(0.95 as double)), 9) as thr from ns where split = 'train' group by entity, view), h as (select entity, view, thr, avg(case when label = 0 then case when s > thr then 1.0 else 0 end end) as far, avg(case when label = 1 then case when s > thr then 1.0 else 0 end end) as recall from ns join q using (entity, view) where split = 'test' group by entity, view, thr)
select entity, view, round(thr, 6) + 0 as thr, round(far, 6) + 0 as far, round(recall, 6) + 0 as recall, round(abs(far - cast(0.05 as double)), 6) + 0 as gap from h""")
def _(spark, sf):
    return conformal.fixed_quantile_eval(nine(halves(spark, sf)), EV, 0.05, 9)
