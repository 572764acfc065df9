"""Queries of sweeps, ledgers and statistics."""

from pyspark.sql import functions as F

from tidewatch.operators import fusion, metrics, regime, stats, sweeps
from tidewatch.plans import fixtures as fx
from tidewatch.plans.evaluation import AP, AUC, BEST, CURVE
from tidewatch.plans.registry import query
from tidewatch.sources.shared import written

E = ["entity"]
ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]

PR = ", pr as (select a.entity, a.t, a.label, a.s as a, b.s as b from fx_scores a join fx_scores b using (entity, t) where a.view = 'dev' and b.view = 'jump')"


def z_of(c: str) -> str:
    p = "over (partition by entity)"
    return f"case when stddev_pop({c}) {p} > 1e-8 then ({c} - avg({c}) {p}) / stddev_pop({c}) {p} else 0 end"


AL = ", al as (select cast(a as double) as alpha, cast(o as bigint) as o from (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]) as a, unnest([0, 1, 2, 3, 4]) as o))"
Z = PR + f", z as (select entity, t, label, {z_of('a')} as a, {z_of('b')} as b from pr)" + AL + ", fu as (select entity, alpha, o, t, label, alpha * a + (1 - alpha) * b as s from z, al)"


def swept(window: int, out: str) -> str:
    p = window // 2
    return f""", {out}_e as (select *, count(*) over w as n, row_number() over (partition by entity, alpha order by t) - 1 as i, first_value(s) over f as fa, last_value(s) over f as la from fu window w as (partition by entity, alpha), f as (partition by entity, alpha order by t rows between unbounded preceding and unbounded following)),
{out}_s as (select entity, alpha, o, t, label, case when n <= {window} then avg(s) over (partition by entity, alpha) else (sum(s) over (partition by entity, alpha order by t rows between {p} preceding and {p} following) + greatest(0, {p} - i) * fa + greatest(0, i + {p} - n + 1) * la) / {window} end as s from {out}_e),
{out}_m as (select entity, alpha, o, label, round(case when max(s) over (partition by entity, alpha) > min(s) over (partition by entity, alpha) then (s - min(s) over (partition by entity, alpha)) / (max(s) over (partition by entity, alpha) - min(s) over (partition by entity, alpha)) else 0 end, 9) as s from {out}_s), {out}_r as (select *, rank() over (partition by entity, alpha order by s) + (count(*) over (partition by entity, alpha, s) - 1) / 2.0 as r from {out}_m),
{out} as (select entity, alpha, o, case when sum(label) > 0 and sum(label) < count(*) then (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (cast(sum(label) as double) * (count(*) - sum(label))) end as auc_roc from {out}_r group by entity, alpha, o)"""


def auc_of(src: str, out: str, by: str, window: int) -> str:
    """Tables that smooth ``src``'s scores, take them to [0, 1] and give ``out(by, auc_roc)``."""
    p, part = window // 2, f"over (partition by {by})"
    return f""", {out}_e as (select *, count(*) over w as n, row_number() over (partition by {by} order by t) - 1 as i, first_value(s) over f as fa, last_value(s) over f as la from {src} window w as (partition by {by}), f as (partition by {by} order by t rows between unbounded preceding and unbounded following)),
{out}_s as (select {by}, t, label, case when n <= {window} then avg(s) {part} else (sum(s) over (partition by {by} order by t rows between {p} preceding and {p} following) + greatest(0, {p} - i) * fa + greatest(0, i + {p} - n + 1) * la) / {window} end as s from {out}_e),
{out}_m as (select {by}, label, round(case when max(s) {part} > min(s) {part} then (s - min(s) {part}) / (max(s) {part} - min(s) {part}) else 0 end, 9) as s from {out}_s), {out}_r as (select *, rank() over (partition by {by} order by s) + (count(*) over (partition by {by}, s) - 1) / 2.0 as r from {out}_m),
{out} as (select {by}, case when sum(label) > 0 and sum(label) < count(*) then (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (cast(sum(label) as double) * (count(*) - sum(label))) end as auc_roc from {out}_r group by {by})"""


def two(spark, sf):
    return fusion.pair(fx.scores(spark, sf), E, "dev", "jump")


@query("alpha_sweep", Z + swept(5, "sw") + " select entity, round(alpha, 6) + 0 as alpha, o, round(auc_roc, 6) + 0 as auc_roc from sw")
def _(spark, sf):
    return sweeps.alpha_sweep(two(spark, sf), E, ALPHAS)


@query("alpha_oracle", Z + swept(5, "sw") + ", b as (select entity, alpha, auc_roc from sw where auc_roc is not null qualify row_number() over (partition by entity order by round(auc_roc, 9) desc, o) = 1) select round(alpha, 6) + 0 as alpha, count(*) as n, round(avg(auc_roc), 6) + 0 as auc_roc from b group by alpha")
def _(spark, sf):
    best = sweeps.first_best(sweeps.alpha_sweep(two(spark, sf), E, ALPHAS).withColumn("auc_roc", F.round("auc_roc", 9)), E, ["alpha"], "auc_roc")
    return best.groupBy("alpha").agg(F.count("*").alias("n"), F.avg("auc_roc").alias("auc_roc"))


@query("alpha_cov", Z + ", c as (select entity, alpha, o, stddev_pop(abs(s)) / avg(abs(s)) as cov from fu group by entity, alpha, o) select entity, round(alpha, 6) + 0 as alpha, round(cov, 6) + 0 as cov from c qualify row_number() over (partition by entity order by cov desc, o) = 1")
def _(spark, sf):
    return sweeps.alpha_cov(two(spark, sf), E, ALPHAS)


ZV = "case when stddev_pop(s) over (partition by entity, view) > 1e-12 then (s - avg(s) over (partition by entity, view)) / stddev_pop(s) over (partition by entity, view) else 0 end"
LAM = f""", zz as (select entity, t, label, {ZV} as z from fx_scores), zm as (select entity, t, max(label) as label, avg(z) as m, stddev_pop(z) as d from zz group by entity, t), la as (select cast(a as double) as lam, cast(o as bigint) as o from (select unnest([0.0, 0.5, 1.0, 2.0]) as a, unnest([0, 1, 2, 3]) as o)),
ls as (select entity, lam, o, label, round(m + lam * d, 9) as s from zm, la), lr as (select *, rank() over (partition by entity, lam order by s) + (count(*) over (partition by entity, lam, s) - 1) / 2.0 as r from ls),
lm as (select entity, lam, o, case when sum(label) > 0 and sum(label) < count(*) then (sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (cast(sum(label) as double) * (count(*) - sum(label))) end as auc_roc from lr group by entity, lam, o)"""


@query("lambda_sweep", LAM + " select round(lam, 6) + 0 as lam, o, round(avg(auc_roc), 6) + 0 as mean, round(stddev_samp(auc_roc), 6) + 0 as std, count(auc_roc) as n from lm group by lam, o")
def _(spark, sf):
    return sweeps.over_entities(sweeps.lambda_sweep(fx.scores(spark, sf), E, [0.0, 0.5, 1.0, 2.0]), [], "lam")


GRID = Z + swept(3, "g3") + swept(7, "g7") + ", gr as (select entity, 3 as win, alpha, o, auc_roc from g3 union all select entity, 7, alpha, o + 5, auc_roc from g7)"


@query("grid_best", GRID + " select entity % 4 as ds, cast(win as bigint) as \"window\", round(alpha, 6) + 0 as alpha, round(round(avg(auc_roc), 9), 6) + 0 as mean from gr group by entity % 4, win, alpha, o qualify row_number() over (partition by ds order by round(avg(auc_roc), 9) desc, o) = 1")
def _(spark, sf):
    return sweeps.grid_best(sweeps.grid_scores(two(spark, sf), E, [3, 7], ALPHAS).withColumn("ds", F.col("entity") % 4), ["ds"])


@query("grid_loo", GRID + """, ot as (select entity, entity % 4 as ds, win, alpha, o, auc_roc, round((sum(auc_roc) over (partition by entity % 4, o) - auc_roc) / (count(*) over (partition by entity % 4, o) - 1), 9) as others from gr where auc_roc is not null)
select ds, entity, cast(win as bigint) as "window", round(alpha, 6) + 0 as alpha, round(auc_roc, 6) + 0 as auc_roc, round(others, 6) + 0 as others from ot qualify row_number() over (partition by ds, entity order by others desc, o) = 1""")
def _(spark, sf):
    return sweeps.grid_loo(sweeps.grid_scores(two(spark, sf), E, [3, 7], ALPHAS).withColumn("ds", F.col("entity") % 4), ["ds"], "entity")


PARTS = PR + """, sl as (select *, case when t < greatest(1, least(floor(n / 2.0), n - 1)) then 'val' else 'test' end as split from (select *, count(*) over (partition by entity) as n from pr)),
zv as (select entity, split, t, label, case when stddev_pop(a) over g > 1e-8 then (a - avg(a) over g) / stddev_pop(a) over g else 0 end as a, case when stddev_pop(b) over g > 1e-8 then (b - avg(b) over g) / stddev_pop(b) over g else 0 end as b from sl window g as (partition by entity, split))""" + AL
GRID_VAL = PARTS + ", fv as (select entity, split, alpha, o, t, label, alpha * a + (1 - alpha) * b as s from zv, al)" + auc_of("fv", "v3", "entity, split, alpha, o", 3) + auc_of("fv", "v7", "entity, split, alpha, o", 7) + """,
gv as (select entity, split, 3 as win, alpha, o, auc_roc from v3 union all select entity, split, 7, alpha, o + 5, auc_roc from v7),
mv as (select entity % 4 as ds, split, win, alpha, o, round(avg(auc_roc), 9) as auc from gv group by entity % 4, split, win, alpha, o),
vl as (select ds, win, alpha, o, auc as val from mv where split = 'val' and auc is not null), ow as (select *, 'own' as scope from vl qualify row_number() over (partition by ds order by val desc, o) = 1),
ea as (select win, alpha, o, round(avg(val), 9) as a, count(*) as n from vl group by win, alpha, o), eb as (select * from ea where n = (select max(n) from ea)), be as (select o from eb order by a desc, o limit 1),
bo as (select ds, win, alpha, o, val, scope from ow union all select ds, win, alpha, o, val, 'global' from vl where o in (select o from be))
select ds, scope, cast(win as bigint) as "window", round(alpha, 6) + 0 as alpha, round(val, 6) + 0 as val, round(te.auc, 6) + 0 as test from bo left join (select ds, o, auc from mv where split = 'test') te using (ds, o)"""


@query("grid_val", GRID_VAL)
def _(spark, sf):
    return sweeps.grid_val(sweeps.grid_on_parts(two(spark, sf), E, [3, 7], ALPHAS).withColumn("ds", F.col("entity") % 4), ["ds"])


#: A configuration for each of four groups of entities.
CONFIGS = {0: ("zscore", 0.35, 21, "mean"), 1: ("rank", 0.8, 21, "mean"), 2: ("zscore", 0.2, 20, "mean"), 3: ("minmax", 0.2, 7, "mean")}
RANK_OF = "(rank() over (partition by entity order by {c}) + (count(*) over (partition by entity, {c}) - 1) / 2.0) / count(*) over (partition by entity)"
UNIT_OF = "case when max({c}) over (partition by entity) > min({c}) over (partition by entity) then ({c} - min({c}) over (partition by entity)) / (max({c}) over (partition by entity) - min({c}) over (partition by entity)) else 0 end"
PLAIN_Z = "case when stddev_pop({c}) over (partition by entity) > 0 then ({c} - avg({c}) over (partition by entity)) / stddev_pop({c}) over (partition by entity) else 0 end"


def configured() -> str:
    scale = {"zscore": PLAIN_Z, "rank": RANK_OF, "minmax": UNIT_OF}
    mix = lambda kind, w, c: f"select entity, t, label, cast({w} as double) * ({scale[kind].format(c='a')}) + (1 - cast({w} as double)) * ({scale[kind].format(c='b')}) as s from pr where entity % 4 in ({c})"
    sql = PR + f", c9 as ({mix('rank', 0.5, '0, 1, 2, 3')})" + auc_of("c9", "before9", "entity", 7)
    for c, (kind, w, window, _) in CONFIGS.items():
        sql += f", c{c} as ({mix(kind, w, c)})" + auc_of(f"c{c}", f"after{c}", "entity", window + 1 - window % 2)
    return sql + ", af as (" + " union all ".join(f"select * from after{c}" for c in CONFIGS) + ") select entity % 4 as ds, entity, round(x.auc_roc, 6) + 0 as before, round(y.auc_roc, 6) + 0 as after, round(y.auc_roc - x.auc_roc, 6) + 0 as delta from before9 x join af y using (entity)"


@query("apply_config", configured())
def _(spark, sf):
    return sweeps.apply_config(two(spark, sf).withColumn("ds", F.col("entity") % 4), E, "ds", CONFIGS)


VRANK = "(rank() over (partition by entity, view order by s) + (count(*) over (partition by entity, view, s) - 1) / 2.0) / count(*) over (partition by entity, view)"
AUTO = f", vr as (select *, {VRANK} as r from fx_scores), em as (select entity, t, max(label) as label, avg(s) as m, stddev_pop(s) as d, max(s) as x, avg(r) as r from vr group by entity, t), eu as (" + " union all ".join(f"select entity, {o} as o, '{m}' as method, t, label, {e} as s from em" for o, (m, e) in enumerate({"mean_disagree": "m + cast(0.5 as double) * d", "mean": "m", "max": "x", "rank_mean": "r"}.items())) + ")"


@query("ensemble_auto", AUTO + auc_of("eu", "ea", "entity, o, method", 7) + " select entity, method, round(round(auc_roc, 9), 6) + 0 as auc_roc from ea where auc_roc is not null qualify row_number() over (partition by entity order by round(auc_roc, 9) desc, o) = 1")
def _(spark, sf):
    return sweeps.ensemble_auto(fx.scores(spark, sf), E)


# ------------------------------------------------------------------ M: a ledger of three methods

LEDGER = AUC + CURVE + AP + BEST + ", lg as (select entity, entity % 4 as ds, view as method, auc_roc, auc_pr, best_f1 from auc join ap using (entity, view) join b1 using (entity, view))"


def ledger(spark, sf):
    """Written once, since most queries read it more than once; one curve gives all its metrics."""
    k = ["entity", "view"]
    out = metrics.areas(metrics.curve(fx.scores(spark, sf), k), k)
    return written(out.select("entity", (F.col("entity") % 4).alias("ds"), F.col("view").alias("method"), "auc_roc", "auc_pr", "best_f1"))


@query("macro_mean", LEDGER + " select ds, method, round(avg(auc_roc), 6) + 0 as auc_roc_mean, round(stddev_samp(auc_roc), 6) + 0 as auc_roc_std, count(auc_roc) as auc_roc_n, round(avg(best_f1), 6) + 0 as best_f1_mean, round(stddev_samp(best_f1), 6) + 0 as best_f1_std, count(best_f1) as best_f1_n from lg group by ds, method")
def _(spark, sf):
    return stats.macro_mean(ledger(spark, sf), ["ds", "method"], ["auc_roc", "best_f1"])


@query("multiseed", LEDGER + ", ps as (select method, ds, avg(auc_roc) as m from lg group by method, ds) select method, round(avg(m), 6) + 0 as mean, round(stddev_samp(m), 6) + 0 as std, count(*) as n_seeds, stddev_samp(m) < 0.02 as stable from ps group by method")
def _(spark, sf):
    return stats.multiseed(ledger(spark, sf), ["method"], "auc_roc", "ds")


CANON = LEDGER + ", cl as (select coalesce(a.entity, b.entity) as entity, a.auc_roc as a, b.auc_roc as b, a.entity is not null as in_a, b.entity is not null as in_b from (select * from lg where method = 'dev' and ds <> 1) a full join (select * from lg where method = 'jump' and ds <> 2) b on a.entity = b.entity)"


def canon(spark, sf):
    x = ledger(spark, sf)
    return stats.canonical_ledger(x.where("method = 'dev' and ds <> 1"), x.where("method = 'jump' and ds <> 2"), "entity", "auc_roc")


@query("canonical_ledger", CANON + " select entity, round(a, 6) + 0 as a, round(b, 6) + 0 as b, in_a, in_b from cl")
def _(spark, sf):
    return canon(spark, sf)


@query("canonical_summary", CANON + ", l2 as (select 'a' as method, a as m from cl union all select 'b', b from cl) select method, count(m) as n, round(avg(m), 6) + 0 as mean, round(stddev_pop(m), 6) + 0 as std, round(median(m), 6) + 0 as median, round(min(m), 6) + 0 as min, round(max(m), 6) + 0 as max from l2 where m is not null group by method")
def _(spark, sf):
    return stats.canonical_summary(canon(spark, sf))


@query("paired_common", LEDGER + ", lp as (select * from lg where not (method = 'jump' and ds = 3)) select entity, method, round(auc_roc, 6) + 0 as auc_roc from lp where entity in (select entity from lp group by entity having count(distinct method) = (select count(distinct method) from lp))")
def _(spark, sf):
    return stats.paired_common(ledger(spark, sf).where("not (method = 'jump' and ds = 3)"), "entity", "method").select("entity", "method", "auc_roc")


DIFF = LEDGER + ", df as (select a.ds, a.entity, round(a.auc_roc - b.auc_roc, 9) as d from lg a join lg b using (ds, entity) where a.method = 'dev' and b.method = 'jump')"


def diffs(spark, sf, ledger_of=None):
    return stats.paired_differences(ledger_of or ledger(spark, sf), ["ds"], "entity", "auc_roc", "dev", "jump").withColumn("d", F.round("d", 9))


@query("wilcoxon", DIFF + """, dr as (select ds, d, rank() over (partition by ds order by abs(d)) + (count(*) over (partition by ds, abs(d)) - 1) / 2.0 as r from df where d <> 0), ww as (select ds, sum(case when d > 0 then r else 0 end) as p, sum(case when d < 0 then r else 0 end) as m, count(*) as n from dr group by ds)
select ds, round(p, 6) + 0 as w_plus, round(m, 6) + 0 as w_minus, n, round(least(p, m), 6) + 0 as w from ww""")
def _(spark, sf):
    return stats.wilcoxon(diffs(spark, sf), ["ds"]).drop("p")


@query("wilcoxon_p")
def _(spark, sf):
    return stats.bonferroni(stats.wilcoxon(diffs(spark, sf), ["ds"]))


@query("cohens_d", DIFF + ", e as (select ds, avg(d) / greatest(stddev_samp(d), 1e-10) as effect from df group by ds) select ds, round(effect, 6) + 0 as effect, case when abs(effect) < 0.2 then 'Negligible' when abs(effect) < 0.5 then 'Small' when abs(effect) < 0.8 then 'Medium' else 'Large' end as size from e")
def _(spark, sf):
    return stats.cohens_d(diffs(spark, sf), ["ds"])


@query("bootstrap_ci")
def _(spark, sf):
    return stats.bootstrap_ci(diffs(spark, sf), ["ds"], "d")


@query("cv_stability", LEDGER + ", c as (select method, 100 * stddev_pop(auc_roc) / avg(auc_roc) as cv from lg group by method) select method, round(cv, 6) + 0 as cv, case when cv < 1 then 'stable' when cv < 2 then 'moderate' else 'high' end as stability from c")
def _(spark, sf):
    return stats.cv_stability(ledger(spark, sf), ["method"], "auc_roc")


@query("improvement_counts", DIFF + ", r as (select *, row_number() over (partition by ds order by d desc, entity) as hi, row_number() over (partition by ds order by d, entity) as lo from df where d is not null) select ds, count(*) filter (where d > 0) as improved, count(*) as n, round(sum(d) filter (where hi <= 5), 6) + 0 as top, round(sum(d) filter (where lo <= 5), 6) + 0 as bottom from r group by ds")
def _(spark, sf):
    return stats.improvement_counts(diffs(spark, sf).where("d is not null"), ["ds"], "entity")


@query("extreme_differences", DIFF + ", r as (select *, row_number() over (partition by ds order by d desc, entity) as hi, row_number() over (partition by ds order by d, entity) as lo from df where d is not null) select ds, 'top' as side, hi as rank, entity, round(d, 6) + 0 as d from r where hi <= 5 union all select ds, 'bottom', lo, entity, round(d, 6) + 0 from r where lo <= 5")
def _(spark, sf):
    return stats.extreme_differences(diffs(spark, sf), ["ds"], "entity")


@query("acf", """, c as (select entity, t, s - avg(s) over (partition by entity) as c, count(*) over (partition by entity) as n from fx_scores where view = 'level'), k as (select unnest(range(1, 11)) as lag),
x as (select a.entity, k.lag, a.n, sum(a.c * b.c) as ck from c a join k on true join c b on b.entity = a.entity and b.t = a.t + k.lag group by a.entity, k.lag, a.n), z as (select entity, sum(c * c) as c0 from c group by entity)
select entity, lag, round(case when c0 > 1e-12 then ck / c0 else 0 end, 6) + 0 as acf, abs(case when c0 > 1e-12 then ck / c0 else 0 end) > 1.96 / sqrt(n) as significant from x join z using (entity)""")
def _(spark, sf):
    return stats.acf(fx.scores(spark, sf).where("view = 'level'"), E)


@query("runs_test", """, u as (select entity, t, case when s > median(s) over (partition by entity) then 1 else 0 end as up from fx_scores where view = 'level'), w as (select *, case when up = lag(up) over (partition by entity order by t) then 0 else 1 end as new from u),
r as (select entity, cast(sum(up) as double) as n1, cast(count(*) - sum(up) as double) as n0, sum(new) as runs from w group by entity), v as (select *, n1 + n0 as n, 2 * n1 * n0 as p from r)
select entity, round(n1, 6) + 0 as n1, round(n0, 6) + 0 as n0, cast(runs as bigint) as runs, round(case when n1 > 0 and n0 > 0 and n > 1 and p * (p - n) > 0 then (runs - (p / n + 1)) / sqrt(p * (p - n) / (n * n * (n - 1))) end, 6) + 0 as z from v""")
def _(spark, sf):
    return stats.runs_test(fx.scores(spark, sf).where("view = 'level'"), E)


@query("kruskal_blocks", """, b as (select entity, s, t // 10 as block, count(*) over (partition by entity) as n from fx_scores where view = 'level' qualify t // 10 < n // 10),
r as (select entity, block, s, rank() over (partition by entity order by s) + (count(*) over (partition by entity, s) - 1) / 2.0 as rk, cast(count(*) over (partition by entity, s) as double) as c, cast(count(*) over (partition by entity) as double) as n from b),
p as (select entity, block, n, avg(s) as m, sum(rk) as rs, count(*) as nb, sum(c * c - 1) as tie from r group by entity, block, n), o as (select entity, n, min(m) as lo, max(m) as hi, stddev_pop(m) as sd, sum(rs * rs / nb) as q, count(*) as blocks, 1 - sum(tie) / (n * n * n - n) as fix from p group by entity, n)
select entity, blocks, round(case when blocks >= 3 and fix > 0 then (12 / (n * (n + 1)) * q - 3 * (n + 1)) / fix end, 6) + 0 as h, round(lo, 6) + 0 as mean_min, round(hi, 6) + 0 as mean_max, round(sd, 6) + 0 as mean_std from o""")
def _(spark, sf):
    return stats.kruskal_blocks(fx.scores(spark, sf).where("view = 'level'"), E, 10).drop("p")


@query("exchangeability")
def _(spark, sf):
    return stats.exchangeability(fx.scores(spark, sf).where("view = 'level'"), E, 10)


@query("regime_features")
def _(spark, sf):
    return stats.regime_features(fx.daily_long(spark, sf), E)


@query("spearman_gain", DIFF + ", f as (select entity, max(auc_pr) as x from lg group by entity), j as (select ds, d, x from df join f using (entity) where d is not null and x is not null), r as (select ds, rank() over (partition by ds order by x) + (count(*) over (partition by ds, x) - 1) / 2.0 as rx, rank() over (partition by ds order by d) + (count(*) over (partition by ds, d) - 1) / 2.0 as ry from j) select ds, round(case when count(*) >= 3 then corr(rx, ry) end, 6) + 0 as rho, count(*) as n from r group by ds")
def _(spark, sf):
    lg = ledger(spark, sf)
    x = lg.groupBy("entity").agg(F.max("auc_pr").alias("x"))
    return stats.spearman(diffs(spark, sf, lg).join(x, "entity"), ["ds"], "x", "d")


def regime_records(spark, sf):
    """One record an entity: how much it gains, and what its series is like."""
    shape = fx.series(spark, sf).groupBy("entity").agg(F.count("*").cast("double").alias("steps"), F.avg("label").alias("anomaly_ratio"), F.stddev_pop("v").alias("spread"))
    return diffs(spark, sf).join(shape, "entity")


@query("gain_logit_lodo")
def _(spark, sf):
    return regime.gain_logit(regime_records(spark, sf), "ds", ["steps", "anomaly_ratio", "spread"], "d")


@query("gain_table", LEDGER + ", g as (select a.ds, a.entity, a.auc_roc - b.auc_roc as gain from lg a join lg b using (ds, entity) where a.method = 'dev' and b.method = 'jump') select ds, entity, round(gain, 6) + 0 as gain, case when gain > 0 then 'gain' when gain < 0 then 'loss' else 'even' end as regime from g")
def _(spark, sf):
    return stats.gain_table(ledger(spark, sf), ["ds", "entity"], "auc_roc", "dev", "jump")


@query("comparison_pivot", LEDGER + " select method, " + ", ".join(f'round(avg(auc_roc) filter (where ds = {d}), 6) + 0 as "{d}"' for d in range(4)) + " from lg group by method")
def _(spark, sf):
    return stats.comparison_pivot(ledger(spark, sf), "method", "ds", [0, 1, 2, 3], "auc_roc")


@query("comparison_sources", LEDGER + """, c as (select method, ds, avg(auc_roc) as v, 0 as i, 'main' as source from lg where not (method = 'dev' and ds = 1) group by method, ds union all select method, ds, avg(auc_pr), 1, 'other' from lg where method <> 'jump' group by method, ds),
k as (select method, ds, arg_min(v, i) as v, arg_min(source, i) as source, count(*) - 1 as others from c where v is not null group by method, ds)
select method, ds, round(v, 6) + 0 as value, source, case when others > 0 then cast(others as varchar) || ' more' else '' end as note, v = max(v) over (partition by ds) as best from k""")
def _(spark, sf):
    lg = ledger(spark, sf)
    main = lg.where("not (method = 'dev' and ds = 1)")
    other = lg.where("method <> 'jump'").select("method", "ds", F.col("auc_pr").alias("auc_roc"))
    return stats.comparison_sources([("main", main), ("other", other)], "method", "ds", "auc_roc")


@query("best_view_per_entity", LEDGER + " select entity, method as best_view, round(auc_roc, 6) + 0 as best from lg where auc_roc is not null qualify row_number() over (partition by entity order by round(auc_roc, 9) desc, method) = 1")
def _(spark, sf):
    return stats.best_view(ledger(spark, sf).withColumn("auc_roc", F.round("auc_roc", 9)), E, "auc_roc")


@query("ablation_delta", LEDGER + ", d as (select b.method, b.auc_roc - a.auc_roc as d from lg a join lg b using (entity) where a.method = 'level' and b.method <> 'level') select method, round(avg(d), 6) + 0 as mean_delta, round(median(d), 6) + 0 as median_delta, count(d) as n from d group by method")
def _(spark, sf):
    return sweeps.ablation_delta(ledger(spark, sf), E, "method", "level", "auc_roc")
