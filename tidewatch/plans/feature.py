"""Queries of pairwise transforms, tokens and scorers."""

from pyspark.sql import functions as F

from tidewatch.operators import metrics, pairwise, post, scorers, tokens, windows
from tidewatch.plans import fixtures as fx
from tidewatch.plans.evaluation import ALL
from tidewatch.plans.registry import query
from tidewatch.sources.shared import written

E = ["entity"]
EW = ["entity", "w"]

#: Windows of 8 steps, for the pairwise queries.
CELLS = ", cells as materialized (select entity, t // 8 as w, cast(t % 8 as bigint) as i, ch, v from fx_long)"
FRAMES = ", fr as materialized (select entity, t // 8 as w, cast(t % 8 as bigint) as i, [x0 / 1000, x3] as x from fx_daily)"


def cells(spark, sf):
    return fx.daily_long(spark, sf).select("entity", F.floor(F.col("t") / 8).alias("w"), (F.col("t") % 8).alias("i"), "ch", "v")


def frames(spark, sf):
    return fx.daily(spark, sf).select("entity", F.floor(F.col("t") / 8).alias("w"), (F.col("t") % 8).alias("i"), F.array(F.col("x0") / 1000, "x3").alias("x"))


def gaf(f: str) -> str:
    p = "over (partition by entity, w, ch)"
    return CELLS + f""", th as materialized (select entity, w, ch, i, acos(least(1.0, greatest(-1.0, case when max(v) {p} - min(v) {p} > 1e-8 * greatest(1.0, abs(max(v) {p})) then 2 * (v - min(v) {p}) / (max(v) {p} - min(v) {p}) - 1 else 0 end))) as th from cells),
m as (select a.entity, a.w, a.i, b.i as j, avg({f}) as v from th a join th b using (entity, w, ch) group by a.entity, a.w, a.i, b.i)
select entity, w, i, j, round(case when max(v) over (partition by entity, w) - min(v) over (partition by entity, w) > 1e-12 then (v - min(v) over (partition by entity, w)) / (max(v) over (partition by entity, w) - min(v) over (partition by entity, w)) else 0.5 end, 6) + 0 as v from m"""


@query("gaf_cells", gaf("cos(a.th + b.th)"))
def _(spark, sf):
    return pairwise.gaf_cells(cells(spark, sf), EW)


@query("gaf_difference", gaf("sin(a.th - b.th)"))
def _(spark, sf):
    return pairwise.gaf_cells(cells(spark, sf), EW, True)


DIST = FRAMES + ", ds as (select a.entity, a.w, a.i, b.i as j, sqrt((a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2])) as d from fr a join fr b using (entity, w))"
REC = "select entity, w, i, j, round(case when max(d) over (partition by entity, w) > min(d) over (partition by entity, w) then 1 - (d - min(d) over (partition by entity, w)) / (max(d) over (partition by entity, w) - min(d) over (partition by entity, w)) else 1 end, 6) + 0 as v"


@query("recurrence_cells", f"{DIST} {REC} from ds")
def _(spark, sf):
    return pairwise.recurrence_cells(frames(spark, sf), EW)


@query("recurrence_threshold", DIST + " select entity, w, round(quantile_cont(d, cast(0.1 as double)), 6) + 0 as thr from ds group by entity, w")
def _(spark, sf):
    return pairwise.recurrence_threshold(frames(spark, sf), EW)


@query("recurrence_binary", DIST + ", th as (select entity, w, quantile_cont(d, cast(0.1 as double)) as thr from ds group by entity, w) select entity, w, i, j, case when d < thr then 1.0 else 0 end + 0.0 as v from ds join th using (entity, w)".replace("case when d < thr then 1.0 else 0 end + 0.0", "cast(case when d < thr then 1 else 0 end as double)"))
def _(spark, sf):
    return pairwise.recurrence_cells(frames(spark, sf), EW, threshold="auto")


@query("multi_view", DIST + f", r as ({REC} from ds), b as (select entity, w, i, j, cast(case when d < 3 then 1 else 0 end as double) as v from ds) select *, 'continuous' as view from r union all select *, 'binary' from b")
def _(spark, sf):
    f = frames(spark, sf)
    return pairwise.multi_view({"continuous": pairwise.recurrence_cells(f, EW), "binary": pairwise.recurrence_cells(f, EW, threshold=3.0)})


# ------------------------------------------------------------------ E: a 2 x 2 patch grid


def grid(spark, sf):
    """Tokens of frames of 14 x 14 patches."""
    e = fx.read(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 196).alias("w"), (F.col("vec_id") % 196).cast("int").alias("patch"))


def pi_sql(diagonal: bool) -> str:
    r = "r - 1" if diagonal else "r"
    return f"select w, src, cast(({r}) * 14 + c - 1 as bigint) as dst from (select w, src, src // 14 as r, src % 14 as c from (select vec_id // 196 as w, cast(vec_id % 196 as bigint) as src from embeddings)) where c - 1 >= 0 and ({r}) >= 0"


@query("pi_line", " " + pi_sql(False))
def _(spark, sf):
    return tokens.moved_patches(grid(spark, sf), tokens.pi_shift(spark, 14, 14, 10, 100, False))


@query("pi_diagonal", " " + pi_sql(True))
def _(spark, sf):
    return tokens.moved_patches(grid(spark, sf), tokens.pi_shift(spark, 14, 14, 10, 100, True))


@query("pi_identity", " select w, cast(patch as bigint) as src, cast(patch as bigint) as dst from fx_tokens")
def _(spark, sf):
    return tokens.moved_patches(fx.tokens(spark, sf), tokens.pi_identity(spark, 4))


@query("pi_count", " select w, count(*) as n from fx_tokens group by w")
def _(spark, sf):
    return tokens.moved_patches(fx.tokens(spark, sf), tokens.pi_identity(spark, 4)).groupBy("w").agg(F.count("*").alias("n"))


@query("ot_plan")
def _(spark, sf):
    return tokens.ot_plan(fx.tokens(spark, sf))


RES = ", rs as (select a.w, a.patch, a.label, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(a.vec, b.vec)]) as r from fx_tokens a join fx_tokens b on b.w = a.w - 1 and b.patch = a.patch)"


def residuals(spark, sf):
    t = fx.tokens(spark, sf)
    return tokens.traj_residuals(t, tokens.lag_prediction(t), tokens.pi_identity(spark, 4))


@query("traj_residuals", RES + " select w, patch, round(r, 6) + 0 as r, label from rs")
def _(spark, sf):
    return residuals(spark, sf)


@query("traj_score", RES + " select w, round(avg(r), 6) + 0 as s from rs group by w")
def _(spark, sf):
    return tokens.traj_score(residuals(spark, sf))


@query("traj_score_ext", RES + ", l as (select w, avg(r) as m, max(r) as x, stddev_samp(r) as sd, list_sort(list(r)) as xs from rs group by w) select w, round(m, 6) + 0 as mean, round(x, 6) + 0 as max, round(sd, 6) + 0 as std, round(xs[cast(least(floor(len(xs) * cast(0.95 as double)), len(xs) - 1) as bigint) + 1], 6) + 0 as p95 from l")
def _(spark, sf):
    return tokens.traj_score_ext(residuals(spark, sf))


@query("traj_residuals_soft", """, fl as (select w, patch, unnest(vec) as x, unnest(range(0, 64)) as d from fx_tokens), mx as (select f.w, i, d, sum(case when i = f.patch then cast(0.7 as double) else cast(0.1 as double) end * x) as x from fl f, (select unnest(range(0, 4)) as i) group by f.w, i, d)
select m.w, cast(m.i as bigint) as patch, round(sum((m.x - p.x) * (m.x - p.x)), 6) + 0 as r from mx m join fl p on p.w = m.w - 1 and p.patch = m.i and p.d = m.d group by m.w, m.i""")
def _(spark, sf):
    t = fx.tokens(spark, sf)
    soft = spark.range(16).select(F.floor(F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).cast("int").alias("j")).withColumn("p", F.when(F.col("i") == F.col("j"), 0.7).otherwise(0.1))
    return tokens.traj_residuals_soft(t, tokens.lag_prediction(t), soft)


@query("trimmed_huber", RES + ", h as (select w, patch, case when sqrt(r) <= 1 then 0.5 * sqrt(r) * sqrt(r) else sqrt(r) - 0.5 end as l from rs), k as (select w, l, row_number() over (partition by w order by l, patch) as rk, count(*) over (partition by w) as n from h) select w, round(avg(l), 6) + 0 as s from k where rk <= n - floor(n * cast(0.25 as double)) group by w")
def _(spark, sf):
    return tokens.trimmed_huber(residuals(spark, sf), 1.0, 0.25)


@query("lag_prediction", "select w + 1 as w, cast(patch as bigint) as patch, round(list_sum(vec), 6) + 0 as total from fx_tokens")
def _(spark, sf):
    return tokens.lag_prediction(fx.tokens(spark, sf)).select("w", "patch", F.aggregate("pred", F.lit(0.0), lambda s, x: s + x).alias("total"))


def importance(spark, sf):
    return residuals(spark, sf).select("w", F.floor(F.col("patch") / 2).cast("int").alias("row"), (F.col("patch") % 2).cast("int").alias("col"), F.col("r").alias("v"))


@query("timestep_saliency_line", RES + """, c as (select w, patch % 2 as col, sum(r) as v from rs group by w, patch % 2), t as (select unnest(range(0, 10)) as t), x as (select w, t, v from t join c on c.col = least(1, floor(t * 223 / 9.0 / 112)))
select w, t, round(case when max(v) over (partition by w) > 0 then v / max(v) over (partition by w) else 0 end, 6) + 0 as v from x""")
def _(spark, sf):
    return tokens.timestep_saliency_line(importance(spark, sf), 10, 224, 2)


@query("timestep_saliency_pair", RES + """, t as (select unnest(range(0, 10)) as t), k as (select t, least(1, t * 2 // 10) as k from t), p as (select w, a.t as i, b.t as j, r from k a, k b, rs where rs.patch // 2 = a.k and rs.patch % 2 = b.k),
u as (select w, i as t, r from p union all select w, j, r from p), s as (select w, t, sum(r) as v from u group by w, t) select w, t, round(case when max(v) over (partition by w) > 0 then v / max(v) over (partition by w) else 0 end, 6) + 0 as v from s""")
def _(spark, sf):
    return tokens.timestep_saliency_pair(importance(spark, sf), 10, 2)


@query("topk_windows", "select entity, view, t, label, rk from (select *, row_number() over (partition by entity, view, label order by case when label = 1 then -s else s end, t) as rk from fx_scores) where rk <= 3")
def _(spark, sf):
    return tokens.topk_windows(fx.scores(spark, sf), ["entity", "view"], 3).select("entity", "view", "t", "label", "rk")


# ------------------------------------------------------------------ F: two scaled channels (SQL) or four


def halves(spark, sf):
    """The daily table, the first half of an entity's steps being train."""
    d = fx.daily(spark, sf)
    n = d.groupBy("entity").agg(F.count("*").alias("n"))
    return d.join(n, "entity").withColumn("split", F.when(F.col("t") < F.floor(F.col("n") / 2), "train").otherwise("test")).drop("n")


def vectors(spark, sf, columns=("x0", "x1", "x2", "x3")):
    return halves(spark, sf).select("entity", "split", "t", "label", F.array(*columns).alias("f"))

LW = """, tr as (select entity, x0 as a, x3 as b from fx_split where split = 'train'), m as (select entity, avg(a) as ma, avg(b) as mb, count(*) as n from tr group by entity),
s as (select entity, ma, mb, n, avg((a - ma) * (a - ma)) as saa, avg((a - ma) * (b - mb)) as sab, avg((b - mb) * (b - mb)) as sbb, sum(power((a - ma) * (a - ma) + (b - mb) * (b - mb), 2)) as q4 from tr join m using (entity) group by entity, ma, mb, n),
d0 as (select *, (saa + sbb) / 2 as mm, saa * saa + 2 * sab * sab + sbb * sbb as sz from s), d1 as (select *, (sz - 2 * mm * mm) / 2 as delta from d0), d2 as (select *, least(greatest((q4 / n - sz) / (2 * n), 0), delta) as beta from d1),
d3 as (select *, case when beta > 0 and delta > 0 then beta / delta else 0 end as rho from d2), d4 as (select *, (1 - rho) * saa + rho * mm as caa, (1 - rho) * sab as cab, (1 - rho) * sbb + rho * mm as cbb from d3),
md as (select *, caa * cbb - cab * cab as det from d4)"""
MS = LW + ", ms as (select f.entity, f.t, f.split, f.label, greatest(0, ((x0 - ma) * (x0 - ma) * cbb - 2 * (x0 - ma) * (x3 - mb) * cab + (x3 - mb) * (x3 - mb) * caa) / det) as s from fx_split f join md using (entity))"


@query("ledoit_wolf_fit", LW + " select entity, n, round(rho, 6) + 0 as shrinkage, round(ma, 6) + 0 as mu0, round(mb, 6) + 0 as mu1, round(cbb / det, 6) + 0 as p00, round(caa / det, 6) + 0 as p11 from md")
def _(spark, sf):
    m = scorers.ledoit_wolf_fit(vectors(spark, sf, ("x0", "x3")).where("split = 'train'"), E)
    return m.select("entity", "n", "shrinkage", F.col("mu")[0].alias("mu0"), F.col("mu")[1].alias("mu1"), F.col("prec")[0][0].alias("p00"), F.col("prec")[1][1].alias("p11"))


def mahalanobis(spark, sf, columns):
    v = vectors(spark, sf, columns)
    return scorers.mahalanobis_score(v, scorers.ledoit_wolf_fit(v.where("split = 'train'"), E), E).drop("f")


@query("mahalanobis_score", MS + " select entity, t, split, round(s, 6) + 0 as s from ms")
def _(spark, sf):
    return mahalanobis(spark, sf, ("x0", "x3")).select("entity", "t", "split", "s")


def window_mahalanobis(spark, sf, columns, flat=False):
    """Windows of 10 days, pooled or flat, fitted on train days, scored on test days, smoothed."""
    d, keys = halves(spark, sf), ["entity", "split"]
    w = windows.mean_pool(d, keys, 10, 1, list(columns)).select("entity", "split", F.col("w").alias("t"), "label", F.array(*columns).alias("f"))
    if flat:
        w = w.drop("f").join(windows.flatten(d, keys, 10, 1, list(columns)).withColumnRenamed("w", "t"), [*keys, "t"])
    w = written(w)
    model = scorers.ledoit_wolf_fit(w.where("split = 'train'"), E)
    s = scorers.mahalanobis_score(w.where("split = 'test'"), model, E).drop("f", "split")
    return post.smooth_mean(written(s), E, 5)


@query("raw_mahalanobis")
def _(spark, sf):
    return metrics.all_metrics(window_mahalanobis(spark, sf, ("x0", "x1", "x2", "x3")), E)


@query("raw_mahalanobis_flat")
def _(spark, sf):
    return metrics.all_metrics(window_mahalanobis(spark, sf, ("x0", "x1", "x2", "x3"), True), E)


#: The flagship with two channels, whose inverse SQL can write out: windows, fit, scores, smoothing, metrics.
PAIR = (
    """, pw as (select entity, split, t, label, a, b from (select entity, split, t, max(label) over w as label, avg(x0) over w as a, avg(x3) over w as b, count(*) over w as c from fx_split window w as (partition by entity, split order by t rows between current row and 9 following)) where c = 10)"""
    + LW.replace("x0 as a, x3 as b from fx_split", "a, b from pw")
    + """, raw as (select entity, t, label, greatest(0, ((a - ma) * (a - ma) * cbb - 2 * (a - ma) * (b - mb) * cab + (b - mb) * (b - mb) * caa) / det) as s from pw join md using (entity) where split = 'test'),
ed as (select *, row_number() over (partition by entity order by t) - 1 as i, count(*) over (partition by entity) as n, first_value(s) over f as h, last_value(s) over f as l from raw window f as (partition by entity order by t rows between unbounded preceding and unbounded following)),
pm as (select entity, 'all' as view, t, label, case when n <= 5 then avg(s) over (partition by entity) else (sum(s) over (partition by entity order by t rows between 2 preceding and 2 following) + greatest(0, 2 - i) * h + greatest(0, i + 2 - n + 1) * l) / 5 end as s from ed)"""
    + ALL.replace("fx_scores", "pm")
)


@query("raw_mahalanobis_pair", PAIR + """ select entity, round(auc_roc, 6) + 0 as auc_roc, round(auc_pr, 6) + 0 as auc_pr, round(best_f1, 6) + 0 as best_f1, round(best_threshold, 6) + 0 as best_threshold, round(f1_pa_oracle, 6) + 0 as f1_pa_oracle,
cast(null as double) as f1_validation, cast(null as double) as f1_pa_validation, cast(null as double) as threshold_validation from auc join ap using (entity, view) join b1 using (entity, view) join orb using (entity, view)""")
def _(spark, sf):
    return metrics.all_metrics(window_mahalanobis(spark, sf, ("x0", "x3")), E)


@query("raw_mahalanobis_macro")
def _(spark, sf):
    from tidewatch.operators.stats import macro_mean

    out = metrics.all_metrics(window_mahalanobis(spark, sf, ("x0", "x1", "x2", "x3")), E).withColumn("dataset", F.lit("daily"))
    return macro_mean(out, ["dataset"], ["auc_roc", "auc_pr", "best_f1", "f1_pa_oracle"])


def patch_vectors(spark, sf):
    t = fx.tokens(spark, sf)
    half = t.agg((F.max("w") / 2).alias("h"))
    return t.crossJoin(F.broadcast(half)).select("patch", F.col("w").alias("t"), "label", F.col("vec").alias("f"), F.when(F.col("w") < F.col("h"), "train").otherwise("test").alias("split"))


@query("per_patch_maha")
def _(spark, sf):
    v = patch_vectors(spark, sf)
    return scorers.mahalanobis_score(v, scorers.ledoit_wolf_fit(v.where("split = 'train'"), ["patch"]), ["patch"]).select("patch", "t", "s")


@query("patch_aggregate", RES + ", k as (select *, row_number() over (partition by w order by r desc) as rk from rs) select w, round(avg(r), 6) + 0 as mean, round(max(r), 6) + 0 as max, round(quantile_cont(r, cast(0.95 as double)), 6) + 0 as p95, round(avg(case when rk <= 2 then r end), 6) + 0 as topk from k group by w")
def _(spark, sf):
    return scorers.patch_aggregate(residuals(spark, sf).withColumnRenamed("r", "s"), ["w"], 2)


@query("random_projection")
def _(spark, sf):
    out = scorers.random_projection(fx.tokens(spark, sf).select("w", "patch", F.col("vec").alias("f")), 64, 8)
    return out.select("w", "patch", F.posexplode("f").alias("d", "x"))


GAP = "sqrt(" + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(4)) + ")"


@query("knn_score", f""", k as (select a.entity, a.t, {GAP} as d, row_number() over (partition by a.entity, a.t order by {GAP}, b.t) as rk
from fx_split a join fx_split b using (entity) where a.split = 'test' and b.split = 'train') select entity, t, round(avg(d), 6) + 0 as s from k where rk <= 5 group by entity, t""")
def _(spark, sf):
    v = written(vectors(spark, sf))
    return scorers.knn_score(v.where("split = 'test'"), v.where("split = 'train'"), E)


@query("zscore_meanabs", ", st as (select entity, ch, avg(v) as mu, stddev_pop(v) as sd from fx_long where split = 'train' group by entity, ch) select entity, split, t, max(label) as label, round(avg(abs((v - mu) / case when sd > 0 then sd else 1 end)), 6) + 0 as s from fx_long join st using (entity, ch) group by entity, split, t")
def _(spark, sf):
    return scorers.zscore_meanabs(fx.daily_long(spark, sf), E)


@query("pca_recon")
def _(spark, sf):
    return scorers.pca_recon(vectors(spark, sf), E)


#: All rows ``z`` standardised by train, the 20 nearest train rows ``nn`` of each, itself left out, and the factors ``lf``.
LOF = ", zs as (select entity, " + ", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in range(4)) + " from fx_split where split = 'train' group by entity), z as materialized (select entity, t, split, " + ", ".join(
    f"(x{i} - m{i}) / case when s{i} > 0 then s{i} else 1 end as x{i}" for i in range(4)
) + f""" from fx_split join zs using (entity)),
nn as materialized (select * from (select a.entity, a.t, a.split, b.t as o, {GAP} as d, row_number() over (partition by a.entity, a.t order by {GAP}, b.t) as r from z a join z b on a.entity = b.entity and a.t <> b.t where b.split = 'train') where r <= 20),
kd as (select entity, t as o, max(d) as kd from nn where split = 'train' group by entity, t), ld as materialized (select entity, t, split, 1 / (avg(greatest(kd, d)) + 1e-10) as lrd from nn join kd using (entity, o) group by entity, t, split),
lf as (select n.entity, n.t, n.split, avg(o.lrd) / any_value(m.lrd) as s from nn n join ld o on o.entity = n.entity and o.t = n.o join ld m on m.entity = n.entity and m.t = n.t group by n.entity, n.t, n.split),
fo as (select entity, quantile_cont(s, cast(0.95 as double)) as q from lf where split = 'train' group by entity)
select entity, t, round(s - q, 6) + 0 as s from lf join fo using (entity) where split = 'test'"""  # fmt: skip


@query("lof_score", LOF)
def _(spark, sf):
    v = written(vectors(spark, sf))
    return scorers.lof_score(v.where("split = 'test'"), v.where("split = 'train'"), E)


@query("isolation_forest")
def _(spark, sf):
    return scorers.isolation_forest(written(vectors(spark, sf)), E)


@query("train_cap_sample", "select entity, t from (select entity, t, row_number() over (partition by entity order by md5('42:' || cast(t as varchar)), t) as rk from fx_split where split = 'train') where rk <= 200")
def _(spark, sf):
    return scorers.train_cap_sample(vectors(spark, sf).where("split = 'train'"), E, 200).select("entity", "t")


@query("reconstruction_mse", """, x as (select entity, t // 20 as w, t, ch, v / case when ch = 2 then 10000 else 100 end as v from fx_long), r as (select entity, w, t, ch, avg(v) over (partition by entity, w, ch) as a, median(v) over (partition by entity, w, ch) as b from x) select entity, w, round(0.5 * avg((v - a) * (v - a)) + 0.5 * avg((v - b) * (v - b)), 6) + 0 as s from x join r using (entity, w, t, ch) group by entity, w""")
def _(spark, sf):
    from pyspark.sql import Window

    x = fx.daily_long(spark, sf).select("entity", F.floor(F.col("t") / 20).alias("w"), "t", "ch", (F.col("v") / F.when(F.col("ch") == 2, 10000).otherwise(100)).alias("v"))
    by = Window.partitionBy("entity", "w", "ch")
    decoders = [x.select("entity", "w", "t", "ch", f("v").over(by).alias("v")) for f in (F.avg, F.median)]
    return scorers.reconstruction_blend(x, decoders, EW)


@query("pooled_projected_maha")
def _(spark, sf):
    t = fx.tokens(spark, sf)
    pooled = windows.pool_tokens(t, ["w"]).join(t.groupBy("w").agg(F.max("label").alias("label")), "w")
    v = scorers.random_projection(pooled, 64, 8).select(F.lit("all").alias("entity"), F.col("w").alias("t"), "label", "f")
    half = v.agg((F.max("t") / 2).alias("h"))
    v = v.crossJoin(F.broadcast(half)).withColumn("split", F.when(F.col("t") < F.col("h"), "train").otherwise("test")).drop("h")
    s = scorers.mahalanobis_score(v, scorers.ledoit_wolf_fit(v.where("split = 'train'"), E), E).where("split = 'test'").drop("f", "split")
    return metrics.all_metrics(post.norm_minmax(post.smooth_mean(s, E, 5), E), E)
