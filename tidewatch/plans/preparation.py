"""Queries of sources, cleaning, windows, smoothing, normalising and fusion."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import fusion, post, prep, windows
from tidewatch.plans import fixtures as fx
from tidewatch.plans.registry import query
from tidewatch.sources import series_io
from tidewatch.sources.shared import new_folder

E = ["entity"]
EV = ["entity", "view"]

#: Gaps for the cleaning queries: every 7th value is NaN, every 11th infinite.
HOLES = "case when t % 7 = 3 then cast('nan' as double) when t % 11 = 5 then cast('infinity' as double) else v end"


def holes(spark, sf):
    return fx.series(spark, sf).withColumn("v", F.when(F.col("t") % 7 == 3, float("nan")).when(F.col("t") % 11 == 5, float("inf")).otherwise(F.col("v")))


@query("parse_archive_series", """, p as (select *, 'a_b_' || cast(entity as varchar) || '_20_25_30' as stem from fx_series)
select stem as entity, t, case when t < 20 then 'train' else 'test' end as split, case when t >= 25 and t < 30 then 1 else 0 end as label from p""")
def _(spark, sf):
    df = fx.series(spark, sf).select(F.concat(F.lit("/x/a_b_"), F.col("entity").cast("string"), F.lit("_20_25_30.txt")).alias("path"), "t")
    return series_io.parse_archive_series(df).select("entity", "t", "split", "label")


@query("eligible_series", """select entity from (select entity, label, t, count(*) over (partition by entity) as n from fx_series)
group by entity, n having floor(n / 2.0) > 20 and n - floor(n / 2.0) > 20 and min(case when t >= floor(n / 2.0) then label end) = 0 and max(case when t >= floor(n / 2.0) then label end) = 1""")
def _(spark, sf):
    return series_io.eligible_series(fx.series(spark, sf), 20)


@query("to_long", """select entity, t, 'x0' as cols, round(x0, 6) + 0 as value from fx_daily union all select entity, t, 'x3', round(x3, 6) + 0 from fx_daily union all select entity, t, 'label', cast(label as double) from fx_daily""")
def _(spark, sf):
    return series_io.to_long(fx.daily(spark, sf), ["entity", "t"], ["x0", "x3"]).select("entity", "t", "cols", "value")


@query("from_long", "select entity, t, round(x0, 6) + 0 as x0, round(x3, 6) + 0 as x3, label from fx_daily")
def _(spark, sf):
    long = series_io.to_long(fx.daily(spark, sf), ["entity", "t"], ["x0", "x3"])
    return series_io.from_long(long, ["entity", "t"], ["x0", "x3"])


@query("concat_entities", """, n as (select entity, count(*) as n from fx_daily group by entity), o as (select entity, coalesce(sum(n) over (order by entity rows between unbounded preceding and 1 preceding), 0) as o from n)
select d.entity, cast(d.t + o.o as bigint) as t, d.label from fx_daily d join o using (entity)""")
def _(spark, sf):
    return series_io.concat_entities(fx.daily(spark, sf)).select("entity", "t", "label")


def halves(spark, sf):
    """Days as vectors, each half's steps counted from 0; train labels are not told."""
    d = fx.daily(spark, sf)
    half = F.floor(F.count("*").over(Window.partitionBy("entity")) / 2)
    train = F.col("t") < half
    return d.select("entity", F.when(train, "train").otherwise("test").alias("split"), F.when(train, F.col("t")).otherwise(F.col("t") - half).alias("t"), F.array("x0", "x1", "x2", "x3").alias("x"), F.when(train, 0).otherwise(F.col("label")).alias("label"))


HALVES = ", hv as (select *, cast(floor(count(*) over (partition by entity) / 2.0) as bigint) as half from fx_split) select entity, split, case when split = 'train' then t else t - half end as t, round(x0, 6) + 0 as x0, round(x1, 6) + 0 as x1, round(x2, 6) + 0 as x2, round(x3, 6) + 0 as x3, case when split = 'train' then 0 else label end as label from hv"


@query("read_entity_csv", HALVES)
def _(spark, sf):
    """Written as a tree of headerless files and read back."""
    root = new_folder(spark)
    series_io.write_entity_csv(halves(spark, sf), root)
    return series_io.read_entity_csv(spark, root).select("entity", "split", "t", *[F.col("x")[i].alias(f"x{i}") for i in range(4)], "label")


@query("read_feature_csv", " select entity, t, round(x0, 6) + 0 as x0, round(x3, 6) + 0 as x1, label from fx_daily")
def _(spark, sf):
    """Written as headed files with a time column, labels apart, and read back."""
    root, d = new_folder(spark), fx.daily(spark, sf)
    heads = d.select("entity").distinct()
    cell = lambda *c: F.concat_ws(",", *[F.col(x).cast("string") for x in c]).alias("line")
    head = lambda names: heads.select("entity", F.lit(-1).cast("long").alias("t"), F.lit(names).alias("line"))
    series_io.write_lines(head("timestamp_(min),a,b").unionByName(d.select("entity", "t", cell("t", "x0", "x3"))), f"{root}/data")
    series_io.write_lines(head("timestamp,label").unionByName(d.select("entity", "t", cell("t", "label"))), f"{root}/labels")
    return series_io.read_feature_csv(spark, f"{root}/data", f"{root}/labels").select("entity", "t", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "label")


@query("read_metrics", ", m as (select entity, view, count(*) as n, sum(label) as positives, avg(s) as mean from fx_scores group by entity, view) select entity, view, n, cast(positives as bigint) as positives, round(mean, 6) + 0 as mean from m")
def _(spark, sf):
    """A metrics ledger written as JSON files and collected again."""
    path = new_folder(spark)
    series_io.write_metrics(fx.scores(spark, sf).groupBy("entity", "view").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("s").alias("mean")), path)
    return series_io.read_metrics(spark, path, "entity long, view string, n long, positives long, mean double").drop("path")


@query("read_scores", ", c as (select entity from fx_scores group by entity having max(case when t < 55 then label else 0 end) = 1 and min(case when t < 55 then label else 1 end) = 0) select entity, win, view, t, round(s, 6) + 0 as s from fx_scores join c using (entity), (select cast(unnest([10, 50]) as bigint) as win) where view in ('level', 'jump') and t < 55")
def _(spark, sf):
    """A ledger written by window size and view, of which two views and two sizes are read, entities of one class left out."""
    path = new_folder(spark)
    df = fx.scores(spark, sf).where("t < 55").withColumn("win", F.explode(F.array(*map(F.lit, (10, 50, 100)))))
    series_io.write_scores(df, path)
    return series_io.read_scores(spark, path, ["level", "jump", "absent"], [10, 50, 200], ["entity"]).select("entity", "win", "view", "t", "s")


@query("validate_series", """, x as (select *, case when entity % 5 = 1 and t = 3 then cast('nan' as double) else v end as w from fx_series where not (entity % 5 = 2 and t = 0))
select entity, problem from (select entity, unnest([case when min(t) <> 0 or max(t) <> count(*) - 1 then 'steps' end, case when count(*) filter (where w is null or isnan(w)) > 0 then 'missing values' end,
case when count(*) filter (where label not in (0, 1)) > 0 then 'labels' end, case when count(*) filter (where split = 'train') = 0 then 'no train rows' end]) as problem from x group by entity) where problem is not null""")
def _(spark, sf):
    df = fx.series(spark, sf).where(~((F.col("entity") % 5 == 2) & (F.col("t") == 0)))
    return series_io.validate_series(df.withColumn("v", F.when((F.col("entity") % 5 == 1) & (F.col("t") == 3), float("nan")).otherwise(F.col("v"))), E)


@query("select_by_keyword", """, f as (select distinct p_name || p_brand as name from part), r as (select name, case when contains(lower(name), 'ring') then 0 when contains(lower(name), 'bolt') then 1 else 2 end as k from f),
g as (select *, row_number() over (partition by k order by name) = 1 and k < 2 as first from r) select name from (select name from g order by first desc, case when first then k else 0 end, name limit 6)""")
def _(spark, sf):
    files = fx.read(spark, sf, "part").select(F.concat("p_name", "p_brand").alias("name")).distinct()
    return series_io.select_by_keyword(files, ["ring", "bolt"], 6)


@query("forward_fill", f""", h as (select *, {HOLES} as w from fx_series)
select entity, t, round(coalesce(last_value(case when not isnan(w) then w end ignore nulls) over (partition by entity order by t rows between unbounded preceding and current row), 0.0), 6) + 0 as v from (select * replace (case when isinf(w) then null else w end as w) from h)""")
def _(spark, sf):
    df = holes(spark, sf).withColumn("v", F.when(F.abs("v") == float("inf"), None).otherwise(F.col("v")))
    return prep.forward_fill(df, E).select("entity", "t", "v")


@query("zero_nonfinite", f"select entity, t, round(case when isfinite({HOLES}) then v else 0.0 end, 6) + 0 as v from fx_series")
def _(spark, sf):
    return prep.zero_nonfinite(holes(spark, sf)).select("entity", "t", "v")


@query("mean_impute", f""", h as (select entity, t, split, case when isfinite({HOLES}) then v end as w from fx_series)
select entity, t, round(coalesce(w, avg(case when split = 'train' then w end) over (partition by entity), 0.0), 6) + 0 as v from h""")
def _(spark, sf):
    return prep.mean_impute(holes(spark, sf), E).select("entity", "t", "v")


@query("time_split", """, a as (select *, case when t < floor(count(*) over (partition by entity) * cast(0.6 as double)) then 'train' else 'test' end as sp from fx_series)
select entity, sp as split, cast(row_number() over (partition by entity, sp order by t) - 1 as bigint) as t, round(v, 6) + 0 as v, label from a where sp = 'test' or label = 0""")
def _(spark, sf):
    return prep.time_split(fx.series(spark, sf), E, 0.6).select("entity", "split", "t", "v", "label")


@query("half_split", "select entity, t, split from fx_split")
def _(spark, sf):
    return prep.half_split(fx.daily(spark, sf), E).select("entity", "t", "split")


STATS = ", st as (select entity, ch, avg(v) as mu, stddev_pop(v) as sd, min(v) as lo, max(v) as hi from fx_long where split = 'train' group by entity, ch)"


@query("standardize", STATS + " select entity, t, ch, round((v - mu) / case when sd > 0 then sd else 1 end, 6) + 0 as v from fx_long join st using (entity, ch)")
def _(spark, sf):
    return prep.standardize(fx.daily_long(spark, sf), ["entity", "ch"]).select("entity", "t", "ch", "v")


@query("minmax_train", STATS + " select entity, t, ch, round(case when hi > lo then (v - lo) / (hi - lo) else 0 end, 6) + 0 as v from fx_long join st using (entity, ch)")
def _(spark, sf):
    return prep.minmax_train(fx.daily_long(spark, sf), ["entity", "ch"]).select("entity", "t", "ch", "v")


@query("temporal_val_split", "select entity, view, t, case when t < greatest(1, least(floor(count(*) over (partition by entity, view) * cast(0.3 as double)), count(*) over (partition by entity, view) - 1)) then 'val' else 'test' end as split from fx_scores")
def _(spark, sf):
    return prep.temporal_val_split(fx.scores(spark, sf), EV, 0.3).select("entity", "view", "t", "split")


@query("anchor_split_with_gap", """, a as (select *, count(*) over (partition by entity) as tt from fx_series), b as (select *, t - 3 as i, count(*) over (partition by entity) as n from a where t >= 3 and t <= tt - 2),
c as (select *, n - greatest(1, floor(n * cast(0.2 as double))) as f from b) select entity, t, case when i >= f then 'val' else 'train' end as part from c where i >= f or i < f - case when f - 4 > 0 then 4 else 0 end""")
def _(spark, sf):
    return prep.anchor_split_with_gap(fx.series(spark, sf), E, 4, 1).select("entity", "t", "part")


@query("even_subsample", """, c as (select entity, count(*) as n from fx_series group by entity), p as (select entity, n, unnest(range(0, 20)) as j from c)
select s.entity, s.t from fx_series s join c using (entity) where c.n <= 20 or exists (select 1 from p where p.entity = s.entity and s.t = (p.j * (p.n - 1)) // 19)""")
def _(spark, sf):
    return prep.even_subsample(fx.series(spark, sf), E, 20).select("entity", "t")


@query("stratified_subsample", """, c as (select entity, sum(label) as pos, count(*) - sum(label) as neg from fx_series group by entity), k as (select *, least(pos, greatest(15, 30 - neg)) as kp from c),
k2 as (select entity, 1 as label, pos as n, kp as k from k union all select entity, 0, neg, least(neg, 30 - kp) from k), r as (select entity, t, label, row_number() over (partition by entity, label order by t) - 1 as i from fx_series),
p as (select distinct entity, label, case when k >= n then j else (j * (n - 1)) // greatest(k - 1, 1) end as i from k2, (select unnest(range(0, 1000)) as j) where j < case when k >= n then n else k end)
select entity, t, r.label from r join p using (entity, label, i)""")
def _(spark, sf):
    return prep.stratified_subsample(fx.series(spark, sf), E, 30).select("entity", "t", "label")


WIN = "window w as (partition by entity order by t rows between current row and 9 following)"
FULL = "qualify count(*) over w = 10 and t % 5 = 0"


@query("sliding_windows", f"select entity, t // 5 as w, t as start, list_transform(list(v) over w, lambda x: [round(x, 6)]) as xs from fx_series {WIN} {FULL}".replace("select entity", " select entity"))
def _(spark, sf):
    out = windows.sliding_windows(fx.series(spark, sf), E, 10, 5, ["v"])
    return out.withColumn("xs", F.transform("xs", lambda r: F.transform(r, lambda x: F.round(x, 6))))


@query("window_labels", f"select entity, t // 5 as w, max(label) over w as label from fx_series {WIN} {FULL}")
def _(spark, sf):
    return windows.window_labels(fx.series(spark, sf), E, 10, 5)


@query("normal_windows", f"select * from (select entity, t // 5 as w, max(label) over w as label from fx_series where split = 'train' {WIN} {FULL}) where label = 0")
def _(spark, sf):
    return windows.window_labels(fx.series(spark, sf).where("split = 'train'"), E, 10, 5).where("label = 0")


@query("feat_mean_pool", f"select entity, t // 5 as w, max(label) over w as label, round(avg(x0) over w, 6) + 0 as x0, round(avg(x1) over w, 6) + 0 as x1, round(avg(x3) over w, 6) + 0 as x3 from fx_daily {WIN} {FULL}")
def _(spark, sf):
    return windows.mean_pool(fx.daily(spark, sf), E, 10, 5, ["x0", "x1", "x3"])


@query("feat_flatten", f"select entity, t // 5 as w, flatten(list_transform(list([x0, x3]) over w, lambda p: [round(p[1], 6), round(p[2], 6)])) as f from fx_daily {WIN} {FULL}")
def _(spark, sf):
    out = windows.flatten(fx.daily(spark, sf), E, 10, 5, ["x0", "x3"])
    return out.select("entity", "w", F.transform("f", lambda x: F.round(x, 6)).alias("f"))


@query("feat_last_step", f"select entity, t // 5 as w, round(last_value(x0) over w, 6) + 0 as x0, round(last_value(x3) over w, 6) + 0 as x3 from fx_daily {WIN} {FULL}")
def _(spark, sf):
    return windows.last_step(fx.daily(spark, sf), E, 10, 5, ["x0", "x3"])


@query("pool_tokens", "select w, d, round(avg(x), 6) + 0 as x from (select w, unnest(vec) as x, unnest(range(0, 64)) as d from fx_tokens) group by w, d")
def _(spark, sf):
    return windows.pool_tokens(fx.tokens(spark, sf), ["w"]).select("w", F.posexplode("f").alias("d", "x"))


@query("token_sequences", """, d as (select w, d, avg(x) as x, max(label) as label from (select w, label, unnest(vec) as x, unnest(range(0, 64)) as d from fx_tokens) group by w, d), n as materialized (select w as t, list(0 + round(x, 6) order by d) as f, max(label) as label from d group by w)
select a.t - 5 as i, list(b.t order by b.t) as past, flatten(list(b.f order by b.t)) as xs, a.t as target, any_value(a.label) as label from n a join n b on b.t between a.t - 5 and a.t - 2 group by a.t having count(*) = 4""")
def _(spark, sf):
    t = fx.tokens(spark, sf)
    frames = windows.pool_tokens(t, ["w"]).join(t.groupBy("w").agg(F.max("label").alias("label")), "w").withColumnRenamed("w", "t")
    out = windows.token_sequences(frames, [], 4, 2, "f")
    return out.select("i", "past", F.transform(F.flatten("xs"), lambda x: F.round(x, 6)).alias("xs"), "target", "label")


@query("channel_groups", "select entity, ch // 3 as \"group\", t, round(avg(v), 6) + 0 as v from fx_long group by entity, ch // 3, t")
def _(spark, sf):
    return windows.channel_groups(fx.daily_long(spark, sf), 3).groupBy("entity", "group", "t").agg(F.avg("v").alias("v"))


@query("window_to_timestep", """, x as (select entity, t as w, v as s, count(*) over (partition by entity) as n from fx_series where true), k as (select * from x where w <= n - 10 and w % 3 = 0),
st as (select entity, unnest(range(w, least(w + 9, n - 1) + 1)) as t, s from k), m as (select entity, t, avg(s) as s from st group by entity, t), g as (select entity, unnest(range(0, n)) as t from (select distinct entity, n from k))
select g.entity, g.t, round(coalesce(m.s, 0), 6) + 0 as s from g left join m using (entity, t)""")
def _(spark, sf):
    from pyspark.sql import Window

    x = fx.series(spark, sf).select("entity", F.col("t").alias("w"), F.col("v").alias("s"), F.count("*").over(Window.partitionBy("entity")).alias("T"))
    return windows.window_to_timestep(x.where((F.col("w") <= F.col("T") - 10) & (F.col("w") % 3 == 0)), E, 10)


@query("aggregate_trace", """, m as (select entity, t, v - median(v) over (partition by entity, ch) as v from fx_long), a as (select entity, t, avg(v) as s from m group by entity, t)
select entity, t, round(case when stddev_pop(s) over (partition by entity) > 1e-12 then s / stddev_pop(s) over (partition by entity) else 0 end, 6) + 0 as s from a""")
def _(spark, sf):
    return windows.aggregate_trace(fx.daily_long(spark, sf), E)


@query("concat_layers", "select w, patch, len(vec) * 2 as size, round(list_sum(vec) * 3, 6) + 0 as total from fx_tokens")
def _(spark, sf):
    a = fx.tokens(spark, sf)
    b = a.withColumn("vec", F.transform("vec", lambda x: x * 2))
    out = windows.concat_layers(a, b, ["w", "patch"])
    return out.select("w", "patch", F.size("vec").alias("size"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("total"))


# ------------------------------------------------------------------ G

EDGE = """, e as (select entity, view, t, s, count(*) over p as n, row_number() over (partition by entity, view order by t) - 1 as i, first_value(s) over f as a, last_value(s) over f as b from fx_scores
window p as (partition by entity, view), f as (partition by entity, view order by t rows between unbounded preceding and unbounded following))"""
SMOOTH = EDGE + """, sm as (select entity, view, t, case when n <= 5 then avg(s) over (partition by entity, view) else (sum(s) over (partition by entity, view order by t rows between 2 preceding and 2 following)
+ greatest(0, 2 - i) * a + greatest(0, i + 2 - n + 1) * b) / 5 end as s from e)"""


@query("smooth_mean", SMOOTH + " select entity, view, t, round(s, 6) + 0 as s from sm")
def _(spark, sf):
    return post.smooth_mean(fx.scores(spark, sf), EV, 5).select("entity", "view", "t", "s")


@query("smooth_median", EDGE + """, o as (select unnest(range(-2, 3)) as o), x as (select e.entity, e.view, e.t, e.n, least(greatest(e.i + o.o, 0), e.n - 1) as j from e, o)
select x.entity, x.view, x.t, round(median(y.s), 6) + 0 as s from x join e y on x.entity = y.entity and x.view = y.view and x.j = y.i group by x.entity, x.view, x.t""")
def _(spark, sf):
    return post.smooth_median(fx.scores(spark, sf), EV, 5).select("entity", "view", "t", "s")


PART = "over (partition by entity, view)"
MINMAX = f"case when max(s) {PART} > min(s) {PART} then (s - min(s) {PART}) / (max(s) {PART} - min(s) {PART}) else 0 end"
ZS = f"case when stddev_pop(s) {PART} > 1e-12 then (s - avg(s) {PART}) / stddev_pop(s) {PART} else 0 end"
RANK = f"(rank() over (partition by entity, view order by s) + (count(*) over (partition by entity, view, s) - 1) / 2.0) / count(*) {PART}"


@query("norm_minmax", f"select entity, view, t, round({MINMAX}, 6) + 0 as s from fx_scores")
def _(spark, sf):
    return post.norm_minmax(fx.scores(spark, sf), EV).select("entity", "view", "t", "s")


@query("norm_zscore01", f"select entity, view, t, round({MINMAX}, 6) + 0 as s from (select entity, view, t, {ZS} as s from fx_scores)")
def _(spark, sf):
    return post.norm_zscore01(fx.scores(spark, sf), EV).select("entity", "view", "t", "s")


@query("zscore", f"select entity, view, t, round({ZS}, 6) + 0 as s from fx_scores")
def _(spark, sf):
    return post.norm_zscore(fx.scores(spark, sf), EV).select("entity", "view", "t", "s")


REF = ", r as (select entity, view, avg(s) as mu, stddev_pop(s) as sd, min(s) as lo, max(s) as hi from fx_scores where t < 20 group by entity, view)"


@query("zscore_ref", REF + " select entity, view, t, round(case when sd >= 1e-8 then (s - mu) / sd else 0 end, 6) + 0 as s from fx_scores join r using (entity, view)")
def _(spark, sf):
    df = fx.scores(spark, sf)
    return post.zscore_ref(df, df.where("t < 20"), EV).select("entity", "view", "t", "s")


@query("minmax_ref", REF + f" select entity, view, t, round(case when hi > lo then (s - lo) / (hi - lo) else {MINMAX} end, 6) + 0 as s from fx_scores join r using (entity, view)")
def _(spark, sf):
    df = fx.scores(spark, sf)
    return post.minmax_ref(df, df.where("t < 20"), EV).select("entity", "view", "t", "s")


@query("rank_norm", f"select entity, view, t, round({RANK}, 6) + 0 as s from fx_scores")
def _(spark, sf):
    return post.rank_norm(fx.scores(spark, sf), EV).select("entity", "view", "t", "s")


#: Views of different lengths, for the aligning queries.
SHORT = "(select * from fx_scores where not (view = 'dev' and t % 9 = 8) and not (view = 'jump' and t < 3))"
NUMBERED = f", q as (select entity, view, cast(row_number() over (partition by entity, view order by t) - 1 as bigint) as t, s, label, count(*) over (partition by entity, view) as n from {SHORT}), q2 as (select *, min(n) over (partition by entity) as m from q)"


def uneven(spark, sf):
    from pyspark.sql import Window

    df = fx.scores(spark, sf).where("not (view = 'dev' and t % 9 = 8) and not (view = 'jump' and t < 3)")
    return df.withColumn("t", (F.row_number().over(Window.partitionBy("entity", "view").orderBy("t")) - 1).cast("long"))


@query("align_head", NUMBERED + " select entity, view, t, round(s, 6) + 0 as s from q2 where t < m")
def _(spark, sf):
    return post.align_head(uneven(spark, sf), E).select("entity", "view", "t", "s")


@query("align_tail", NUMBERED + " select entity, view, t - (n - m) as t, round(s, 6) + 0 as s from q2 where t >= n - m")
def _(spark, sf):
    return post.align_tail(uneven(spark, sf), E).select("entity", "view", "t", "s")


@query("align_pad", "select l.entity, l.t, case when l.label > 0 then 1 else 0 end as label, round(coalesce(s.s, 0), 6) + 0 as s from fx_series l left join (select * from fx_scores where view = 'dev' and t < 40) s using (entity, t)")
def _(spark, sf):
    scores = fx.scores(spark, sf).where("view = 'dev' and t < 40")
    return post.align_pad(scores, fx.series(spark, sf).select("entity", "t", "label"), E).select("entity", "t", "label", "s")


# ------------------------------------------------------------------ H

W = {"level": 0.5, "dev": 0.3, "jump": 0.2}
WSQL = "case view when 'level' then cast(0.5 as double) when 'dev' then cast(0.3 as double) else cast(0.2 as double) end"
NORMED = {"sum": "s", "rank": RANK, "zscore": ZS, "minmax": MINMAX}

for _name, _method in (("fuse_weighted_sum", "sum"), ("fuse_rank", "rank"), ("fuse_zscore", "zscore"), ("fuse_minmax", "minmax")):
    query(_name, f" select entity, t, round(sum(x * {WSQL}), 6) + 0 as s, max(label) as label from (select *, {NORMED[_method]} as x from fx_scores) group by entity, t")(
        lambda spark, sf, m=_method: fusion.fuse(fx.scores(spark, sf), E, W, m)
    )


@query("fuse_conf_global", f", c as (select *, 1 / (var_pop(s) {PART} + 1e-8) as c, {RANK} as x from fx_scores) select entity, t, round(sum(x * c) / sum(c), 6) + 0 as s, max(label) as label from c group by entity, t")
def _(spark, sf):
    return fusion.fuse_conf_global(fx.scores(spark, sf), E)


@query("fuse_confidence", """, r as (select w, patch, unnest(['a', 'b']) as view, unnest([abs(vec[1]), abs(vec[2])]) as r from fx_tokens), o as (select w, view, avg(r) as s, 1 / (var_pop(r) + 1e-8) as c from r group by w, view)
select w, round(sum(s * c) / sum(c), 6) + 0 as s from o group by w""")
def _(spark, sf):
    parts = F.array(F.struct(F.lit("a").alias("view"), F.abs(F.col("vec")[0]).alias("r")), F.struct(F.lit("b").alias("view"), F.abs(F.col("vec")[1]).alias("r")))
    return fusion.fuse_confidence(fx.tokens(spark, sf).select("w", "patch", F.explode(parts).alias("x")).select("w", "patch", "x.*"), ["w"])


@query("view_disagreement", "select entity, t, round(stddev_pop(s), 6) + 0 as s from fx_scores group by entity, t")
def _(spark, sf):
    return fusion.view_disagreement(fx.scores(spark, sf), E)


ENSEMBLES = {"mean_disagree": ("s", "avg(x) + cast(0.5 as double) * stddev_pop(x)"), "mean": ("s", "avg(x)"), "max": ("s", "max(x)"), "rank_mean": (RANK, "avg(x)"), "zscore": (ZS, "avg(x)"), "rank": (RANK, "avg(x)"), "minmax": (MINMAX, "avg(x)")}
for _method, (_x, _agg) in ENSEMBLES.items():
    query(f"ensemble_{_method}", f" select entity, t, round({_agg}, 6) + 0 as s, max(label) as label from (select *, {_x} as x from fx_scores) group by entity, t")(
        lambda spark, sf, m=_method: fusion.ensemble(fx.scores(spark, sf), E, m)
    )

TAIL = NUMBERED + ", z as (select entity, view, t - (n - m) as t, s, label from q2 where t >= n - m)"


@query("multiscale", TAIL + f", a as (select entity, view, t, label, {ZS} as s from z), b as (select entity, view, t, label, {MINMAX} as x from a) select entity, t, round(avg(x), 6) + 0 as s, max(label) as label from b group by entity, t")
def _(spark, sf):
    return fusion.multiscale(uneven(spark, sf), E)


@query("multiscale_rank", TAIL + f", a as (select entity, view, t, label, {RANK} as x from z) select entity, t, round(avg(x), 6) + 0 as s, max(label) as label from a group by entity, t")
def _(spark, sf):
    return fusion.multiscale(uneven(spark, sf), E, "rank")


PAIRS = ", pr as (select a.entity, a.t, a.label, a.s as a, b.s as b from fx_scores a join fx_scores b using (entity, t) where a.view = 'dev' and b.view = 'jump')"


@query("hybrid", PAIRS + " select entity, t, label, round(cast(0.7 as double) * a + (1 - cast(0.7 as double)) * b, 6) + 0 as s from pr")
def _(spark, sf):
    return fusion.hybrid(fx.scores(spark, sf), E, "dev", "jump", 0.7)


@query("hybrid_max", PAIRS + " select entity, t, label, round(greatest(a, b), 6) + 0 as s from pr")
def _(spark, sf):
    return fusion.hybrid(fx.scores(spark, sf), E, "dev", "jump")


def z_of(c: str) -> str:
    p = "over (partition by entity)"
    return f"case when stddev_pop({c}) {p} > 1e-8 then ({c} - avg({c}) {p}) / stddev_pop({c}) {p} else 0 end"


@query("dual_signal", PAIRS + f" select entity, t, label, round(cast(0.3 as double) * ({z_of('a')}) + (1 - cast(0.3 as double)) * ({z_of('b')}), 6) + 0 as s from pr")
def _(spark, sf):
    return fusion.dual_signal(fx.scores(spark, sf), E, "dev", "jump", 0.3)


@query("views_combined", f""", z as (select entity, view, t, label, {ZS} as z from fx_scores where view in ('level', 'dev')), f as (select entity, t, max(label) as label, sum(z * case view when 'level' then cast(0.4 as double) else cast(0.6 as double) end) + cast(0.5 as double) * stddev_pop(z) as s from z group by entity, t),
e as (select *, count(*) over (partition by entity) as n, row_number() over (partition by entity order by t) - 1 as i from f), x as (select e.entity, e.t, e.label, least(greatest(e.i + o, 0), e.n - 1) as j from e, (select unnest(range(-3, 4)) as o)),
m as (select x.entity, x.t, x.label, median(y.s) as s from x join e y on x.entity = y.entity and x.j = y.i group by x.entity, x.t, x.label)
select entity, t, label, round(case when max(s) over (partition by entity) > min(s) over (partition by entity) then (s - min(s) over (partition by entity)) / (max(s) over (partition by entity) - min(s) over (partition by entity)) else 0 end, 6) + 0 as s from m""")
def _(spark, sf):
    return fusion.views_combined(fx.scores(spark, sf), E, {"level": 0.4, "dev": 0.6}, 0.5)
