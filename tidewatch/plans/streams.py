"""Queries of online guards: events arrive late and repeated, as a stream of files."""

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import conformal, scorers
from tidewatch.plans import fixtures as fx
from tidewatch.plans.feature import MS, vectors
from tidewatch.plans.registry import query
from tidewatch.sources.shared import new_folder
from tidewatch.streaming import guard, replay

#: The first steps of each series calibrate; alpha and buffer of the guards.
CALIBRATION, ALPHA, WINDOW = 30, 0.05, 40
#: The watermark's delay, longer than regular rows are late; days of a slice; and of which first days some rows come how many days too late.
DELAY, SLICE_DAYS, LATE_DAYS, LATE_BY = "4 days", 6, 6, 40


def level(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, ts, t, s`` of the events' values; written once, since streams and calibration both read it."""
    e = fx.read(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = e.select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").alias("s"))
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = level(spark, sf)
    return df.where(F.col("t") < CALIBRATION).select("entity", "s"), df.where(F.col("t") >= CALIBRATION)


def late(rows: DataFrame) -> DataFrame:
    """Marks the rows that arrive far too late: every seventh step of the first days."""
    first = rows.agg(F.min(F.to_date("ts")).alias("first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("too_late", (F.col("t") % 7 == 3) & (F.datediff("ts", "first") < LATE_DAYS)).drop("first")


def arrivals(rows: DataFrame, too_late: bool) -> DataFrame:
    """The stream of the rows: up to two days late, every eleventh also a second time, some far too late, and a heartbeat at the end."""
    spark = rows.sparkSession
    bounds = rows.agg(F.min("ts"), F.max("ts")).first()
    day = F.make_dt_interval(F.lit(1))
    delay = F.pmod(F.xxhash64("entity", "t"), F.lit(5)) * F.make_dt_interval(F.lit(0), F.lit(12))
    marked = late(rows) if too_late else rows.withColumn("too_late", F.lit(False))
    first = marked.withColumn("arrival", F.col("ts") + F.when(F.col("too_late"), F.make_dt_interval(F.lit(LATE_BY))).otherwise(delay))
    again = marked.where((F.col("t") % 11 == 5) & ~F.col("too_late")).withColumn("arrival", F.col("ts") + delay + day)
    if bounds[0] is None:
        return replay.read_arrivals(spark, replay.write_arrivals(first.drop("too_late"), "arrival", [], "entity")).withWatermark("ts", DELAY)
    beat = bounds[1] + datetime.timedelta(days=60)
    end = spark.range(1).select(F.lit(None).cast("long").alias("entity"), F.lit(beat).alias("ts"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("s"), F.lit(False).alias("too_late"), F.lit(beat).alias("arrival"))
    slices = [bounds[0] + datetime.timedelta(days=SLICE_DAYS * k) for k in range(1, 9)]
    sent = first.unionByName(again).unionByName(end.select(*first.columns)).drop("too_late")
    return replay.read_arrivals(spark, replay.write_arrivals(sent, "arrival", [*slices, beat], "entity")).withWatermark("ts", DELAY)


CAL = f""", lv as materialized (select entity, t, s from fx_scores where view = 'level'),
cl as materialized (select entity, s, row_number() over (partition by entity order by s) as rk, count(*) over (partition by entity) as n from lv where t < {CALIBRATION}),
ct as (select entity, s as thr from cl where rk = greatest(1, least(ceil((cast(n as double) + 1) * (1 - cast({ALPHA} as double))), n)))"""


def guard_sql(mode: str, rows: str = "lv") -> str:
    """The guard step by step: ``g`` holds a row an entity and step, with the state behind it."""
    x, back = ("(s - mu) / (sd + 1e-10)", "used * (sd + 1e-10) + mu") if mode == "aci" else ("s", "used")
    keep = "true" if mode == "aci" else "not flag"
    off = "abs(mean)" if mode == "aci" else "abs(mean - mu) / greatest(sd, 1e-10)"
    level = f"greatest(1e-10, least(1 - 1e-10, a + cast(0.01 as double) * (cast({ALPHA} as double) - case when flag then 1 else 0 end)))" if mode == "aci" else "a"
    at = lambda n: f"cast(greatest(1, least(ceil((cast({n} as double) + 1) * (1 - greatest(1e-10, least(1 - 1e-10, a)))), {n})) as bigint)"
    return CAL + f""", ms as (select entity, avg(s) as mu, stddev_pop(s) as sd, count(*) as n from cl group by entity),
cs as materialized (select entity, mu, sd, max(n) as n, list(x order by x) as cal from (select entity, mu, sd, ms.n, {x} as x from cl join ms using (entity)) group by entity, mu, sd),
st as materialized (select entity, t, s, row_number() over (partition by entity order by t) as i from {rows} where t >= {CALIBRATION}),
gs as materialized (select * from (with recursive g as (
    select entity, cast(0 as bigint) as i, cast(null as bigint) as t, cast(null as double) as s, cast(null as double) as p, cast(null as double) as thr, false as flag,
           cast([] as double[]) as buf, cast(null as double) as rolling, false as drift, cast({ALPHA} as double) as a, cast(0 as bigint) as alarms from cs
    union all
    select entity, i, t, s, p, {back}, flag, nb, case when due then list_sort(nb)[{at('len(nb)')}] else rolling end, case when due then {off} > 3 else drift end, {level}, alarms + case when flag then 1 else 0 end
    from (select *, list_avg(nb) as mean, {keep} and len(nb) >= {max(10, WINDOW // 10)} as due from (
        select *, case when {keep} then list_append(buf, x)[-{WINDOW}:] else buf end as nb from (
            select *, x > used as flag from (
                select *, (1 + len([y for y in cal if y >= x])) / (n + 1.0) as p, case when rolling is not null and not drift then rolling else cal[{at('n')}] end as used from (
                    select r.entity, r.i, r.t, r.s, {x.replace('s - mu', 'r.s - mu') if mode == 'aci' else 'r.s'} as x, g.buf, g.rolling, g.drift, g.a, g.alarms, c.cal, c.n, c.mu, c.sd
                    from g join st r on r.entity = g.entity and r.i = g.i + 1 join cs c on c.entity = g.entity)))))
) select * from g))"""


STEPS = " select entity, t, round(s, 6) + 0 as s, round(p, 6) + 0 as p_value, round(thr, 6) + 0 as threshold, flag, drift, alarms as n_alarms, i as n_seen from gs where i > 0"


@query("stream_fixed", CAL + f" select entity, t, s > thr as flag from lv join ct using (entity) where t >= {CALIBRATION}")
def _(spark, sf):
    cal, rows = parts(spark, sf)
    stream = arrivals(rows, False).where("t is not null").dropDuplicatesWithinWatermark(["entity", "t"])
    return replay.run_append(guard.stream_fixed(stream, conformal.conformal_threshold(cal, ["entity"], ALPHA)).select("entity", "t", "flag"))


@query("stream_rolling", guard_sql("rolling") + STEPS)
def _(spark, sf):
    cal, rows = parts(spark, sf)
    return replay.run_append(guard.guard_stream(arrivals(rows, False), cal, mode="rolling", event_time="ts", alpha=ALPHA, window=WINDOW))


@query("stream_aci", guard_sql("aci") + STEPS)
def _(spark, sf):
    cal, rows = parts(spark, sf)
    return replay.run_append(guard.guard_stream(arrivals(rows, False), cal, mode="aci", event_time="ts", alpha=ALPHA, window=WINDOW))


ON_TIME = f"""(select b.entity, b.t, b.s from (select user_id as entity, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as t, value as s, ts from events) b,
    (select min(cast(ts as date)) as first from (select ts, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events) where t >= {CALIBRATION}) f
    where not (b.t % 7 = 3 and date_diff('day', f.first, cast(b.ts as date)) < {LATE_DAYS}))"""


@query("stream_late", guard_sql("rolling", ON_TIME) + STEPS)
def _(spark, sf):
    cal, rows = parts(spark, sf)
    return replay.run_append(guard.guard_stream(arrivals(rows, True), cal, mode="rolling", event_time="ts", alpha=ALPHA, window=WINDOW))


@query("stream_batch", guard_sql("aci") + STEPS)
def _(spark, sf):
    cal, rows = parts(spark, sf)
    return guard.guard_batch(rows, cal, mode="aci", alpha=ALPHA, window=WINDOW)


@query("stream_counts", CAL + f" select entity, cast(sum(case when s > thr then 1 else 0 end) as bigint) as n_alarms, count(*) as n_predictions, round(avg(case when s > thr then 1.0 else 0 end), 6) + 0 as far from lv join ct using (entity) where t >= {CALIBRATION} group by entity")
def _(spark, sf):
    cal, rows = parts(spark, sf)
    folder = replay.write_arrivals(rows.withColumn("arrival", F.col("ts")), "arrival", [], "entity")
    flags = guard.stream_fixed(replay.read_arrivals(spark, folder, 1), conformal.conformal_threshold(cal, ["entity"], ALPHA))
    return replay.run_update(guard.guard_stats(flags), ["entity"], "n_predictions")


@query("stream_stats", guard_sql("aci") + f""", e as (select entity, arg_max(a, i) as a, arg_max(rolling, i) as rolling, arg_max(alarms, i) as alarms, max(i) as n_seen, arg_max(drift, i) as drift from gs where i > 0 group by entity)
select entity, n as n_calibration, round(a, 6) + 0 as level, round(cal[cast(greatest(1, least(ceil((cast(n as double) + 1) * (1 - a)), n)) as bigint)] * (sd + 1e-10) + mu, 6) + 0 as fixed_threshold,
round(rolling * (sd + 1e-10) + mu, 6) + 0 as rolling_threshold, alarms as n_alarms, n_seen as n_predictions, round(alarms / cast(n_seen as double), 6) + 0 as far, drift from e join cs using (entity)""")
def _(spark, sf):
    cal, rows = parts(spark, sf)
    stats = guard.guard_stream(arrivals(rows, False), cal, mode="aci", event_time="ts", stats=True, alpha=ALPHA, window=WINDOW)
    return replay.run_update(stats, ["entity"], "n_predictions")


@query("stream_score", MS + " select entity, t, round(s, 6) + 0 as s from ms where split = 'test'")
def _(spark, sf):
    v = vectors(spark, sf, ("x0", "x3"))
    model = scorers.ledoit_wolf_fit(v.where("split = 'train'"), ["entity"])
    test = v.where("split = 'test'").select("entity", "t", "f", F.col("t").alias("arrival"))
    stream = replay.read_arrivals(spark, replay.write_arrivals(test, "arrival", [], "entity"), 1)
    return replay.run_append(guard.stream_score(stream, model).select("entity", "t", "s"))
