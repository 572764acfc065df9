"""Time-series tables derived from the driver's tables: series, days, tokens, scores and a metrics ledger."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One univariate series a user: ``entity, t, v, label, split``, the first half of the steps being train."""
    e = read(spark, sf_dir, "events")
    by = Window.partitionBy("user_id")
    t = (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("long")
    out = e.select(F.col("user_id").alias("entity"), t.alias("t"), F.count("*").over(by).alias("n"), F.col("value").alias("v"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))
    return out.select("entity", "t", "v", "label", F.when(F.col("t") < F.floor(F.col("n") / 2), "train").otherwise("test").alias("split"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels a return flag and day: ``entity, t, x0..x3, label``; labels are made of runs of days."""
    li = read(spark, sf_dir, "lineitem")
    d = li.groupBy(F.col("l_returnflag").alias("entity"), F.col("l_shipdate").cast("date").alias("d")).agg(
        F.sum("l_quantity").cast("double").alias("x0"), F.avg("l_discount").cast("double").alias("x1"), F.sum("l_extendedprice").cast("double").alias("x2"), F.count("*").cast("double").alias("x3")
    )
    t = (F.row_number().over(Window.partitionBy("entity").orderBy("d")) - 1).cast("long")
    label = F.when(F.pmod(F.datediff("d", F.lit("1970-01-01").cast("date")), F.lit(37)) < 3, 1).otherwise(0)
    return d.select("entity", t.alias("t"), "x0", "x1", "x2", "x3", label.alias("label"))


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`daily` with a row a channel, ``entity, split, t, ch, v, label``, the first half of the steps being train."""
    d = daily(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("entity"))
    d = d.withColumn("split", F.when(F.col("t") < F.floor(n / 2), "train").otherwise("test"))
    return d.select("entity", "split", "t", "label", F.posexplode(F.array("x0", "x1", "x2", "x3")).alias("ch", "v"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four patch tokens a window: ``w, patch, vec, label``."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).alias("w"), (F.col("vec_id") % 4).cast("int").alias("patch"), F.col("embedding").cast("array<double>").alias("vec"), F.when(F.col("label") == 9, 1).otherwise(0).alias("label"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three score streams a user: ``entity, view, t, s, label``."""
    e = read(spark, sf_dir, "events")
    by = Window.partitionBy("user_id")
    order = by.orderBy("ts", "event_id")
    b = e.select(F.col("user_id").alias("entity"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").alias("v"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"), F.lag("value").over(order).alias("pv"), F.avg("value").over(by).alias("mv"))
    views = F.array(F.struct(F.lit("level").alias("view"), F.col("v").alias("s")), F.struct(F.lit("dev").alias("view"), F.abs(F.col("v") - F.col("mv")).alias("s")), F.struct(F.lit("jump").alias("view"), F.abs(F.col("v") - F.coalesce("pv", "v")).alias("s")))
    return b.select("entity", "t", "label", F.explode(views).alias("x")).select("entity", "x.view", "t", "x.s", "label")


#: The same tables in SQL, for oracles.
SQL = """
with fx_series as (
    select entity, t, v, label, case when t < floor(n / 2.0) then 'train' else 'test' end as split from (
        select user_id as entity, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as t, count(*) over (partition by user_id) as n,
               value as v, case when event_type = 'error' then 1 else 0 end as label from events)),
fx_daily as (
    select entity, cast(row_number() over (partition by entity order by d) - 1 as bigint) as t, x0, x1, x2, x3,
           case when date_diff('day', date '1970-01-01', d) % 37 < 3 then 1 else 0 end as label
    from (select l_returnflag as entity, cast(l_shipdate as date) as d, cast(sum(l_quantity) as double) as x0, cast(avg(l_discount) as double) as x1,
                 cast(sum(l_extendedprice) as double) as x2, cast(count(*) as double) as x3 from lineitem group by 1, 2)),
fx_split as (select *, case when t < floor(count(*) over (partition by entity) / 2.0) then 'train' else 'test' end as split from fx_daily),
fx_long as (
    select entity, split, t, label, 0 as ch, x0 as v from fx_split union all select entity, split, t, label, 1, x1 from fx_split
    union all select entity, split, t, label, 2, x2 from fx_split union all select entity, split, t, label, 3, x3 from fx_split),
fx_tokens as (
    select cast(floor(vec_id / 4.0) as bigint) as w, cast(vec_id % 4 as int) as patch, [cast(x as double) for x in embedding] as vec,
           case when label = 9 then 1 else 0 end as label from embeddings),
fx_base as (
    select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as t, value as v,
           case when event_type = 'error' then 1 else 0 end as label, lag(value) over (partition by user_id order by ts, event_id) as pv,
           avg(value) over (partition by user_id) as mv from events),
fx_scores as (
    select user_id as entity, 'level' as view, t, v as s, label from fx_base union all
    select user_id, 'dev', t, abs(v - mv), label from fx_base union all
    select user_id, 'jump', t, abs(v - coalesce(pv, v)), label from fx_base)
"""
