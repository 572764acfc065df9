"""Long series in blocks: running sums in two levels, and frames that reach over block bounds.

A key is split into blocks of consecutive rows, so that one long series is many tasks: a running sum
is a block's own plus the totals of the blocks before it, and a frame of neighbours sees copies of the
rows that lie close behind its block's bounds.
"""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.shared import written

#: Steps of a block.
BLOCK = 1 << 16
#: Rows of short series that a task gets, where the session's number of partitions would give it more.
TASK = 1 << 20


def by_size(rows: DataFrame, keys: list[str], short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame], block: int | None = None) -> DataFrame:
    """``short`` of the rows of keys with at most a block of rows, ``long`` of the others, if there are any.

    ``rows`` is read more than once, so it should be a written table.  Those that ``short`` gets lie by key: windows
    and groups of these keys, and of more columns beside them, move no row again.  Their partitions grow in number
    with the rows, so that what a task sorts does not.
    """
    if not keys:
        return long(rows)
    least = -(-rows.count() // TASK)
    parts = [least] if least > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    big = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > (block or BLOCK))
    big = written(big.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]))
    if big.isEmpty():
        return short(rows.repartition(*parts, *keys))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    few = rows.join(F.broadcast(big), same, "left_anti")  # at most a row for each block of the table
    return short(few.repartition(*parts, *keys)).unionByName(long(rows.join(F.broadcast(big), same, "left_semi")))


def running(df: DataFrame, keys: list[str], block: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums in ``order``, this row included; ``block`` numbers blocks of consecutive rows of a key in that order.

    ``df`` is read twice: once for one row of totals a block, and once for the rows.
    """
    marked = df.select("*", block.alias("__block"), *[v.alias(f"__{n}") for n, v in sums.items()])
    totals = marked.groupBy(*keys, "__block").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums])
    own = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select(*df.columns, "__block", *[F.sum(f"__{n}").over(own).alias(f"__{n}") for n in sums])
    same = F.col("__block").eqNullSafe(F.col("__b"))
    return local.join(before, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], same)).select(*df.columns, *[(F.col(f"__{n}") + F.col(f"__before_{n}")).alias(n) for n in sums])


def counted(df: DataFrame, keys: list[str], value: str, count: Column, falling: bool = False) -> DataFrame:
    """One row a key and distinct value, ``keys, v__, n__, until__, total__``: its count, and that of all values up to it.

    Values are written in ranges of their order, so that no key is sorted whole.
    """
    order = F.desc("v__") if falling else F.asc("v__")
    one = df.groupBy(*keys, F.col(value).alias("v__")).agg(count.alias("n__"))
    one = written(one.repartitionByRange(*keys, order).withColumn("block__", F.spark_partition_id()))
    out = running(one, keys, F.col("block__"), [order], {"until__": F.col("n__")})
    total = one.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sum("n__").alias("total__"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = out.join(total, reduce(and_, same)) if same else out.crossJoin(F.broadcast(total))  # one row of totals
    return joined.select(*keys, "v__", "n__", "until__", "total__")


def numbered(df: DataFrame, keys: list[str], t: str = "t", name: str = "__i", block: int | None = None) -> DataFrame:
    """Adds the number of each row of its key in order of the whole number ``t``, from 0."""
    out = running(df, keys, F.floor(F.col(t) / (block or BLOCK)), [F.col(t)], {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)


def halo(df: DataFrame, t: str, before: int, after: int, block: int | None = None) -> DataFrame:
    """Rows with the blocks that need them, ``__blk``: their own, and those whose frames reach them.

    A row's frame holds the rows whose ``t`` lies from ``before`` less to ``after`` more than its own.
    Keep :func:`own` rows after the frames are done.
    """
    size = block or BLOCK
    reach = F.sequence(F.floor((F.col(t) - after) / size), F.floor((F.col(t) + before) / size))
    return df.withColumn("__blk", F.explode(reach))


def own(t: str, block: int | None = None) -> Column:
    """Whether a row is in its own block."""
    return F.col("__blk") == F.floor(F.col(t) / (block or BLOCK))


def steps(total: Column, block: int | None = None) -> Column:
    """Arrays of the numbers from 0 to below ``total``, a block each."""
    size = block or BLOCK
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / size)), lambda b: F.struct((b * size).alias("a"), F.least(b * size + size, total).alias("b"))))
