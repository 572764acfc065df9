"""Joins to a table of one row a key, where some keys may hold a large share of the rows."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.scratch import cut

#: A key is hot if it holds over one HOT-th of the rows, so fewer than HOT keys are.
HOT = 1024


def join_spread(spark: SparkSession, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` inner joined to ``right`` on equal ``on``, null meeting null; ``right`` has one row a key.

    Rows of hot keys meet a broadcast of fewer than HOT rows where they lie; only the others are
    shuffled, so no task gets more than a HOT-th of the rows by one key.  ``left`` is read three times.
    """
    total = left.count()
    times = left.groupBy(*on).agg(F.count("*").alias("times")).where(F.col("times") * HOT > total).drop("times")
    hot, _ = cut(spark, times)

    def same(a: DataFrame, b: DataFrame) -> tuple[DataFrame, Column]:
        b = b.withColumnsRenamed({c: f"{c}__r" for c in on})
        return b, reduce(and_, [a[c].eqNullSafe(b[f"{c}__r"]) for c in on])

    keys, meet = same(right, hot)
    few = right.join(F.broadcast(keys), meet, "left_semi")
    few, meet = same(left, few)
    first = left.join(F.broadcast(few), meet).drop(*[f"{c}__r" for c in on])
    keys, meet = same(left, hot)
    others = left.join(F.broadcast(keys), meet, "left_anti")
    rest, meet = same(others, right)
    return first.unionByName(others.join(rest, meet).drop(*[f"{c}__r" for c in on]))
