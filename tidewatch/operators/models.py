"""One model a key, applied to the key's rows without a copy of it on every row."""

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.shared import written

#: Models of so many bytes together are broadcast; larger ones meet blocks of rows.
BROADCAST_BYTES = 64 << 20
#: Rows of a block that meets one copy of its model.
ROWS = 1 << 14


def known(k: object) -> object:
    """A key's part as it is looked up: all missing values are one."""
    return None if k is None or k is pd.NaT or (isinstance(k, float) and k != k) else k.item() if isinstance(k, np.generic) else k


def apply_models(df: DataFrame, models: DataFrame, keys: list[str], numbers: Column, run: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: object) -> DataFrame:
    """``run(rows, model)`` over the rows of each key, some at a time; keys without a model give nothing.

    ``models`` has one row a key, and ``numbers`` says of how many doubles.  Models that are small
    together go to every executor once; else rows are dealt into blocks of their key, and a model is
    copied once a block.
    """
    models = written(models)
    size = models.agg(F.sum(numbers.cast("long"))).first()[0] or 0
    if 8 * size <= BROADCAST_BYTES:
        held = df.sparkSession.sparkContext.broadcast({tuple(known(r[k]) for k in keys): r for _, r in models.toPandas().iterrows()})

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k, rows in b.groupby(keys, dropna=False, sort=False).indices.items():
                    model = held.value.get(tuple(known(x) for x in (k if isinstance(k, tuple) else (k,))))
                    if model is not None:
                        yield run(b.iloc[rows].reset_index(drop=True), model)

        return df.mapInPandas(each, schema)
    sizes = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ROWS)).alias("__blocks"))

    def same(a: DataFrame) -> Column:
        return reduce(and_, [a[k].eqNullSafe(sizes[f"__{k}"]) for k in keys])

    drop = [f"__{k}" for k in keys]
    rows = df.join(sizes, same(df)).drop(*drop).withColumn("__block", F.floor(F.rand(7) * F.col("__blocks"))).drop("__blocks")
    copies = models.join(sizes, same(models)).drop(*drop).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).drop("__blocks")
    renamed = copies.withColumnsRenamed({c: f"m__{c}" for c in copies.columns})

    def meet(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if part.empty or model.empty:
            return pd.DataFrame(columns=names)
        return run(part.drop(columns="__block"), model.rename(columns=lambda c: c.removeprefix("m__")).iloc[0])

    names = schema.names if hasattr(schema, "names") else [c.split()[0] for c in schema.split(", ")]
    return written(rows).groupBy(*keys, "__block").cogroup(renamed.groupBy(*[f"m__{k}" for k in keys], "m____block")).applyInPandas(meet, schema)
