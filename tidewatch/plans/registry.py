"""Queries and oracle SQL of all operators outside ``llm``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.fixtures import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Added before rounding on both sides, so that exact halves round alike.
NUDGE = 2.3e-9
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits and whole numbers as longs, as the SQL twins have them."""
    kinds = {"double": lambda c: F.round(F.col(c) + NUDGE, 6), "float": lambda c: F.round(F.col(c).cast("double") + NUDGE, 6), "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[k](c).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; ``sql`` goes on behind the fixtures' common table expressions."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = SQL + sql.replace(", 6) + 0", f" + {NUDGE}, 6) + 0")
        return f

    return put


from tidewatch.plans import evaluation, feature, preparation, streams, testing  # noqa: E402, F401
