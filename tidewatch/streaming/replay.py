"""Replays: a table written as files in order of arrival, streamed, and its output read back."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.shared import new_folder

#: Files of a slice, by key, and so of a micro-batch.
FILES = 4


def write_arrivals(rows: DataFrame, arrival: str, slices: list, by: str) -> str:
    """Writes rows to a folder in slices, in turn: those with ``arrival`` below each bound of ``slices``, and the rest."""
    folder = new_folder(rows.sparkSession)
    lower = None
    for upper in [*slices, None]:
        part = rows
        if lower is not None:
            part = part.where(F.col(arrival) >= F.lit(lower))
        if upper is not None:
            part = part.where(F.col(arrival) < F.lit(upper))
        part.drop(arrival).repartition(FILES, by).write.mode("append").parquet(folder)
        lower = upper
    return folder


def read_arrivals(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """The stream of a folder's files in the order of their writing, ``files`` a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_append(out: DataFrame) -> DataFrame:
    """Runs a stream over all that there is, and reads what it appended."""
    spark = out.sparkSession
    folder = new_folder(spark)
    writer = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", new_folder(spark)).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(out.schema).parquet(folder)


def run_update(out: DataFrame, keys: list[str], newest: Callable) -> DataFrame:
    """Runs a stream in update mode and reads each key's newest row, by the largest ``newest`` column.

    A micro-batch that is run again after a failure writes over its own folder.
    """
    spark = out.sparkSession
    folder = new_folder(spark)
    spark.createDataFrame([], out.schema).write.parquet(f"{folder}/batch=-1")  # a stream without rows has no batch

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", new_folder(spark)).trigger(availableNow=True)
    writer.start().awaitTermination()
    rest = [c for c in out.columns if c not in keys]
    rows = spark.read.schema(out.schema).parquet(folder)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(*keys, "r.*")
