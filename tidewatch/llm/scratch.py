"""Tables that cut lineage, written to the folder which all machines of the cluster share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (``local[...]``) gets a temporary folder; on a
    cluster there is no folder to fall back to, and a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; return it as read back, and its path for :func:`drop`."""
    path = f"{shared_dir(spark)}/t{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`cut` wrote and nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
